"""Token counts against the libraries themselves, and what the cache spares."""

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from transitio.llm import token_cache
from transitio.llm.token_cache import count_tokens, read_cache

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  a", "plain words here", "plain words here", "a▁b", "a b", "▁", "<s> x </s> <unk>",
         "né à Zürich \U0001F600", "line\n\nline\t tab", "word " * 60_000, "x" * 30_000]


def _docs(spark, texts, first=0):
    rows = [(first + i, t, i, "d") for i, t in enumerate(texts)]
    # extra columns have the names that the operator uses inside
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, digest string")


def _sp():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return lambda t: len(sp.encode(t))


def test_equals_the_library(spark):
    want, got = _sp(), count_tokens(_docs(spark, TEXTS), MODEL).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {
        i: (len((t or "").encode()), want(t or ""), want(t or "") > 4096) for i, t in enumerate(TEXTS)}


def test_equals_the_library_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = _sp()
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, MODEL).collect()}
    assert got == {k: want(t) for k, t in rows.items()}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_tokenizers(spark, name):
    path = public_tokenizers.path(name)
    tok = Tokenizer.from_file(path)
    texts = TEXTS[:-2] + ["<|endoftext|> is special"]
    got = {r.doc_id: r.n_tokens for r in count_tokens(_docs(spark, texts), path).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_only_distinct_misses_are_encoded(spark, tmp_path):
    cache = str(tmp_path / "cache")
    count_tokens(_docs(spark, TEXTS), MODEL, cache).collect()
    one = read_cache(spark, cache)
    # equal content: null and empty, the repeated words, U+2581 and the space
    assert one.count() == one.select("digest").distinct().count() == len(TEXTS) - 4
    count_tokens(_docs(spark, [*TEXTS, "new text"], 100), MODEL, cache).collect()
    assert read_cache(spark, cache).count() == len(TEXTS) - 3
    # another tokenizer version has counts of its own
    count_tokens(_docs(spark, ["new text"]), public_tokenizers.path("byte_bpe_50k.json"), cache).collect()
    assert read_cache(spark, cache).select("version").distinct().count() == 2


def test_stored_counts_are_used_and_doubled_entries_count_once(spark, tmp_path):
    cache = str(tmp_path / "cache")
    count_tokens(_docs(spark, ["one"]), MODEL, cache).collect()
    entry = read_cache(spark, cache).collect()
    twice = spark.createDataFrame([(r.version, r.digest, 77) for r in entry] * 2, token_cache.CACHE_SCHEMA)
    twice.write.mode("append").parquet(cache)
    assert [r.n_tokens for r in count_tokens(_docs(spark, ["one"]), MODEL, cache).collect()] == [77]


def test_many_misses_go_without_broadcast(spark, monkeypatch):
    want = sorted(map(str, count_tokens(_docs(spark, TEXTS), MODEL).collect()))
    monkeypatch.setattr(token_cache, "FEW_MISSES", 1)
    assert sorted(map(str, count_tokens(_docs(spark, TEXTS), MODEL).collect())) == want


def test_group_of_copies_and_repeated_rows(spark):
    docs = spark.range(3000).select((F.col("id") % 2500).alias("doc_id"),
                                    F.when(F.col("id") % 3 == 0, "copy of one text").otherwise(F.concat(F.lit("t "), F.col("id").cast("string"))).alias("text"))
    want = _sp()
    rows = docs.collect()
    got = count_tokens(docs, MODEL).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((r.doc_id, want(r.text)) for r in rows)


def test_empty_table(spark):
    assert count_tokens(_docs(spark, []), MODEL).collect() == []
    assert count_tokens(_docs(spark, []), MODEL).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
