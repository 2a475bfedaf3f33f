"""Language identification with bit-sliced Bloom filters of n-grams (operator 5).

Every language has a Bloom filter of the n-grams that are usual in it; the filters are bit-sliced:
one array of words, bit l of word i is bit i of language l's filter, so the AND of an n-gram's few
words is the bitmask of all languages that contain it. Per language the hits of a text are
counted, corrected for the filter's false-positive rate, and the highest count decides. N-grams are
runs of four bytes inside lower-cased words, and whole words.

Filters are fitted on a bounded sample of rows that are not held out (about SAMPLE per language,
all of a language with fewer, chosen by a hash of text and id): an n-gram belongs to a language if at least MIN_RATE of its sampled texts
have it, and at least REL_RATE of the rate in the language where it is most usual. By MIN_RATE,
the number of n-grams a language can have is bounded by the length of texts, not by their number;
the array has 2^SLICE_BITS words whatever the corpus, one per 64 languages. Prediction is one pass without a shuffle.

Cases: a text that is null or has no letter is ``und`` with score 0; a text without any known
n-gram gets the most usual language of all learnable rows with that language's share; equal counts go to
the more usual language, then the smaller name; without any learnable row all is ``und``; a null id is not held
out; repeated rows are predicted each; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitio.llm.tokens import PUNCT, Words, bags, mix, pieces, words
from transitio.llm.toxic_crf import held_out

SAMPLE = 10000
_PARTS = 1 << 30
GRAM = 4
MIN_RATE = 0.01
REL_RATE = 0.25
SLICE_BITS = 20
HASHES = 3
UND = "und"
_U = np.uint64


def grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every four-byte run inside a word and of every whole word."""
    size = w.end - w.start
    many = np.maximum(size - GRAM + 1, 0)
    at = np.repeat(w.start - (np.cumsum(many) - many), many) + np.arange(many.sum())
    inner = w.hash_of(at, at + GRAM)
    return np.concatenate([w.row, np.repeat(w.row, many)]), np.concatenate([w.hashes() ^ _U(0x5DEECE66D), inner])


def slots(h: np.ndarray, k: int) -> np.ndarray:
    return (mix(h + _U(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> _U(64 - SLICE_BITS)).astype(np.int64)


def build(languages: list[str], members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(slices [2^SLICE_BITS, words of 64 languages], false-positive rate per language)."""
    width = -(-len(languages) // 64)
    table = np.zeros((1 << SLICE_BITS, width), dtype=_U)
    rate = np.zeros(len(languages))
    for l, m in enumerate(members):
        at = np.unique(np.concatenate([slots(m, k) for k in range(HASHES)])) if len(m) else np.zeros(0, np.int64)
        table[at, l // 64] |= _U(1) << _U(l % 64)
        rate[l] = (len(at) / (1 << SLICE_BITS)) ** HASHES
    return table, rate


def counts(w: Words, table: np.ndarray, n_languages: int) -> tuple[np.ndarray, np.ndarray]:
    """(hits per row and language, n-grams per row)."""
    row, h = grams(w)
    out = np.zeros((w.rows, n_languages))
    at = [slots(h, k) for k in range(HASHES)]
    for word in range(table.shape[1]):
        mask = table[at[0], word]
        for a in at[1:]:
            mask = mask & table[a, word]
        some = np.flatnonzero(mask)
        mask, r = mask[some], row[some]
        for l in range(word * 64, min(n_languages, word * 64 + 64)):
            out[:, l] = np.bincount(r[(mask >> _U(l % 64)) & _U(1) == 1], minlength=w.rows)
    return out, np.bincount(row, minlength=w.rows)


def gram_rates(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int) -> tuple[dict, dict]:
    """(learnable texts per language, {language: {n-gram: rate}}) from rows that are not held out; the
    rates are those of about ``sample`` texts per language."""
    learn = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(_PARTS)).alias("part"))
    per = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("first")).collect()  # one row per language
    totals = {r["lang"]: r["n"] for r in per}
    # at least the row with the smallest hash, so that no language is left without a text
    cuts = [(r["lang"], max(r["first"] + 1, int(_PARTS * min(1.0, sample / r["n"])))) for r in per]
    cuts = docs.sparkSession.createDataFrame(cuts, "lang string, cut long")
    chosen = learn.join(F.broadcast(cuts), "lang").where("part < cut").select("lang", "text")
    sizes = {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).dictionary_encode()
            code = names.indices.to_numpy()
            for lo, hi, data, offs in pieces(b.column(1)):
                r, h, _ = bags(*grams(words(data, offs, PUNCT)))  # once per text
                c, g, n = bags(code[lo:hi][r], h)
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(c)), pa.array(g.view(np.int64)),
                                                  pa.array(n.astype(np.int64))], names=["lang", "g", "n"])

    seen = chosen.mapInArrow(run, "lang string, g bigint, n bigint").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    least = [(lang, max(2, int(np.ceil(size * MIN_RATE))) if size > 2 else 1) for lang, size in sizes.items()]
    least = docs.sparkSession.createDataFrame(least, "lang string, least long")  # one row per language
    rates: dict = {lang: {} for lang in sizes}
    for r in seen.join(F.broadcast(least), "lang").where("n >= least").collect():  # a language has at most (n-grams per text) / MIN_RATE of these
        rates[r["lang"]][r["g"]] = r["n"] / sizes[r["lang"]]
    return totals, rates


def fit(sizes: dict, rates: dict) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(languages, the most usual first; slices; false-positive rates; shares)."""
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    top: dict = {}
    for lang in languages:
        for g, r in rates[lang].items():
            top[g] = max(r, top.get(g, 0.0))
    members = [np.array([g for g, r in rates[lang].items() if r >= REL_RATE * top[g]], dtype=np.int64).view(_U) for lang in languages]
    table, rate = build(languages, members)
    total = max(1, sum(sizes.values()))
    return languages, table, rate, np.array([sizes[x] / total for x in languages])


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            sample: int = SAMPLE) -> DataFrame:
    """id, held_out, lang_pred, score, one row per row of ``docs``."""
    languages, table, rate, share = fit(*gram_rates(docs, id_col, text_col, lang_col, sample))
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    src = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), letter.alias("letter"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((languages, table, rate, share))  # 2^SLICE_BITS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, table, rate, share = shared.value
        names = np.array([*languages, UND], dtype=object)
        for b in batches:
            for lo, hi, data, offs in pieces(b.column(3)):
                n = hi - lo
                hits, total = counts(words(data, offs, PUNCT), table, len(languages))
                right = np.maximum(0.0, (hits - total[:, None] * rate) / (1 - rate)) if languages else hits
                best = right.argmax(axis=1) if languages else np.zeros(n, dtype=np.int64)
                every = right.sum(axis=1)
                at = np.arange(n)
                score = np.where(every > 0, right[at, best] / np.maximum(every, 1e-12), share[0]) if languages else np.zeros(n)
                known = np.asarray(b.column(2).slice(lo, n).to_numpy(zero_copy_only=False), dtype=bool) & bool(languages)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n), b.column(1).slice(lo, n),
                     pa.array(names[np.where(known, best, len(languages))], pa.string()),
                     pa.array(np.where(known, score, 0.0))], names=["id", "held_out", "lang_pred", "score"])

    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("held_out", T.BooleanType()),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)
