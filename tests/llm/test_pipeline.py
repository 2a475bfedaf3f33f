"""The pipeline's stages on their own inputs, and the oracles of all operator queries."""
import random

import pytest

from tests.conftest import SF_SMALL
from tests.llm.test_bagminhash import bag, classes
from tests.llm.test_mix_pack import brute as brute_mix
from tests.llm.test_toxic_crf import corpus
from tests.oracle_harness import compare, duck

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark, path):
    """Documents with toxic texts, near and exact copies, credentials, nulls and repeated rows."""
    rng = random.Random(9)
    rows, labels = corpus(240, seed=3)
    docs = [(i, t, "en", f"s{i % 4}") for i, t, *_ in rows]
    clean = [d for d, (_, y) in zip(docs, labels) if not y]
    for k, (_, t, lang, s) in enumerate(clean[:12]):
        docs.append((1000 + k, t, lang, s))
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        docs.append((1100 + k, " ".join(w), lang, s))
    docs += [(2000, clean[20][1] + " token=q7Zp0aLk93XwTb21", "en", "s1"), (2001, None, None, None), (2002, "", "en", "s0"),
             (2003, "bal bel", "en", None), (2003, "bal bel", "en", None)]
    df = spark.createDataFrame([(*d, None if d[1] is None else len(d[1])) for d in docs], SCHEMA)
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return dict(labels)


def test_every_stage_against_plain_python(spark, tmp_path):
    import corpus_pipeline as P
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "packing"] and P.ORACLE_SQL is None
    truth = fixture(spark, tmp_path)
    docs, at = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES:
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == before.columns
        at[name] = (before.collect(), docs.collect())

    before, after = at["toxicity"]
    kept = {r.doc_id for r in after}
    assert all((r.doc_id in kept) == (not truth.get(r.doc_id, 0)) for r in before)

    before, after = at["near_dedup"]
    cls = classes([(r.doc_id, r.text) for r in before])
    want = sorted({(c, before[i].doc_id) for i, c in cls.items() if c == before[i].doc_id and bag(before[i].text)})
    assert sorted(r.doc_id for r in after if bag(r.text)) == [c for c, _ in want]
    assert sum(not bag(r.text) for r in after) == sum(not bag(r.text) for r in before)

    before, after = at["secrets"]
    assert {r.doc_id: r.text for r in after} == {r.doc_id: r.text and r.text.replace("q7Zp0aLk93XwTb21", "[SECRET]") for r in before}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)

    before, after = at["mixing"]
    drawn = brute_mix([(r.doc_id, r.text, r.source) for r in before])
    assert sorted((r.doc_id, r.text or "") for r in after) == sorted((d, t or "") for (d, t, *_), n in drawn.items() for _ in range(n))

    before, after = at["packing"]
    assert sum(r.n_tokens for r in after) == sum(len((r.text or "").split()) for r in before)
    assert P.run(spark, str(tmp_path)).count() == len(after)


@pytest.mark.parametrize("name", ["op1_bagminhash", "op2_int8_pairs", "op4_length_buckets", "op6_link_trust", "op7_secret_owners",
                                  "op9_histogram_topk", "op10_poisson_mix", "op11_filter_audit", "op13_conv_trie"])
def test_oracle(spark, name):
    from transitio.llm.oracle import ORACLE
    from transitio.llm.queries import QUERIES
    r = compare(spark, duck(SF_SMALL), name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert r["ok"], r


def test_one_query_per_operator_and_no_local_checkpoint():
    import pathlib

    from __spark_entry__ import oracle_sql, queries
    names = [q for q in queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14)) and "pipeline" in queries()
    assert "pipeline" not in oracle_sql()
    for p in pathlib.Path("transitio/llm").glob("*.py"):
        text = p.read_text()
        assert "localCheckpoint" not in text and "crossJoin" not in text
