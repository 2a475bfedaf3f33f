"""The audit against plain Python over every order, with the cases that the docstring names."""

import itertools
import re
from collections import defaultdict

from pyspark.sql import functions as F

from transitio.llm import filter_audit
from transitio.llm.filter_audit import audit

DOCS = "doc_id long, text string, lang string, row long, part string, mask int"
LABELS = "doc_id long, quality int, toxic int, part string"
LONG = " ".join(f"w{i}" for i in range(300))


def _plain(docs, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    facts = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": i is not None and i > first[t]}
        facts.append((lang or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out, shapley = {}, defaultdict(int)
    for part in {f[0] for f in facts}:
        rows = [f for f in facts if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                hit = [r for r in rows if f in r[1] and not r[1] & before]
                out[part, "".join(order), k + 1] = [
                    sum(not r[1] & (before | {f}) for r in rows), len(hit), sum(f in r[1] and bool(r[1] & before) for r in rows),
                    sum(r[1] == {f} for r in rows), sum(r[2] for r in hit), sum(r[3] for r in hit)]
                shapley[part, f] += len(hit)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def _check(spark, docs, labels):
    d = spark.createDataFrame([(*r, 7, "x", 1) for r in docs], DOCS)
    lab = spark.createDataFrame([(*r, "y") for r in labels], LABELS)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in audit(d, lab).collect()}
    want = _plain(docs, labels)
    assert got == want
    return got


def test_equals_plain_python(spark):
    docs = [(1, LONG, "en"), (2, LONG, "en"), (3, LONG + " #", "en"), (4, "a " * 300, "en"), (5, "a " * 300, "de"),
            (6, "SHOUT " * 250, "de"), (7, None, "de"), (8, "", None), (9, " \t\n\x0b\x0c\r ", None), (10, LONG.upper(), ""),
            (None, LONG, "en"), (None, None, None), (2, LONG, "en"), (2, "other", "en"), (0, "x " * 50_000, "fr"),
            (11, "a b\x1cc " * 210, "fr"), (12, "né " + LONG, "fr")]
    labels = [(1, 1, 0), (2, 1, 1), (2, None, None), (3, None, 1), (4, 0, 1), (7, 1, 1), (10, 1, 0), (None, 1, 1), (99, 1, 1)]
    got = _check(spark, docs, labels)
    assert len(got) == 4 * 600


def test_filter_that_nothing_fails(spark):
    got = _check(spark, [(1, LONG, "en")], [])
    assert set(got.values()) == {(1, 0, 0, 0, 0, 0, 0)}


def test_hot_copies(spark):
    docs = [(i, LONG if i % 3 else f"{LONG} {i}", "en") for i in range(400)]
    _check(spark, docs, [(i, i % 2, int(i % 5 == 0)) for i in range(0, 400, 3)])


def test_empty_tables(spark):
    d = spark.createDataFrame([], DOCS)
    lab = spark.createDataFrame([], LABELS)
    assert audit(d, lab).collect() == []
    one = spark.createDataFrame([(1, LONG, "en", 0, "", 0)], DOCS)
    assert audit(one, lab).count() == 600


def test_rows_are_dealt_once_and_joined_by_semi_and_anti_joins(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    base = filter_audit._rows(docs)
    failing = filter_audit.failing_ids(base)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = filter_audit._survivors(base.select("row", "part"), failing) \
            .groupBy("part", "mask").agg(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("LeftAnti") == 5 and "Python" not in plan and "NestedLoop" not in plan
    assert plan.count("Exchange hashpartitioning(row") == 1
