"""Filter interaction audit by relations of failing ids.

Every filter has one stored table of the rows that fail it. What a filter does after a prefix of
other filters depends on the prefix's set only, so 32 sets stand for all 120 orders: the survivors
of a set are the rows left-anti joined with the tables of its filters; what the next filter removes
are the rows left-semi joined with its table and left-anti joined with those of the set.

Rows are dealt once by a row number and meet the five id tables there; the sets are multiplied out
after that, so only one narrow row per document is shuffled. No row number repeats, hence no hot key.
"""

from __future__ import annotations

import itertools
import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitio.llm.common import stored
from transitio.operators.skew import balanced_join
from transitio.session import ensure_checkpoint_dir

FILTERS = "ABCDE"
#: Least number of words, least share of distinct ones, largest share of capitals (both in percent), characters of markup.
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, MARKUP = 200, 50, 3, "[#$%&*|]"


def _text_failures(text: Column) -> dict[str, Column]:
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": F.size(words) < MIN_WORDS,
            "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
            "C": 100 * upper > MAX_UPPER * F.length(text),
            "D": text.rlike(MARKUP)}


def _rows(docs: DataFrame) -> DataFrame:
    """One stored row per document: row number, id, part, text digest and the failures of its own text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    fails = _text_failures(text)
    return stored(docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                              F.unhex(F.sha2(text, 256)).alias("digest"),
                              *[fails[f].alias(f"_{f}") for f in "ABCD"])
                  .withColumn("row", F.monotonically_increasing_id()), "audit-rows")


def failing_ids(rows: DataFrame) -> dict[str, DataFrame]:
    """The stored id table (row) of each filter."""
    spark = rows.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/audit-failing-{uuid.uuid4().hex[:12]}"
    own = rows.select("row", F.explode(F.array(*[F.when(F.col(f"_{f}"), F.lit(f)) for f in "ABCD"])).alias("filter")) \
        .where("filter IS NOT NULL")
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("_first"),
                                        F.max("doc_id").alias("_last")).where("_last > _first")
    groups = stored(groups, "audit-copies")
    copies = balanced_join(rows.select("row", "doc_id", "digest"), groups.select("digest", "_first"), ["digest"],
                           F.col("row"), "inner", counts=groups.select("digest", "n")) \
        .where("doc_id > _first").select("row", F.lit("E").alias("filter"))
    own.unionByName(copies).write.partitionBy("filter").parquet(path)
    table = spark.read.schema("row long, filter string").parquet(path)
    return {f: table.where(F.col("filter") == f).select("row") for f in FILTERS}


def _sets(but: int | None = None) -> Column:
    """All sets of filters as bit masks, one row each; without the sets that hold filter ``but``."""
    return F.explode(F.array(*[F.lit(m) for m in range(1 << len(FILTERS)) if but is None or not m >> but & 1]))


def _survivors(rows: DataFrame, failing: dict[str, DataFrame], but: int | None = None) -> DataFrame:
    """(rows' columns, mask): the rows that no filter of the set removes."""
    out = rows.withColumn("mask", _sets(but))
    for i, f in enumerate(FILTERS):
        if i != but:
            ids = failing[f].withColumnRenamed("row", "_id")
            out = out.join(ids, (out["row"] == ids["_id"]) & (out["mask"].bitwiseAND(1 << i) != 0), "left_anti")
    return out


def _orders() -> list[dict]:
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        mask = 0
        for step, f in enumerate(order, 1):
            out.append({"filter_order": "".join(FILTERS[i] for i in order), "step": step, "letter": FILTERS[f],
                        "before": mask, "after": mask | 1 << f})
            mask |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``docs`` (doc_id, text, lang) and ``labels`` (doc_id, quality, toxic). One row per lang value (null:
    empty string), order of the five filters and step; counts are of documents within the part.

    A null text is empty: no words (fails A), no capitals; all empty texts are copies of each other.
    A null doc_id is neither smaller nor larger than another, so it never fails E, and has no label. Rows
    that repeat an id count as often as they are there; equal ids are no copies of each other (E asks
    for a smaller one). Repeated label rows of an id count once: quality or toxic is 1 if any row says
    so. Long texts are taken whole. Other columns of either table, whatever their names, are not
    read. Without documents there are no rows.
    """
    base = _rows(docs)
    failing = failing_ids(base)
    marks = labels.groupBy("doc_id").agg(F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("int")).alias("good"),
                                         F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")).alias("toxic"))
    rows = stored(base.select("row", "part", "doc_id").join(marks, "doc_id", "left")
                  .select("row", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")),
                  "audit-labelled")
    # at most parts x 32 and parts x 80 rows
    kept = _survivors(rows.select("row", "part"), failing).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("kept"))
    removed = None
    for i, f in enumerate(FILTERS):
        one = _survivors(rows.join(failing[f], "row", "left_semi"), failing, but=i) \
            .groupBy("part", "mask").agg(F.count(F.lit(1)).alias("removed"), F.sum("good").alias("good_lost"),
                                         F.sum("toxic").alias("toxic_lost")).withColumn("letter", F.lit(f))
        removed = one if removed is None else removed.unionByName(one)
    kept, removed = stored(kept, "audit-kept"), stored(removed, "audit-removed")

    every = (1 << len(FILTERS)) - 1
    own = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(FILTERS) for x in (f, 1 << i)]), F.col("letter"))
    alone = removed.where(F.col("mask") == 0).select("part", "letter", F.col("removed").alias("fails"))
    unique = removed.where(F.col("mask") == F.lit(every) - own).select("part", "letter", F.col("removed").alias("unique_fails"))
    steps = "array<struct<filter_order: string, step: int, letter: string, before: int, after: int>>"
    spine = rows.groupBy("part").agg(F.count(F.lit(1)).alias("_n")) \
        .select("part", F.inline(F.from_json(F.lit(json.dumps(_orders())), steps)))
    out = spine.join(removed.withColumnRenamed("mask", "before"), ["part", "letter", "before"], "left") \
        .join(kept.withColumnRenamed("mask", "after"), ["part", "after"], "left") \
        .join(alone, ["part", "letter"], "left").join(unique, ["part", "letter"], "left") \
        .na.fill(0, ["kept", "removed", "fails", "unique_fails", "good_lost", "toxic_lost"])
    shapley = out.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return out.join(shapley, ["part", "letter"]) \
        .select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
                "unique_fails", "good_lost", "toxic_lost", "shapley")
