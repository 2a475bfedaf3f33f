"""Joins whose keys are dealt to tasks by how many rows they hold.

A key with few rows is joined as it is. A key with many (a *heavy hitter*) is split into as many
parts as its measured count asks for, so ten times the rows of a key mean ten times the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one part takes.
ROWS_PER_PART = 1000
#: At most this many keys can hold more than 1 / MAX_HEAVY of all rows: the bound of the broadcast table.
MAX_HEAVY = 10_000


def heavy_keys(counts: DataFrame, on: list[str], n: str = "n", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(on..., _parts): the keys of ``counts`` (one row per key, ``n`` rows each) that need several parts.

    A key is heavy above ``rows_per_part`` rows and above 1 / MAX_HEAVY of all rows, so there are
    at most MAX_HEAVY of them at any size. Null keys are never heavy (they match nothing).
    """
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).cast("double").alias("t")).scalar()
    least = F.greatest(F.lit(float(rows_per_part)), total / F.lit(float(MAX_HEAVY)))
    return counts.where(F.col(n) > least).select(*on, F.ceil(F.col(n) / rows_per_part).cast("int").alias("_parts"))


def balanced_join(big: DataFrame, small: DataFrame, on: list[str], spread: Column, how: str = "left",
                  counts: DataFrame | None = None, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Join many rows with one row per key, heavy keys in parts by the hash of ``spread``.

    ``counts`` (on..., n) may be given where it is known; otherwise the keys of ``big`` are counted
    (map-side combined, one narrow row per key and task is shuffled). A row of ``small`` is copied
    once per part of its key, in sum at most ``rows of big / rows_per_part`` copies more than its rows.
    ``how`` is one of inner, left, left_semi, left_anti. Columns of ``big`` and ``small`` other than
    ``on`` must differ, and none may be called ``_parts`` or ``_part``.
    """
    if counts is None:
        counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    heavy = heavy_keys(counts, on, rows_per_part=rows_per_part)
    parts = F.coalesce("_parts", F.lit(1))
    left = big.join(F.broadcast(heavy), on, "left") \
        .withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    right = small.join(F.broadcast(heavy), on, "left") \
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [*on, "_part"], how).drop("_part")
