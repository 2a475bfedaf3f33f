"""Consecutive-record pairs, labels and running histories.

Windows are partitioned by user over *records* (one per assessment period), not over
sensor rows, so a partition is as long as a subject's assessment history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitio.functions import scalar as S


BUCKET_PERIODS = 16  # records of one user are windowed in time buckets of 16 periods


def _bucketed(records: DataFrame, period: int) -> DataFrame:
    days = F.datediff(F.col("date"), F.lit("1970-01-01"))
    return records.withColumn("_bk", F.floor(days / F.lit(period * BUCKET_PERIODS)).cast("long"))


def neighbour(records: DataFrame, cols: list[str], period: int, direction: int, name: str) -> DataFrame:
    """Previous (direction -1) or next (+1) record of the same user in (date, idx) order,
    as a struct of ``cols``, without a window over a whole user.

    Two levels: lag/lead inside (user, time bucket); a bucket's first (last) record takes
    the last (first) record of the nearest earlier (later) non-empty bucket, found by a
    window over the per-bucket edge rows (one row per user and bucket). A user holding a
    third of all records is spread over its buckets.
    """
    r = _bucketed(records, period)
    payload = F.struct(*[F.col(c) for c in cols])
    shift = F.lag if direction < 0 else F.lead
    r = r.withColumn("_in", shift(payload).over(Window.partitionBy("user", "_bk").orderBy("date", "idx")))
    edge = (F.max if direction < 0 else F.min)(F.struct("date", "idx", payload.alias("p")))
    edges = r.groupBy("user", "_bk").agg(edge.alias("_edge"))
    edges = edges.select("user", "_bk", shift("_edge").over(Window.partitionBy("user").orderBy("_bk"))["p"].alias("_out"))
    r = r.join(edges, ["user", "_bk"], "inner")
    return r.withColumn(name, F.coalesce("_in", "_out")).drop("_in", "_out", "_bk")


def adjacent_pairs(records: DataFrame, features: list[str], period: int = 14,
                   threshold: float = 3, cut: float = 10) -> DataFrame:
    """W2 + P7 (nowcast): each surviving record paired with the previous surviving record of the
    same user, kept only when exactly ``period`` days apart; label previous -> current."""
    df = neighbour(records, ["date", "phq9", *features], period, -1, "_prev").where(F.col("_prev").isNotNull())
    df = df.where(F.datediff(F.col("date"), F.col("_prev.date")) == period)
    return df.select(
        "*",
        F.col("_prev.date").alias("prev_date"),
        F.col("_prev.phq9").alias("prev_phq9"),
        *[F.col(f"_prev.{f}").alias(f"prev_{f}") for f in features],
        S.severity_state(F.col("_prev.phq9"), cut).alias("previous_state"),
        S.severity_state("phq9", cut).alias("current_state"),
        S.transition_label("phq9", F.col("_prev.phq9"), threshold).alias("label"),
    ).drop("_prev")


def forecast_pairs(records: DataFrame, period: int = 14, threshold: float = 3) -> DataFrame:
    """W1 + P8 + P9 (forecast): features of a record with the next record's score as target,
    kept when the next record is exactly ``period`` days later and its score is present."""
    df = neighbour(records, ["date", "phq9"], period, 1, "_next")
    df = df.where((F.datediff(F.col("_next.date"), F.col("date")) == period)
                  & F.col("_next.phq9").isNotNull())
    return df.select(
        "*",
        F.col("_next.phq9").alias("future_phq9"),
        S.transition_label(F.col("_next.phq9"), "phq9", threshold).alias("label"),
    ).drop("_next")


def _valid_sum_count(arr: str):
    """Per-record sum (exact decimal) and count of finite, present elements of a sequence."""
    valid = (f"filter(CAST(`{arr}` AS ARRAY<DOUBLE>), x -> x IS NOT NULL AND NOT isnan(x) "
             f"AND abs(x) != CAST('Infinity' AS DOUBLE))")
    total = F.expr(f"aggregate({valid}, CAST(0 AS DECIMAL(28,9)), "
                   f"(acc, x) -> CAST(acc + CAST(x AS DECIMAL(28,9)) AS DECIMAL(28,9)))")
    return total, F.expr(f"size({valid})")


def history_average(records: DataFrame, features: list[str], period: int = 14) -> DataFrame:
    """Per metric, mean of all valid elements of all *earlier* records of the user
    (not only adjacent ones), rounded to 1 decimal; NULL when there is none.

    Exact decimal running sums in two levels: within (user, time bucket) over
    ``rowsBetween(unboundedPreceding, -1)``, plus the totals of all earlier buckets (a
    running sum over one row per user and bucket). Linear, order-independent, and no
    window spans a whole user.
    """
    parts = []
    for f in features:
        total, n = _valid_sum_count(f)
        parts += [total.alias(f"_s_{f}"), n.alias(f"_n_{f}")]
    r = _bucketed(records.select("*", *parts), period)
    w_in = Window.partitionBy("user", "_bk").orderBy("date", "idx").rowsBetween(Window.unboundedPreceding, -1)
    inner = [F.sum(f"_{k}_{f}").over(w_in).alias(f"_i{k}_{f}") for f in features for k in ("s", "n")]
    r = r.select("*", *inner)
    totals = r.groupBy("user", "_bk").agg(*[F.sum(f"_{k}_{f}").alias(f"_t{k}_{f}") for f in features for k in ("s", "n")])
    w_b = Window.partitionBy("user").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("user", "_bk", *[F.sum(f"_t{k}_{f}").over(w_b).alias(f"_e{k}_{f}")
                                            for f in features for k in ("s", "n")])
    r = r.join(totals, ["user", "_bk"], "inner")
    hist = []
    for f in features:
        s = F.coalesce(F.col(f"_is_{f}"), F.lit(0)) + F.coalesce(F.col(f"_es_{f}"), F.lit(0))
        n = F.coalesce(F.col(f"_in_{f}"), F.lit(0)) + F.coalesce(F.col(f"_en_{f}"), F.lit(0))
        hist.append(F.when(n > 0, S.np_round(s.cast("double") / n, 1)).alias(f"hist_{f}"))
    return r.select(*records.columns, *hist)
