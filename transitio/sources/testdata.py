"""Mapping of the driver's test tables onto the panel inputs (sensor tables, scores, survey).

``events`` plays the phone-sensor stream: day = ``to_date(ts)``, epoch = ``hour(ts) div 6``
(0 night, 1 morning, 2 afternoon, 3 evening). Each sensor table has one row per
(user, date) on which its event filter matched; an epoch without events is NULL.
Sums run on ``decimal(12,2)`` so they do not depend on partition order.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitio.sources.tables import table

EPOCHS = ("night", "morning", "afternoon", "evening")
APP_CATEGORIES = ("click", "error", "purchase", "signup", "view")


def panel_range(events: DataFrame) -> tuple[dt.date, int]:
    """First day of the events and the number of days up to their last (one min / max
    aggregate over the time column); an empty table has no days."""
    first, last = events.agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
    return (first, (last - first).days + 1) if first is not None else (dt.date(1970, 1, 1), 0)


def enriched_events(events: DataFrame) -> DataFrame:
    """events -> (user, date, epoch, event_type, v decimal, k int)."""
    return events.select(
        F.col("user_id").alias("user"),
        F.to_date("ts").alias("date"),
        F.floor(F.hour("ts") / 6).cast("int").alias("epoch"),
        "event_type",
        F.col("value").cast("decimal(12,2)").alias("v"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _epoch_mean(i: int, scale: str = "") -> str:
    """Mean of the epoch's values: exact decimal sum, divided once as double; NULL if none."""
    v = f"CASE WHEN epoch = {i} THEN v END"
    return f"CASE WHEN count({v}) > 0 THEN CAST(sum({v}) AS DOUBLE) / count({v}){scale} END"


def _agg(ev: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """Conditional aggregation per (user, date); SQL expression strings keep plan building cheap."""
    return ev.groupBy("user", "date").agg(*[F.expr(e).alias(name) for name, e in exprs.items()])


def battery(events: DataFrame) -> DataFrame:
    """Battery levels: mean per epoch of view/click values; std = max - min of the morning."""
    ev = enriched_events(events).where(F.col("event_type").isin("view", "click"))
    exprs = {f"battery_{e}": _epoch_mean(i) for i, e in enumerate(EPOCHS)}
    exprs["battery_std_morning"] = "CAST(max(CASE WHEN epoch = 1 THEN v END) - min(CASE WHEN epoch = 1 THEN v END) AS DOUBLE)"
    return _agg(ev, exprs)


def accelerometer(events: DataFrame) -> DataFrame:
    """Accelerometer magnitude per epoch: mean value / 100 over all events."""
    return _agg(enriched_events(events), {f"magnitude_{e}": _epoch_mean(i, " / 100D") for i, e in enumerate(EPOCHS)})


def _epoch_sum(i: int, etype: str, factor: int) -> str:
    return f"CAST(sum(CASE WHEN epoch = {i} AND event_type = '{etype}' THEN v END) * {factor} AS DOUBLE)"


def screen(events: DataFrame) -> DataFrame:
    """Screen off (error events) and use (click events) seconds per epoch: sum(value) * 60."""
    ev = enriched_events(events).where(F.col("event_type").isin("error", "click"))
    return _agg(ev, {f"screen_{kind}_{e}": _epoch_sum(i, etype, 60)
                     for kind, etype in (("off", "error"), ("use", "click")) for i, e in enumerate(EPOCHS)})


def apps(events: DataFrame, categories=APP_CATEGORIES) -> DataFrame:
    """Application seconds per category (event type) and epoch: sum(value) * 10."""
    return _agg(enriched_events(events), {f"app_{cat}_{e}": _epoch_sum(i, cat, 10)
                                          for cat in categories for i, e in enumerate(EPOCHS)})


def location(events: DataFrame) -> DataFrame:
    """Location per active day: static = sum(k) of non-error events (NULL if none),
    moving = count of error events, bins = number of distinct event types."""
    return _agg(enriched_events(events), {
        "n_static": "CAST(sum(CASE WHEN event_type <> 'error' THEN k END) AS DOUBLE)",
        "n_moving": "CAST(count(CASE WHEN event_type = 'error' THEN 1 END) AS DOUBLE)",
        "n_bins": "CAST(count(DISTINCT event_type) AS DOUBLE)",
    })


def daily(events: DataFrame, categories=APP_CATEGORIES) -> DataFrame:
    """All sensor tables in one pass: one row per active (user, date) with every sensor's
    columns and presence flags (``battery_present``: a view/click event that day,
    ``screen_present``: an error/click event). Battery columns are NULL on days without a
    battery row. One scan and one shuffle of the events, however many sensors a query
    needs; unused columns are pruned by Catalyst."""
    ev = enriched_events(events)
    bat = "event_type IN ('view', 'click')"

    def bmean(i: int) -> str:
        v = f"CASE WHEN epoch = {i} AND {bat} THEN v END"
        return f"CASE WHEN count({v}) > 0 THEN CAST(sum({v}) AS DOUBLE) / count({v}) END"
    mv = f"CASE WHEN epoch = 1 AND {bat} THEN v END"
    exprs = {
        "battery_present": f"count(CASE WHEN {bat} THEN 1 END) > 0",
        "screen_present": "count(CASE WHEN event_type IN ('error', 'click') THEN 1 END) > 0",
        **{f"battery_{e}": bmean(i) for i, e in enumerate(EPOCHS)},
        "battery_std_morning": f"CAST(max({mv}) - min({mv}) AS DOUBLE)",
        **{f"magnitude_{e}": _epoch_mean(i, " / 100D") for i, e in enumerate(EPOCHS)},
        **{f"screen_{kind}_{e}": _epoch_sum(i, etype, 60)
           for kind, etype in (("off", "error"), ("use", "click")) for i, e in enumerate(EPOCHS)},
        **{f"app_{cat}_{e}": _epoch_sum(i, cat, 10) for cat in categories for i, e in enumerate(EPOCHS)},
        "n_static": "CAST(sum(CASE WHEN event_type <> 'error' THEN k END) AS DOUBLE)",
        "n_moving": "CAST(count(CASE WHEN event_type = 'error' THEN 1 END) AS DOUBLE)",
        "n_bins": "CAST(count(DISTINCT event_type) AS DOUBLE)",
    }
    return _agg(ev, exprs)


def phq(events: DataFrame, period: int = 14, start: dt.date | None = None, days: int | None = None) -> DataFrame:
    """Assessments over the whole range of the events (or a given one): for k = 0..(days-1) div period, date = start + period*k, idx = k+1,
    phq9 = sum(k-prop over (date-period, date]) mod 28; NULL when (user+k) % 17 = 0 or no events.

    Each event day belongs to exactly one window, k = ceil(offset / period), so this is an
    equi-aggregation on (user, k) plus a user x k spine, not a range join.
    """
    if start is None or days is None:
        start, days = panel_range(events)
    ev = enriched_events(events)
    offset = F.datediff(F.col("date"), F.lit(start))
    per_k = (ev.withColumn("k_slot", F.ceil(offset / F.lit(period)).cast("int"))
             .groupBy("user", "k_slot").agg(F.sum("k").alias("ksum")))
    n_k = max(0, (days - 1) // period)
    # Users come from the already aggregated sums (one row per user and window), not from
    # a second scan of the events.
    spine = (per_k.select("user").distinct()
             .select("user", F.explode(F.sequence(F.lit(0), F.lit(n_k))).alias("k_slot")))
    joined = spine.join(per_k, ["user", "k_slot"], "left")
    score = F.when((F.col("user") + F.col("k_slot")) % 17 == 0, F.lit(None)) \
        .otherwise(F.col("ksum") % 28).cast("double")
    return joined.select(
        "user",
        F.date_add(F.lit(start), F.col("k_slot") * period).alias("date"),
        (F.col("k_slot") + 1).cast("int").alias("idx"),
        score.alias("phq9"),
    )


def survey(customer: DataFrame) -> DataFrame:
    """Demographics with duplicates: every 5th user appears again (file_order 2, age + 1)."""
    base = customer.select(
        F.col("c_custkey").alias("user"),
        (F.col("c_custkey") % 2).cast("int").alias("bg_sex"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("mmm-control")).otherwise(F.lit("patient")).alias("group"),
        (F.lit(18) + F.col("c_custkey") % 50).cast("int").alias("bg_age"),
        F.lit(1).alias("file_order"),
    )
    dup = base.where(F.col("user") % 5 == 0).select(
        "user", "bg_sex", "group", (F.col("bg_age") + 1).cast("int").alias("bg_age"), F.lit(2).alias("file_order"))
    return base.unionByName(dup)


class _LazyTables(dict):
    """Builds a mapped table on first access, so a query only pays for what it uses."""

    def __init__(self, builders):
        super().__init__()
        self._builders = builders

    def __missing__(self, key):
        value = self[key] = self._builders[key]()
        return value

    def __contains__(self, key):
        return key in self._builders


def panel(spark: SparkSession, sf_dir: str, period: int = 14) -> dict[str, DataFrame]:
    """All mapped panel inputs for one scale-factor directory (built lazily)."""
    cache: dict[str, DataFrame] = {}

    def events():
        if "events" not in cache:  # one scan definition (and one file listing) per panel
            cache["events"] = table(spark, sf_dir, "events", "user_id", "ts", "event_type", "value", "props")
        return cache["events"]
    return _LazyTables({
        "daily": lambda: daily(events()),
        "battery": lambda: battery(events()),
        "accelerometer": lambda: accelerometer(events()),
        "screen": lambda: screen(events()),
        "apps": lambda: apps(events()),
        "location": lambda: location(events()),
        "phq": lambda: phq(events(), period),
        "survey": lambda: survey(table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")),
    })


def class_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as a classification table: group = source (split key),
    stratum = lang (few-shot stratum), data = text, and a 3-class label text
    (toxic -> More Depressed, else low quality -> Less Depressed, else Remains)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    label = (F.when(F.col("toxic") == 1, F.lit("More Depressed"))
             .when(F.col("quality") == 0, F.lit("Less Depressed")).otherwise(F.lit("Remains")))
    return docs.join(labels, "doc_id", "inner").select(
        "doc_id", "source", "lang", F.col("text").alias("data"), "quality", "toxic", label.alias("label"))
