"""Fixed-length daily sequences per assessment.

Physical shape: every valid assessment is exploded into ``period`` slot rows
(anchor-period+1 .. anchor). The slots are equi-joined to each daily sensor table on
(user, date) - a plain hash/sort-merge join with no range condition, so a user with a
long history is spread over many (user, date) keys. The slot rows are then regrouped by
assessment; each group holds exactly ``period`` rows, so ``collect_list`` is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitio.functions import scalar as S
from transitio.sources.testdata import EPOCHS


@dataclass(frozen=True)
class Feature:
    """A daily per-(user, date) value drawn from one sensor table."""
    source: str
    expr: Column
    kind: str = "double"  # "int" prints without a decimal part


def _battery_cols() -> list[str]:
    return [f"battery_{e}" for e in EPOCHS]


class _Catalog(dict):
    """Feature name -> Feature, each built on first use (building a Column costs JVM calls)."""

    def __init__(self, builders):
        super().__init__()
        self._builders = builders

    def __missing__(self, key):
        value = self[key] = self._builders[key]()
        return value

    def __contains__(self, key):
        return key in self._builders


def feature_catalog() -> dict[str, Feature]:
    """Daily features by name. The first five are the ones rendered into prompts."""
    builders = {
        "battery_afternoon": lambda: Feature("battery", S.truncate_int("battery_afternoon"), "int"),
        "screen_off_night_duration": lambda: Feature("screen", S.seconds_to("screen_off_night", 3600)),
        "screen_use_duration_afternoon": lambda: Feature("screen", S.seconds_to("screen_use_afternoon", 3600)),
        "magnitude_max": lambda: Feature("accelerometer", S.daily_max(
            [f"magnitude_{e}" for e in ("morning", "afternoon", "evening", "night")])),
        "magnitude_afternoon": lambda: Feature("accelerometer", S.np_round("magnitude_afternoon", 1)),
        "location_ratio": lambda: Feature("location", S.safe_ratio("n_static", "n_moving", 2)),
        "location_bins": lambda: Feature("location", F.col("n_bins").cast("double")),
    }
    for kind in ("off", "use"):
        for e in EPOCHS:
            builders.setdefault(f"screen_{kind}_{e}_duration",
                                lambda k=kind, ep=e: Feature("screen", S.seconds_to(f"screen_{k}_{ep}", 3600)))
    return _Catalog(builders)


def app_feature(category: str, epoch: str) -> Feature:
    """application minutes for one category and epoch."""
    return Feature("apps", S.seconds_to(f"app_{category}_{epoch}", 60))


# Record order of the prompt metrics (fixed: it decides the order of the rendered text).
PROMPT_FEATURES = ("battery_afternoon", "screen_off_night_duration", "screen_use_duration_afternoon",
                   "magnitude_max", "magnitude_afternoon")
# The four features the study configurations are built from, in configuration order.
CONFIG_FEATURES = ("battery_afternoon", "screen_off_night_duration", "magnitude_max",
                   "screen_use_duration_afternoon")


def battery_daily(battery: DataFrame) -> DataFrame:
    """F1-F3 per (user, date): truncated mean level, quadratic-mean std, afternoon level."""
    return battery.select(
        "user", "date",
        S.battery_daily_mean(_battery_cols()).alias("battery_mean"),
        S.quadratic_mean(["battery_std_morning"]).alias("battery_std"),
        S.truncate_int("battery_afternoon").alias("battery_afternoon"),
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row per key in the given (ascending, unique per key) order.

    ``min(struct(order..., row))`` is a plain aggregate with map-side partial aggregation,
    so a key with very many duplicate rows never sits whole in one task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = [F.struct(*[F.col(c) for c in rest]).alias("_row")] if rest else []
    best = F.min(F.struct(*[F.col(c) for c in order], *row))
    out = df.groupBy(*keys).agg(best.alias("_first"))
    return out.select(*keys, *[F.col(f"_first.{c}") for c in order], *(["_first._row.*"] if rest else [])).select(*df.columns)


def valid_assessments(phq: DataFrame, entry_idx: int = 1) -> DataFrame:
    """Drop the entry assessment and unanswered ones; a NULL idx is kept."""
    return phq.where(~F.col("idx").eqNullSafe(entry_idx) & F.col("phq9").isNotNull())


def user_window_filter(df: DataFrame, anchors: DataFrame, period: int = 14) -> DataFrame:
    """P1 as a join: rows of ``df`` with date in (anchor - period, anchor] of the same user.

    ``anchors`` has (user, anchor). Each anchor is exploded into its ``period`` dates and
    equi-joined on (user, date): no range predicate, so no (row, anchor) pairs of a user are
    ever formed beyond the matching ones.
    """
    a = anchors.select(F.col("user").alias("_u"), "anchor",
                       F.explode(F.sequence(F.lit(0), F.lit(period - 1))).alias("_o"))
    a = a.withColumn("_d", F.date_sub(F.col("anchor"), F.col("_o")))
    cond = (df["user"] == a["_u"]) & (df["date"] == a["_d"])
    return df.join(a, cond, "inner").drop("_u", "_d", "_o")


def slots(assessments: DataFrame, period: int = 14) -> DataFrame:
    """One row per (assessment, slot), slot 1..period, slot ``period`` = anchor day."""
    return (assessments
            .select("user", F.col("date").alias("anchor"), "idx", "phq9",
                    F.explode(F.sequence(F.lit(1), F.lit(period))).alias("slot"))
            .withColumn("date", F.date_add(F.date_sub(F.col("anchor"), period), F.col("slot"))))


def first_of_day(table: DataFrame) -> DataFrame:
    """The first row of a duplicated (user, date): in ``file_order`` where the table has it, else
    in the order of the values."""
    order = ["file_order"] if "file_order" in table.columns else [c for c in table.columns if c not in ("user", "date")]
    return first_per_key(table, ["user", "date"], order) if order else table.distinct()


def _source_frames(tables: dict[str, DataFrame], features: list[str],
                   catalog: dict[str, Feature]) -> dict[str, DataFrame]:
    by_source: dict[str, list[str]] = {}
    for name in features:
        by_source.setdefault(catalog[name].source, []).append(name)
    frames = {}
    for source, names in by_source.items():
        if source == "battery":
            continue  # battery values come with the mask below
        frames[source] = first_of_day(tables[source]).select(
            F.col("user").alias("_u"), F.col("date").alias("_d"),
            *[catalog[n].expr.alias(n) for n in names])
    return frames


def slot_values(assessments: DataFrame, tables: dict[str, DataFrame], features: list[str],
                period: int = 14, catalog: dict[str, Feature] | None = None) -> DataFrame:
    """J2 + F4 at slot level: every slot with its masked feature values and a missing flag.

    Battery drives everything: ``masked`` = the truncated daily mean is 0 (then the slot is
    missing in all sensors), ``missing`` = no battery row that day or masked.
    """
    catalog = catalog or feature_catalog()
    s = slots(assessments, period)
    if "daily" in tables:
        return _slot_values_wide(s, tables["daily"], features, catalog)
    bat = battery_daily(first_of_day(tables["battery"])).select(
        F.col("user").alias("_u"), F.col("date").alias("_d"), "battery_mean", "battery_std",
        F.col("battery_afternoon").alias("_battery_afternoon"))
    out = s.join(bat, (s["user"] == bat["_u"]) & (s["date"] == bat["_d"]), "left").drop("_u", "_d")
    for frame in _source_frames(tables, features, catalog).values():
        out = out.join(frame, (out["user"] == frame["_u"]) & (out["date"] == frame["_d"]), "left") \
            .drop("_u", "_d")
    masked = F.col("battery_mean").eqNullSafe(0)
    values = {n: F.col("_battery_afternoon") if n == "battery_afternoon" else F.col(n) for n in features}
    keep = [c for c in out.columns if c not in values and c != "_battery_afternoon"]
    return out.select(*keep, masked.alias("masked"), (F.col("battery_std").isNull() | masked).alias("missing"),
                      *[F.when(~masked, v).alias(n) for n, v in values.items()])


def _slot_values_wide(s: DataFrame, daily: DataFrame, features: list[str], catalog) -> DataFrame:
    """Slots joined once to the one-pass daily table (all sensors, presence flags)."""
    present = F.col("battery_present")
    d = daily.select(
        F.col("user").alias("_u"), F.col("date").alias("_d"),
        F.when(present, S.battery_daily_mean(_battery_cols())).alias("battery_mean"),
        F.when(present, S.quadratic_mean(["battery_std_morning"])).alias("battery_std"),
        *[catalog[n].expr.alias(n) for n in features])
    out = s.join(d, (s["user"] == d["_u"]) & (s["date"] == d["_d"]), "left").drop("_u", "_d")
    masked = F.col("battery_mean").eqNullSafe(0)
    keep = [c for c in out.columns if c not in features]
    return out.select(*keep, masked.alias("masked"), (F.col("battery_std").isNull() | masked).alias("missing"),
                      *[F.when(~masked, F.col(n)).alias(n) for n in features])


def build_records(assessments: DataFrame, tables: dict[str, DataFrame], features: list[str],
                  period: int = 14, max_missing: int | None = None, gate: bool = True,
                  catalog: dict[str, Feature] | None = None) -> DataFrame:
    """One row per surviving assessment with one ordered array per feature.

    ``max_missing`` defaults to ``period // 2`` (7 of 14). The gate drops a record with more
    missing battery slots than that; ``gate=False`` keeps them (for ``quality_gate``).
    """
    max_missing = period // 2 if max_missing is None else max_missing
    sv = slot_values(assessments, tables, features, period, catalog)
    arrays = [F.expr(f"transform(sort_array(collect_list(named_struct('slot', slot, 'v', `{n}`))), x -> x.v)").alias(n)
              for n in features]
    rec = sv.groupBy("user", F.col("anchor").alias("date"), "idx", "phq9").agg(
        F.sum(F.col("missing").cast("int")).cast("int").alias("n_missing"), *arrays)
    return rec.where(F.col("n_missing") <= F.lit(max_missing)) if gate else rec


def dedupe_survey(survey: DataFrame) -> DataFrame:
    """First survey row per user in file order."""
    return first_per_key(survey, ["user"], ["file_order"]).drop("file_order")


def attach_survey(records: DataFrame, survey: DataFrame) -> DataFrame:
    """Left join of the deduplicated survey. No broadcast hint: the user table grows
    with the panel, AQE broadcasts it only when its runtime size is below the threshold."""
    sv = dedupe_survey(survey).select("user", F.col("bg_sex").alias("gender"), "group",
                                      F.col("bg_age").alias("age"))
    return records.join(sv, "user", "left")


def reject_rows(records: DataFrame, survey: DataFrame) -> DataFrame:
    """the records whose user has no survey row (kept aside, not part of the prompts)."""
    return records.join(survey.select("user").distinct(), "user", "left_anti")


def nest_user_records(records: DataFrame, features: list[str], chunk_days: int = 366) -> DataFrame:
    """``(user, gender, group, age, chunk, data array<struct>)`` ordered by (date, idx).

    One nested line per user and time chunk (default about a year), so no collect holds a
    whole user however long its history; readers unnest lines and a user's chunks in
    ``chunk`` order concatenate to its full record list.
    """
    item = F.struct(F.col("date"), F.col("idx"),
                    F.date_format("date", "yyyy-MM-dd").alias("date_text"),
                    F.col("phq9").alias("PHQ_week2"), *[F.col(f) for f in features])
    keys = ["user"] + [c for c in ("gender", "group", "age") if c in records.columns]
    chunk = F.floor(F.datediff(F.col("date"), F.lit("1970-01-01")) / F.lit(chunk_days)).cast("long").alias("chunk")
    return records.groupBy(*keys, chunk).agg(F.sort_array(F.collect_list(item)).alias("data"))
