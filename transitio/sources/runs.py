"""Run outputs that are published whole (S7) and found again on a restart.

An attempt writes the scored rows of one or many run keys as CSV and their evaluations as JSON, and
last a small table of what it published. Readers go by that table alone, so an attempt that breaks
off in between has published nothing and its keys stay pending. No file is listed on the driver and
none is overwritten; a later attempt at a key takes the place of an earlier one by its time.

    scored/attempt=<id>/<key>=<value>/*.csv
    evaluation/attempt=<id>/<key>=<value>/*.json
    published/attempt=<id>/*.parquet        (keys, n_scored, n_evaluated, published_at)

Keys are columns of simple types. Folder names can't tell a null key from an empty one: both are null.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitio.operators.skew import balanced_join
from transitio.sources.io import CSV_OPTIONS

SCORED, EVALUATION, PUBLISHED = "scored", "evaluation", "published"


def _plain(df: DataFrame, keys: list[str]) -> DataFrame:
    """Empty text keys as null."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) if c in keys and c in text else F.col(f"`{c}`")
                       for c in df.columns])


def _run(keys: list[str]) -> Column:
    """One text per key (and attempt), in which null equals null."""
    return F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]))


def write_scored(scored: DataFrame, path: str, keys: list[str], attempt: str) -> None:
    """The scored rows of an attempt, as CSV under their keys."""
    _plain(scored, keys).write.partitionBy(*keys).options(**{k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}) \
        .csv(f"{path}/{SCORED}/attempt={attempt}")


def write_evaluation(evaluation: DataFrame, path: str, keys: list[str], attempt: str) -> None:
    """The metrics of an attempt, one JSON object per key under its key."""
    _plain(evaluation, keys).write.partitionBy(*keys).json(f"{path}/{EVALUATION}/attempt={attempt}")


def publish(spark: SparkSession, path: str, key_schema: T.StructType, attempt: str, at: dt.datetime | None = None) -> None:
    """Makes an attempt visible: counts its rows per key from the files it has written."""
    keys = key_schema.names
    counts = []
    for part, fmt, options, name in ((SCORED, "csv", CSV_OPTIONS, "n_scored"), (EVALUATION, "json", {}, "n_evaluated")):
        # a column besides the keys makes the reader see lines; none of it is parsed
        schema = T.StructType([T.StructField("_line", T.StringType()), *key_schema.fields])
        rows = spark.read.options(**options).schema(schema).format(fmt).load(f"{path}/{part}/attempt={attempt}")
        zero = {n: F.lit(0).cast("bigint").alias(n) for n in ("n_scored", "n_evaluated")}
        one = {**zero, name: F.lit(1).cast("bigint").alias(name)}
        counts.append(rows.select(*keys, *one.values()))
    table = counts[0].unionByName(counts[1]).groupBy(*keys).agg(F.sum("n_scored").alias("n_scored"), F.sum("n_evaluated").alias("n_evaluated"))
    when = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    table.withColumn("published_at", when).write.parquet(f"{path}/{PUBLISHED}/attempt={attempt}")


def write_run(scored: DataFrame, evaluation: DataFrame, path: str, keys: list[str], attempt: str | None = None,
              at: dt.datetime | None = None) -> str:
    """Scored rows and evaluations of one attempt, visible together or not at all; returns its name."""
    attempt = attempt or uuid.uuid4().hex
    write_scored(scored, path, keys, attempt)
    write_evaluation(evaluation, path, keys, attempt)
    publish(scored.sparkSession, path, T.StructType([scored.schema[k] for k in keys]), attempt, at)
    return attempt


def published(spark: SparkSession, path: str, key_schema: T.StructType) -> DataFrame:
    """(keys, attempt, n_scored, n_evaluated, published_at) of every published attempt; empty where there is none."""
    schema = T.StructType([*key_schema.fields, T.StructField("n_scored", T.LongType()), T.StructField("n_evaluated", T.LongType()),
                           T.StructField("published_at", T.TimestampType()), T.StructField("attempt", T.StringType())])
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{PUBLISHED}")
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{PUBLISHED}")


def newest(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The last published attempt per key, by time, then by name; a plain aggregate."""
    last = F.max(F.struct("published_at", "attempt", "n_scored", "n_evaluated")).alias("_l")
    return attempts.groupBy(*keys).agg(last).select(*keys, "_l.attempt", "_l.n_scored", "_l.n_evaluated", "_l.published_at")


def read_scored(spark: SparkSession, path: str, schema: T.StructType, last: DataFrame, keys: list[str]) -> DataFrame:
    """The scored rows of the attempts in ``last``; ``schema`` names data and key columns. The rows of a
    large run meet its entry in parts, by the number of rows that was published."""
    return _of(spark.read.options(**CSV_OPTIONS), "csv", f"{path}/{SCORED}", schema, last, keys, "n_scored")


def read_evaluation(spark: SparkSession, path: str, schema: T.StructType, last: DataFrame, keys: list[str]) -> DataFrame:
    """The metrics of the attempts in ``last``; a broken object or an absent metric is null."""
    return _of(spark.read.option("mode", "PERMISSIVE"), "json", f"{path}/{EVALUATION}", schema, last, keys, "n_evaluated")


def _of(reader, fmt: str, path: str, schema: T.StructType, last: DataFrame, keys: list[str], n: str) -> DataFrame:
    whole = T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])
    tagged = last.where(F.col(n) > 0).select(_run([*keys, "attempt"]).alias("_run"), F.col(n).alias("n"))
    if last.limit(1).count() == 0:
        return last.sparkSession.createDataFrame([], whole)
    rows = reader.schema(whole).format(fmt).load(path).withColumn("_run", _run([*keys, "attempt"]))
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in schema.names])
    return balanced_join(rows, tagged.select("_run"), ["_run"], spread, "left_semi", counts=tagged).drop("_run")


def _without(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    tagged = _plain(grid, keys).withColumn("_run", _run(keys))
    return tagged.join(done.select(_run(keys).alias("_run")), "_run", "left_anti").drop("_run")


def pending_published(grid: DataFrame, attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of ``grid`` without both a scored row and an evaluation in published attempts."""
    both = attempts.groupBy(*keys).agg(F.sum("n_scored").alias("s"), F.sum("n_evaluated").alias("e")).where("s > 0 AND e > 0")
    return _without(grid, both, keys)


def pending_newest_valid(grid: DataFrame, last: DataFrame, evaluation: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """The keys of ``grid`` whose newest attempt has no evaluation with every required metric."""
    valid = evaluation.where(" AND ".join(f"`{c}` IS NOT NULL" for c in required))
    tag = _run([*keys, "attempt"]).alias("_at")
    done = last.select(*keys, tag).join(valid.select(tag).distinct(), "_at", "left_semi").select(*keys)
    return _without(grid, done, keys)
