"""Sources and sinks (S1-S9): explicit-schema CSV, nested sequence JSON, result sinks and
restart detection over the result manifest."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Reference file names per input table (fixed values).
INPUT_FILES = {
    "battery": "battery_4epochs.csv",
    "accelerometer": "accelerometer_4epochs.csv",
    "screen": "screen_4epochs.csv",
    "apps": "application_4epochs.csv",
    "location": "location_4epochs.csv",
    "phq": "PHQ9_scores.csv",
    "survey": "survey_all.csv",
}
# Prompt CSV column names as the reference writes them (fixed values, spelling included).
PROMPT_CSV_NAMES = {
    "user": "user", "current_phq": "current PHQ", "previous_phq": "previous PHQ",
    "previous_state": "previous depression state", "current_state": "current depression state",
    "label": "label", "Basic": "Basic", "Health_Informtion": "Health_Informtion",
    "Statistics": "Statistics", "All": "All",
}
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headered CSV with a declared schema (no inference); multi-line quoted text safe.
    A missing path raises at plan time, as a missing input file should."""
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)


def _epochs(header: str, column: str) -> dict[str, tuple[str, str]]:
    return {header.format(e): (column.format(e), "double") for e in ("night", "morning", "afternoon", "evening")}


# The header names of the input files, the column each one becomes, its type.
INPUT_COLUMNS: dict[str, dict[str, tuple[str, str]]] = {
    "battery": {**_epochs("battery:battery_mean_level:{}", "battery_{}"),
                "battery:battery_std_level:morning": ("battery_std_morning", "double")},
    "accelerometer": _epochs("magnitude_mean:{}", "magnitude_{}"),
    "screen": {**_epochs("screen:screen_off_durationtotal:{}", "screen_off_{}"),
               **_epochs("screen:screen_use_durationtotal:{}", "screen_use_{}")},
    "apps": {},
    "location": {f"location:{c}": (c, "double") for c in ("n_static", "n_moving", "n_bins")},
    "phq": {"idx": ("idx", "int"), "PHQ9": ("phq9", "double")},
    "survey": {"bg_sex": ("bg_sex", "int"), "group": ("group", "string"), "bg_age": ("bg_age", "int")},
}
#: Application columns exist per category: application:duration:<category>:<epoch>.
APP_HEADER = "application:duration:"


def _mapping(table: str, names: list[str]) -> dict[str, tuple[str, str]]:
    """Header name -> (column, type) of one table: its key columns, its own and, of apps, all categories."""
    out = {"user": ("user", "long"), **({} if table == "survey" else {"date": ("date", "date")}), **INPUT_COLUMNS[table]}
    if table == "apps":
        out.update({n: ("app_" + n[len(APP_HEADER):].replace(":", "_"), "double") for n in names if n.startswith(APP_HEADER)})
    return out


def load_input(spark: SparkSession, path: str, table: str, stored: str) -> tuple[DataFrame, DataFrame]:
    """One input file (or folder of files with the same header) by its header names.

    Returns the typed rows and the rejected lines (table, line), both as Parquet under ``stored``, so
    the text is parsed once and in full. Columns are found by name in any order, others are ignored,
    an absent one raises. A line with a field that is not of its type, or with too many or too few
    fields, is rejected, not read as NULL. ``file_order`` (file, block, line within it) keeps
    the order of the file, for the first row of a day or user.
    """
    header = spark.read.text(path).first()  # the first line of the first file
    names = next(csv.reader([header.value])) if header else []
    mapping = _mapping(table, names)
    absent = [n for n in mapping if n not in names]
    if absent:
        raise ValueError(f"{path}: no column {', '.join(absent)}")
    fields = [T.StructField(n, T._parse_datatype_string(mapping[n][1]) if n in mapping else T.StringType()) for n in names]
    bad = "_rejected_line"
    # every field is parsed, also of ignored columns: otherwise short lines pass
    raw = spark.read.options(header="true", quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=bad,
                             enforceSchema="false", columnPruning="false").schema(T.StructType([*fields, T.StructField(bad, T.StringType())])).csv(path)
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("line"))
    rows = raw.select(*[F.col(f"`{n}`").alias(c) for n, (c, _) in mapping.items()], F.col(bad), order.alias("file_order"))
    rows.withColumn("ok", F.col(bad).isNull()).write.partitionBy("ok").parquet(f"{stored}/{table}")
    whole = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("ok", T.BooleanType())])).parquet(f"{stored}/{table}")
    return whole.where("ok").drop(bad, "ok"), whole.where("not ok").select(F.lit(table).alias("table"), F.col(bad).alias("line"))


def load_inputs(spark: SparkSession, data_dir: str, stored: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The seven input tables by their file names, and all rejected lines (table, line)."""
    loaded = {t: load_input(spark, f"{data_dir.rstrip('/')}/{name}", t, stored) for t, name in INPUT_FILES.items()}
    rejected = None
    for _, bad in loaded.values():
        rejected = bad if rejected is None else rejected.unionByName(bad)
    return {t: good for t, (good, _) in loaded.items()}, rejected


def write_inputs(tables: dict[str, DataFrame], data_dir: str) -> None:
    """The seven input tables as CSV under their file names and headers, in file order where a table has one."""
    for t, name in INPUT_FILES.items():
        df = tables[t]
        heads = [f"{APP_HEADER}{c[4:c.rindex('_')]}:{c[c.rindex('_') + 1:]}" for c in df.columns if c.startswith("app_")]
        mapping = _mapping(t, heads)
        keys = [c for c in ("user", "date", "idx", "file_order") if c in df.columns]
        out = df.orderBy(*keys).select(*[F.col(c).alias(n) for n, (c, _) in mapping.items()])
        out.write.mode("overwrite").options(header="true", quote='"', escape='"').csv(f"{data_dir.rstrip('/')}/{name}")


def write_csv(df: DataFrame, path: str, rename: dict[str, str] | None = None, mode: str = "overwrite") -> None:
    """Headered CSV without an index; quotes escaped by doubling so texts with
    quotes and newlines round-trip through ``read_csv``."""
    out = df.select(*[F.col(c).alias((rename or {}).get(c, c)) for c in df.columns])
    out.write.mode(mode).options(**{k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}).csv(path)


def write_nested_json(nested: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per user per line (JSON Lines; readable in parallel)."""
    nested.write.mode(mode).json(path)


def nested_schema(features: list[str]) -> T.StructType:
    """Schema of the nested user JSON. Sequences are read as strings so that the
    reference's 'NaN' / 'Inf' text and plain numbers both parse (then ``try_cast``)."""
    rec = T.StructType([T.StructField("date_text", T.StringType()), T.StructField("PHQ_week2", T.DoubleType())]
                       + [T.StructField(f, T.ArrayType(T.StringType())) for f in features])
    return T.StructType([T.StructField("user", T.LongType()), T.StructField("gender", T.IntegerType()),
                         T.StructField("group", T.StringType()), T.StructField("age", T.IntegerType()),
                         T.StructField("data", T.ArrayType(rec))])


def read_nested_json(spark: SparkSession, path: str, features: list[str], top_level_array: bool = False) -> DataFrame:
    """S3: read nested user records and unnest to one row per (user, record).

    ``top_level_array=True`` reads the reference's single-array file form (``multiLine``,
    one task per file, for import only); the default reads JSON Lines.
    """
    schema = nested_schema(features)
    reader = spark.read.schema(schema)
    if top_level_array:
        reader = reader.option("multiLine", "true")
    users = reader.json(path)
    flat = users.select("user", "gender", "group", "age", F.inline("data"))
    return flat.select(
        "user", "gender", "group", "age", F.to_date("date_text").alias("date"), F.col("PHQ_week2").alias("phq9"),
        *[F.transform(f, lambda x: F.nanvl(x.try_cast("double"), F.lit(None).cast("double"))).alias(f)
          for f in features])


def write_results(df: DataFrame, path: str, partition_by: list[str], fmt: str = "json", mode: str = "append") -> None:
    """Results partitioned by the run key (key as columns, not in file names)."""
    df.write.mode(mode).partitionBy(*partition_by).format(fmt).save(path)


def _listing(spark: SparkSession, path: str, key_cols: list[str]) -> DataFrame:
    """(keys, file_path, file_time, kind) of every JSON and CSV file under ``path``. Spark's own
    sources skip empty files, so the folder is listed through Hadoop's file system, as Spark's
    file index does: names and times only, one entry per result file."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    rows = []
    while files.hasNext():
        f = files.next()
        name = f.getPath().toUri().toString()
        kind = name.rpartition(".")[2]
        if kind in ("json", "csv"):
            keys = dict(unquote(part).split("=", 1) for part in name.split("/") if "=" in part)
            rows.append((*[keys.get(k) for k in key_cols], name, f.getModificationTime(), kind))
    schema = ", ".join([*[f"`{k}` string" for k in key_cols], "file_path string", "ms long", "kind string"])
    return spark.createDataFrame(rows, schema).withColumn("file_time", F.timestamp_millis("ms")).drop("ms")


def result_manifest(spark: SparkSession, path: str, key_cols: list[str], metric_cols: list[str]) -> DataFrame:
    """Manifest of the JSON and CSV result files under ``path``: exactly one row per file, whatever it holds.

    Key columns come from the folders (``key=value``); JSON metrics are read as whole documents,
    so pretty-printed files parse, and joined by path. A file that is empty, corrupt or lacks a
    metric has NULL there.
    """
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in metric_cols])
    docs = spark.read.schema(schema).options(multiLine="true", mode="PERMISSIVE", pathGlobFilter="*.json").json(path)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  both spellings of a local path
    found = docs.groupBy(plain("_metadata.file_path").alias("_path")).agg(*[F.max(c).alias(c) for c in metric_cols])
    files = _listing(spark, path, key_cols).withColumn("_path", plain("file_path"))
    return files.join(found, "_path", "left").select(*key_cols, *metric_cols, "kind", "file_path", "file_time")


def pending_runs_both(grid: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """A run is done iff its key has at least one JSON and one CSV file; returns the
    grid rows that are not done (anti-join)."""
    done = manifest.groupBy(*keys).agg(
        F.bool_or(F.col("kind") == "json").alias("_j"), F.bool_or(F.col("kind") == "csv").alias("_c")) \
        .where(F.col("_j") & F.col("_c")).select(*keys)
    return grid.join(done, keys, "left_anti")


def pending_runs_latest_valid(grid: DataFrame, manifest: DataFrame, keys: list[str], time_col: str,
                              required: list[str]) -> DataFrame:
    """Only the most recent result file per key counts, and it must carry every
    required metric; otherwise the run is pending. ``max(struct(time, valid))`` is a
    plain aggregate (partial per map task), no window over the manifest."""
    valid = F.lit(True)
    for c in required:
        valid = valid & F.col(c).isNotNull()
    latest = manifest.groupBy(*keys).agg(F.max(F.struct(F.col(time_col).alias("t"), valid.alias("ok"))).alias("_l"))
    done = latest.where(F.col("_l.ok")).select(*keys)
    return grid.join(done, keys, "left_anti")
