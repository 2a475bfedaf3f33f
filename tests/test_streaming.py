"""The streaming daily battery features equal the batch ones once all days are closed."""
import os
import shutil

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from transitio.operators.sequences import battery_daily
from transitio.session import scratch_dir
from transitio.sources.testdata import battery
from transitio.streaming.daily import daily_battery_features, start_to_parquet


def test_stream_matches_batch(spark):
    src = scratch_dir(spark, "t-stream-src")
    os.makedirs(src)
    shutil.copy(f"{SF_SMALL}/events.parquet", os.path.join(src, "part-0.parquet"))
    sink = scratch_dir(spark, "t-stream-sink")
    q = start_to_parquet(daily_battery_features(spark, src, lateness="0 seconds"), sink, scratch_dir(spark, "t-ckpt"))
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(sink)
    want = battery_daily(battery(spark.read.parquet(f"{SF_SMALL}/events.parquet")))
    # Append mode emits a day once the watermark passes its end: every day but the last.
    last = want.agg(F.max("date")).first()[0]
    want = want.where(F.col("date") < last)
    got = got.where(F.col("date") < last)
    cols = ["user", "date", "battery_mean", "battery_std", "battery_afternoon"]
    assert got.count() == want.count() > 0
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0


def test_restart_resumes_without_loss(spark):
    """Stop, a new file, restart on the same sink and checkpoint: every closed day arrives once."""
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src, sink, ckpt = (scratch_dir(spark, f"t-restart-{k}") for k in ("src", "sink", "ckpt"))
    cut = events.agg(F.min("ts")).first()[0].replace(day=15)
    for n, part in enumerate((events.where(F.col("ts") < F.lit(cut)), events.where(F.col("ts") >= F.lit(cut)))):
        part.coalesce(1).write.mode("append").parquet(src)
        q = start_to_parquet(daily_battery_features(spark, src, lateness="0 seconds"), sink, ckpt)
        q.processAllAvailable()
        q.stop()
        assert spark.read.parquet(sink).agg(F.max("date")).first()[0].day >= (13, 28)[n]
    want = battery_daily(battery(events))
    last = want.agg(F.max("date")).first()[0]
    want, got = want.where(F.col("date") < last), spark.read.parquet(sink).where(F.col("date") < last)
    cols = ["user", "date", "battery_mean"]
    assert got.count() == want.count() and got.select(cols).exceptAll(want.select(cols)).count() == 0
