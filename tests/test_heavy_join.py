"""Joins dealt by key counts: same rows as a plain join, and parts that grow with a key's rows."""

import pytest
from pyspark.sql import functions as F

from transitio.operators.skew import balanced_join, heavy_keys


def _big(spark, rows):
    """A third of all rows on key 0, the rest on 50 keys."""
    return spark.range(rows).select(F.col("id").alias("row"),
                                    F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("k"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_equals_plain_join(spark, how):
    big = _big(spark, 6000).unionByName(spark.createDataFrame([(-1, None)], "row long, k long"))
    small = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = balanced_join(big, small, ["k"], F.col("row"), how, rows_per_part=100)
    want = big.join(small, ["k"], how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_parts_grow_with_the_key(spark):
    def parts(rows):
        counts = _big(spark, rows).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        return {r.k: r._parts for r in heavy_keys(counts, ["k"], rows_per_part=1000).collect()}
    assert parts(30_000)[0] == 10
    assert parts(300_000)[0] == 100


def test_heavy_key_reaches_many_tasks(spark):
    def tasks(rows):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "400")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            small = spark.range(0, 60).select(F.col("id").alias("k"), F.lit(1).alias("v"))
            out = balanced_join(_big(spark, rows), small, ["k"], F.col("row"), rows_per_part=1000)
            return out.where("k = 0").select(F.spark_partition_id().alias("p")).distinct().count()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    few, many = tasks(12_000), tasks(120_000)
    assert few <= 4 and many >= 8 * few - 4


def test_empty(spark):
    big = _big(spark, 0)
    small = spark.createDataFrame([], "k long, v long")
    assert balanced_join(big, small, ["k"], F.col("row")).count() == 0
