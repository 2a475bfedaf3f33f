"""Helpers that several operators share: table reading, stored intermediates, salted joins, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitio.session import ensure_checkpoint_dir, materialize

SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, but compressed and column-pruned. Used for tables
    that are read more than once; a lost executor costs only the tasks it was running.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread: Column, how: str = "left",
                salts: int = SALTS) -> DataFrame:
    """Join many rows with one row per key: a key that holds a third of ``big`` is dealt to
    ``salts`` tasks by the hash of ``spread``; every row of ``small`` is repeated per salt."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def fingerprint(df: DataFrame) -> tuple:
    """Order-free digest of a table's rows: their number and two sums of row hashes."""
    h = F.xxhash64(*df.columns)
    row = df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 30)))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest reachable node.

    Alternating large-star / small-star rounds: each round rewires edges towards the smallest
    neighbour, never makes more edges than it got, and needs O(log^2 n) rounds at worst. The
    edge table is checkpointed per round, so a lost executor never replays earlier rounds.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    e = materialize(e)
    seen = fingerprint(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        e = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")) \
            .select("s.u", "s.v").where("u != v").distinct()
        e = materialize(e)
        now = fingerprint(e)
        if now == seen:
            break
        seen = now
    comps = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return comps.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
