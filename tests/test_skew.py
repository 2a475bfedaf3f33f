"""Hot keys: many copies of one text in the few-shot pool, one class dominating oversampling."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from transitio.operators import sampling as SM


def _pool(spark):
    # 2,000 rows in 2 strata; 700 rows of stratum 'a' carry the same text.
    df = spark.range(2000).select(
        F.col("id"), F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("st"),
        F.when((F.col("id") % 4 != 0) & (F.col("id") < 934), F.lit("hot")).otherwise(
            F.concat(F.lit("t"), (F.col("id") % 97).cast("string"))).alias("txt"))
    return df


def test_hot_text_pool_index_equals_row_number(spark):
    pool = _pool(spark)
    assert pool.where("txt = 'hot'").count() == 700
    pairs = SM.few_shot_positions(pool, pool, "st", "txt", "id", "id", 5, 1)
    # every query gets 5 distinct examples, none sharing its text
    ex = pairs.join(pool.select(F.col("id").alias("example_id"), F.col("txt").alias("ex_txt")), "example_id") \
        .join(pool.select("id", "txt"), "id")
    assert ex.where("ex_txt = txt").count() == 0
    per_q = ex.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("example_id").alias("d"))
    assert per_q.where("n != 5 OR d != 5").count() == 0 and per_q.count() == 2000
    # the block-wise pool positions equal a plain row_number in (md5(text), md5(id), id) order
    th = SM.seeded_md5(1, "txt")
    ref = pool.select("id", "st", th.alias("h"), SM.seeded_md5(1, "id").alias("hi")).withColumn(
        "pos", F.row_number().over(Window.partitionBy("st").orderBy("h", "hi", "id")) - 1)
    blocks = pool.select("st", th.alias("_th"), "id").groupBy("st", "_th").agg(F.count("*").alias("_size"))
    blocks = SM.weighted_offsets(blocks, ["st"], "_th", "_size", "_start")
    ranked = SM.dense_index(pool.select("st", th.alias("_th"), "id"), ["st", "_th"], SM.seeded_md5(1, "id"), "id", name="_in")
    got = ranked.join(blocks, ["st", "_th"]).select("id", (F.col("_start") + F.col("_in")).alias("pos"))
    assert got.join(ref.select("id", F.col("pos").alias("want")), "id").where("pos != want").count() == 0


def test_dominant_class_oversample(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2000, "big")
                                    .when(F.col("id") < 2990, "mid").otherwise("tiny").alias("label"))
    out = SM.oversample(rows, "label", "id", 1).groupBy("label").count().orderBy("label").collect()
    # mean class size 1000 -> classes below it get int(1000) draws appended
    assert {r.label: r["count"] for r in out} == {"big": 2000, "mid": 1990, "tiny": 1010}
