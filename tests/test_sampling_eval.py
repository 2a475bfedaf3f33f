"""Splits, oversampling, few-shot properties and metric fixtures."""
from pyspark.sql import functions as F
from pyspark.sql import Window

from transitio.operators import evaluate as EV
from transitio.operators import sampling as SM


def test_dense_index_equals_row_number(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 3).alias("s"))
    h = SM.seeded_md5(7, "id")
    got = SM.dense_index(df, ["s"], h, "id", digits=2)
    ref = df.withColumn("_h", h).withColumn("ref", F.row_number().over(Window.partitionBy("s").orderBy("_h", "id")) - 1)
    j = got.join(ref.select("id", "ref"), "id")
    assert j.count() == 5000 and j.where(F.col("pos") != F.col("ref")).count() == 0


def test_group_split_sizes_and_disjoint(spark):
    df = spark.range(110).select(F.col("id"), (F.col("id") % 11).alias("g"))
    sp = SM.group_split(df, "g", 3)
    sides = sp.groupBy("g").agg(F.countDistinct("side").alias("n"), F.first("side").alias("side")).collect()
    assert all(r.n == 1 for r in sides)
    assert sum(r.side == "test" for r in sides) == 5 and sp.count() == 110


def test_oversample_counts(spark):
    rows = [("a", i) for i in range(10)] + [("b", 100 + i) for i in range(4)] + [("c", 200)]
    df = spark.createDataFrame(rows, "label string, id long")
    out = SM.oversample(df, "label", "id", 1).groupBy("label").count().orderBy("label").collect()
    assert [(r.label, r["count"]) for r in out] == [("a", 10), ("b", 9), ("c", 6)]


def test_holdout_sizes(spark):
    out = SM.holdout_split(spark.range(13).withColumnRenamed("id", "rid"), "rid", 1)
    assert out.where("side = 'validation'").count() == 2 and out.count() == 13


def test_few_shot_never_own_text_and_distinct(spark):
    pool = spark.createDataFrame([(1, "s", "t1"), (2, "s", "t1"), (3, "s", "t2"), (4, "s", "t3")],
                                 "id long, st string, txt string")
    pairs = SM.few_shot_positions(pool, pool, "st", "txt", "id", "id", 2, 1)
    ex = pairs.join(pool.select(F.col("id").alias("example_id"), F.col("txt").alias("ex_txt")), "example_id") \
        .join(pool.select("id", "txt"), "id").collect()
    assert all(r.ex_txt != r.txt for r in ex)
    by_q = {}
    for r in ex:
        by_q.setdefault(r.id, []).append(r.example_id)
    assert all(len(v) == len(set(v)) == 2 for v in by_q.values())
    assert sorted(by_q[1]) == [3, 4] and sorted(by_q[2]) == [3, 4]


def test_few_shot_shortage(spark):
    pool = spark.createDataFrame([(1, "s", "a"), (2, "s", "b")], "id long, st string, txt string")
    q = spark.createDataFrame([(9, "s", "z")], "id long, st string, txt string")
    out = SM.few_shot_positions(pool, q, "st", "txt", "id", "id", 3, 1).collect()
    assert len(out) == 2 and all(r.n_found == 2 for r in out)


def test_few_shot_keys_sample_independently(spark):
    base = spark.range(60).select("id", (F.col("id") % 2).cast("string").alias("st"), F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("txt"))
    both = SM.seeds_frame(base, [1, 2])
    got = SM.few_shot_positions(both, both, "st", "txt", "id", "id", 4, F.col("seed"), keys=["seed"])
    assert got.columns == ["seed", "id", "j", "example_id", "n_found"]
    for seed in (1, 2):
        want = SM.few_shot_positions(base, base, "st", "txt", "id", "id", 4, seed)
        assert sorted(map(tuple, got.where(F.col("seed") == seed).drop("seed").collect())) == sorted(map(tuple, want.collect()))


def test_metrics_fixture(spark):
    df = spark.createDataFrame([("0", "0"), ("0", "1"), ("1", "1")], "y string, p string")
    m = EV.metrics(df, "y", "p").first()
    assert round(m.accuracy, 4) == 0.6667
    assert (round(m.macro_precision, 4), round(m.macro_recall, 4), round(m.macro_f1, 4)) == (0.75, 0.75, 0.6667)
    assert (round(m.weighted_precision, 4), round(m.weighted_recall, 4), round(m.weighted_f1, 4)) == (0.8333, 0.6667, 0.6667)
    rep = {r.row: r for r in EV.report(df, "y", "p", ["0", "1", "2"]).collect()}
    assert round(rep["macro avg"].f1, 4) == round((2 / 3) * (2 / 3), 4) and rep["2"].support == 0
    cm = EV.confusion_matrix(df, "y", "p").collect()
    assert len(cm) == 4 and sum(r.n for r in cm) == 3


def test_partition_count_does_not_change_results(spark):
    from __spark_entry__ import queries
    from tests.oracle_harness import digest
    q = queries()["few_shot_pairs"]
    out = []
    for n in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        df = q(spark, "/root/testdata/sf0.001")
        out.append(digest(df.columns, [tuple(r) for r in df.collect()]))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(set(out)) == 1
