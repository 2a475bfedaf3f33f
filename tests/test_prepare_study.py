"""Preparation and study fixtures (FIXTURES section 4: A9, A10, A11, X2, P11, R2)."""
from pyspark.sql import functions as F

from transitio.operators import prepare as PP
from transitio.operators import sampling as SM
from transitio.plans import study as ST


def test_standard_scale_population_std(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 4.0)], "id long, x double")
    out = PP.standard_scale(df, PP.standard_stats(df, ["x"]), ["x"], digits=4).orderBy("id").collect()
    assert [r.x for r in out] == [-1.069, -0.2673, 1.3363]


def test_minmax_constant_feature_is_zero_and_eval_not_clipped(spark):
    train = spark.createDataFrame([([5.0, 5.0], [0.0, 10.0])], "a array<double>, b array<double>")
    ev = spark.createDataFrame([([7.0], [20.0])], "a array<double>, b array<double>")
    stats = PP.minmax_stats(train, ["a", "b"])
    assert PP.minmax_scale(train, stats, ["a", "b"]).first().a == [0.0, 0.0]
    r = PP.minmax_scale(ev, stats, ["a", "b"]).first()
    assert r.a == [2.0] and r.b == [2.0]


def test_flatten_pads_and_truncates(spark):
    df = spark.createDataFrame([(list(range(12)),), (list(range(16)),)], "battery_afternoon array<int>")
    out = df.select(*PP.flatten_sequences(df, ["battery_afternoon"], 14)).collect()
    assert out[0]["battery_afternoon_12"] == 11 and out[0]["battery_afternoon_13"] is None
    assert out[1]["battery_afternoon_14"] == 13 and "battery_afternoon_15" not in out[1].asDict()


def test_power_set_sizes_and_names():
    cfg = ST.power_set_configs(["a", "b", "c", "d"])
    sizes = [name.count("_") + 1 for _, name, _ in cfg]
    assert len(cfg) == 15 and sorted(sizes) == [1] * 4 + [2] * 6 + [3] * 4 + [4]
    assert cfg[0][1] == "a_b_c_d" and cfg[-1][1] == "d"


def test_summary_single_run_std_is_null(spark):
    df = spark.createDataFrame([("m", "s1", 0.5, 0.25, 0.1, 0.2, 0.3, 14), ("m", "s2", 0.5, 0.25, 0.1, 0.2, 0.3, 14),
                                ("m", "s2", 0.7, 0.35, 0.1, 0.2, 0.3, 14)],
                               "model string, feature_set string, accuracy double, macro_f1 double, weighted_f1 double, "
                               "macro_precision double, macro_recall double, num_features int")
    out = {r.feature_set: r for r in ST.summarize(df).collect()}
    assert out["s1"].macro_f1_std is None and out["s2"].macro_f1_mean == 0.3 and out["s2"].accuracy_std == 0.1414


def test_two_stage_split_sizes(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 20).alias("g"))
    sides = {r.side: r.n for r in SM.two_stage_split(df, "g", 1).groupBy("side").agg(
        F.countDistinct("g").alias("n")).collect()}
    assert sides == {"test": 8, "eval": 6, "train": 6}


def test_study_has_one_row_per_cell_and_reports_failures(spark):
    rows = [(i, i % 3, float(i % 3) + (i % 7) / 100, float(i % 5)) for i in range(90)]
    data = spark.createDataFrame([(i, float(y), a, b) for i, y, a, b in rows], "row_id long, y double, a double, b double")

    def split(df, seed):
        return df.withColumn("side", F.when(F.col("row_id") % 4 == 0, "eval").otherwise("train"))

    grids = {"random_forest": {"numTrees": [5], "maxDepth": [3]}, "unknown": {"depth": [1]}}
    out = {r.model: r for r in ST.run_study(data, {"a_b": ["a", "b"]}, grids, [1], split).collect()}
    assert set(out) == set(grids)
    assert out["random_forest"].accuracy > 0.9 and out["random_forest"].error is None
    assert out["unknown"].accuracy is None and "unknown" in out["unknown"].error


def test_study_inputs_oversample_the_train_side_only(spark):
    data = spark.createDataFrame([(i, float(i % 10 == 0), float(i)) for i in range(100)], "row_id long, y double, a double")
    out = ST.study_inputs(data, ["a"], 1, lambda df, seed: df.withColumn("side", F.when(F.col("row_id") >= 80, "eval").otherwise("train")))
    n = {(r.side, r.y): r["count"] for r in out.groupBy("side", "y").count().collect()}
    assert n == {("eval", 0.0): 18, ("eval", 1.0): 2, ("train", 0.0): 72, ("train", 1.0): 48}
    assert out.select("row_id").distinct().count() == out.count()
