"""Hand-worked edge fixtures for the scalar rules (FIXTURES section 4)."""
import hashlib
import math

from pyspark.sql import functions as F

from transitio.functions import scalar as S


def one(spark, expr, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_battery_mean_divides_by_four_and_truncates(spark):
    rows = [(None, 80.0, None, 40.0), (1.0, 1.0, 1.0, 0.0), (None, None, None, None)]
    out = one(spark, S.battery_daily_mean(["a", "b", "c", "d"]), "a double, b double, c double, d double", rows)
    assert out == [30, 0, 0]


def test_quadratic_mean(spark):
    out = one(spark, S.quadratic_mean(["x"]), "x double", [(-3.7,), (None,)])
    assert out == [3, 0]


def test_daily_max_half_even_and_all_null(spark):
    rows = [(None, 0.25, 0.11, None), (None, None, None, None), (float("nan"), 0.3, None, None)]
    out = one(spark, S.daily_max(["a", "b", "c", "d"]), "a double, b double, c double, d double", rows)
    assert out == [0.2, 0.0, 0.3]


def test_seconds_to_hours(spark):
    assert one(spark, S.seconds_to("x", 3600), "x double", [(5400.0,), (0.0,), (None,)]) == [1.5, 0.0, None]


def test_ratio_inf_and_missing(spark):
    rows = [(3.0, 0.0), (0.0, 0.0), (None, 2.0), (7.0, 3.0)]
    out = one(spark, S.safe_ratio("a", "b"), "a double, b double", rows)
    assert math.isinf(out[0]) and math.isinf(out[1]) and out[2] is None and out[3] == 2.33


def test_coerce_tree_and_sequence_paths(spark):
    rows = [(None,), ("NaN",), ("abc",), ("4",)]
    assert one(spark, S.coerce_numeric("x", False), "x string", rows) == [0.0, None, None, 4.0]
    assert one(spark, S.coerce_numeric("x", True), "x string", rows) == [0.0, 0.0, 0.0, 4.0]


def test_severity_and_labels(spark):
    assert one(spark, S.severity_state("x"), "x double", [(9.0,), (10.0,)]) == ["in non-depression", "in depression"]
    rows = [(13.0, 10.0), (14.0, 10.0), (7.0, 10.0), (6.0, 10.0)]
    out = one(spark, S.transition_label("c", "p"), "c double, p double", rows)
    assert out == ["Remains", "More Depressed", "Remains", "Less Depressed"]
    codes = one(spark, S.label_code("l"), "l string", [("Remains",), ("More Depressed",), ("Less Depressed",), ("x",)])
    assert codes == [0, 1, 2, None]


def test_np_round_half_even(spark):
    assert one(spark, S.np_round("x", 1), "x double", [(0.25,), (0.35,), (1.05,)]) == [0.2, 0.4, 1.0]


def test_md5_int_has_60_bits(spark):
    assert one(spark, S.md5_int(F.col("t")), "t string", [("1:a:0",)]) == [int(hashlib.md5(b"1:a:0").hexdigest()[:15], 16)]


def test_argmax(spark):
    assert one(spark, S.argmax_index("a"), "a array<double>", [([1.0, 3.0, 3.0, 0.0],)]) == [1]
