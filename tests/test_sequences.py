"""Records, gate, mask, pairs and history on hand-built panels."""
import datetime as dt

from pyspark.sql import functions as F

from transitio.operators import pairs as PR
from transitio.operators import sequences as SQ

D0 = dt.date(2024, 1, 1)


def _battery(spark, rows):
    return spark.createDataFrame(
        rows, "user long, date date, battery_night double, battery_morning double, battery_afternoon double, "
              "battery_evening double, battery_std_morning double")


def _screen(spark, rows):
    cols = ", ".join(f"screen_{k}_{e} double" for k in ("off", "use") for e in ("night", "morning", "afternoon", "evening"))
    return spark.createDataFrame(rows, f"user long, date date, {cols}")


def test_gate_keeps_7_missing_and_drops_8(spark):
    anchor = D0 + dt.timedelta(days=20)
    days = [anchor - dt.timedelta(days=i) for i in range(14)]
    bat7 = [(1, d, 50.0, 50.0, 50.0, 50.0, 1.0) for d in days[:7]]
    bat6 = [(2, d, 50.0, 50.0, 50.0, 50.0, 1.0) for d in days[:6]]
    tables = {"battery": _battery(spark, bat7 + bat6)}
    phq = spark.createDataFrame([(1, anchor, 2, 5.0), (2, anchor, 2, 5.0)], "user long, date date, idx int, phq9 double")
    rec = SQ.build_records(phq, tables, [], 14, gate=False).select("user", "n_missing").orderBy("user").collect()
    assert [(r.user, r.n_missing) for r in rec] == [(1, 7), (2, 8)]
    kept = SQ.build_records(phq, tables, [], 14).select("user").collect()
    assert [r.user for r in kept] == [1]


def test_zero_mean_masks_all_sensors_but_absent_day_does_not(spark):
    anchor = D0 + dt.timedelta(days=13)
    masked_day, absent_day = D0, D0 + dt.timedelta(days=1)
    bat = [(1, masked_day, 1.0, 1.0, 1.0, 0.0, 1.0)] + \
          [(1, D0 + dt.timedelta(days=i), 60.0, 60.0, 60.0, 60.0, 1.0) for i in range(2, 14)]
    scr = [(1, masked_day, 3600.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
           (1, absent_day, 7200.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    tables = {"battery": _battery(spark, bat), "screen": _screen(spark, scr)}
    phq = spark.createDataFrame([(1, anchor, 2, 5.0)], "user long, date date, idx int, phq9 double")
    r = SQ.build_records(phq, tables, ["battery_afternoon", "screen_off_night_duration"], 14).first()
    assert r.n_missing == 2
    assert r.battery_afternoon[0] is None and r.battery_afternoon[1] is None and r.battery_afternoon[2] == 60
    assert r.screen_off_night_duration[0] is None and r.screen_off_night_duration[1] == 2.0


def test_valid_assessments_null_idx_kept(spark):
    phq = spark.createDataFrame([(1, D0, 1, 5.0), (1, D0, 2, None), (1, D0, None, 4.0)],
                                "user long, date date, idx int, phq9 double")
    out = SQ.valid_assessments(phq).collect()
    assert len(out) == 1 and out[0].idx is None


def _records(spark, rows):
    return spark.createDataFrame(rows, "user long, date date, idx int, phq9 double, x array<double>")


def test_adjacent_pairs_need_exact_period_after_gate(spark):
    d = lambda n: D0 + dt.timedelta(days=n)
    rec = _records(spark, [(1, d(0), 1, 5.0, [1.0]), (1, d(14), 2, 12.0, [1.0]), (1, d(35), 3, 12.0, [1.0]),
                           (1, d(49), 4, 2.0, [1.0])])
    out = PR.adjacent_pairs(rec, ["x"], 14).select("prev_date", "date", "label").orderBy("date").collect()
    assert [(r.prev_date, r.date, r.label) for r in out] == [(d(0), d(14), "More Depressed"), (d(35), d(49), "Less Depressed")]
    gated = _records(spark, [(1, d(0), 1, 5.0, [1.0]), (1, d(28), 3, 12.0, [1.0])])
    assert PR.adjacent_pairs(gated, ["x"], 14).count() == 0


def test_forecast_vs_nowcast(spark):
    d = lambda n: D0 + dt.timedelta(days=n)
    rec = _records(spark, [(1, d(0), 1, 5.0, [1.0]), (1, d(14), 2, 12.0, [1.0]), (1, d(28), 3, 12.0, [1.0])])
    f = PR.forecast_pairs(rec, 14).orderBy("date").select("date", "label").collect()
    assert [(r.date, r.label) for r in f] == [(d(0), "More Depressed"), (d(14), "Remains")]
    n = PR.adjacent_pairs(rec, ["x"], 14).orderBy("date").select("date", "label").collect()
    assert [(r.date, r.label) for r in n] == [(d(14), "More Depressed"), (d(28), "Remains")]


def test_history_average_over_all_earlier_records(spark):
    d = lambda n: D0 + dt.timedelta(days=n)
    rec = _records(spark, [(1, d(0), 1, 5.0, [1.0, None]), (1, d(14), 2, 5.0, [3.0]), (1, d(28), 3, 5.0, [9.0])])
    h = PR.history_average(rec, ["x"]).orderBy("date").select("hist_x").collect()
    assert [r.hist_x for r in h] == [None, 1.0, 2.0]


def test_first_per_key_keeps_file_order(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "user long, file_order int, v string")
    out = SQ.first_per_key(df, ["user"], ["file_order"]).orderBy("user").select("v").collect()
    assert [r.v for r in out] == ["a", "c"]
