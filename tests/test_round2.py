"""Whole ranges, duplicates, draws and hot keys."""
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from transitio.operators import pairs as PA
from transitio.operators import sampling as SM
from transitio.operators import sequences as SQ
from transitio.sources import testdata as TD


def test_assessments_cover_the_whole_range_of_the_events(spark):
    start = dt.datetime(2024, 3, 5)
    rows = [(u, start + dt.timedelta(days=d, hours=9), "view", 50.0, '{"k": 1}') for u in (1, 2) for d in range(200)]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_type string, value double, props string")
    got = TD.phq(events).where("user = 1").orderBy("idx").collect()
    assert [r.date for r in got] == [start.date() + dt.timedelta(days=14 * k) for k in range(15)]
    assert got[-1].phq9 == 14.0 and TD.panel_range(events) == (start.date(), 200)
    assert TD.phq(events.limit(0)).count() == 0


def test_a_duplicated_day_keeps_its_first_row(spark):
    anchor = dt.date(2024, 1, 29)
    days = [anchor - dt.timedelta(days=k) for k in range(14)]
    rows = [(1, d, 10.0, 20.0, 30.0, 40.0, 4.0, 1) for d in days] + [(1, days[0], 0.0, 0.0, 99.0, 0.0, 1.0, 2)]
    bat = spark.createDataFrame(rows, "user long, date date, battery_night double, battery_morning double, battery_afternoon double, "
                                      "battery_evening double, battery_std_morning double, file_order int")
    phq = spark.createDataFrame([(1, anchor, 2, 5.0)], "user long, date date, idx int, phq9 double")
    rec = SQ.build_records(phq, {"battery": bat}, ["battery_afternoon"]).collect()
    assert len(rec) == 1 and rec[0].battery_afternoon == [30] * 14 and rec[0].n_missing == 0


def test_history_sums_at_the_scale_of_the_values(spark):
    rows = [(1, dt.date(2024, 1, 15), 2, 1.0, [0.25, 0.25]), (1, dt.date(2024, 1, 29), 3, 1.0, [1.0])]
    df = spark.createDataFrame(rows, "user long, date date, idx int, phq9 double, x array<double>")
    assert [r.hist_x for r in PA.history_average(df, ["x"]).orderBy("date").collect()] == [None, 0.2]


def test_drawn_rows_have_an_identity(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(100)], "id long, label string")
    out = SM.oversample(df, "label", "id")
    assert out.count() == 150 and out.select("id", "copy", "draw").distinct().count() == 150


@pytest.mark.parametrize("name", ["group_split", "two_stage_split", "few_shot_pairs", "oversample"])
def test_no_rows_are_dealt_by_a_low_cardinality_key_alone(spark, name):
    from __spark_entry__ import queries
    plan = queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for line in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan):
        keys = [re.sub(r"#\d+L?", "", k).strip() for k in line.split(",")[:-1]]
        assert keys not in (["lang"], ["source"]) or "count" in plan, keys


def test_two_stage_split_gives_each_group_one_side(spark):
    df = spark.createDataFrame([(i, f"g{i % 50}") for i in range(1000)], "id long, g string")
    out = SM.two_stage_split(df, "g")
    assert out.count() == 1000 and out.groupBy("g").agg(F.countDistinct("side").alias("n")).where("n > 1").count() == 0
    sides = {r.side: r.n for r in out.groupBy("side").agg(F.countDistinct("g").alias("n")).collect()}
    assert sides == {"test": 20, "eval": 15, "train": 15}
