"""Run outputs published whole, restart detection by them, scoring that goes on where it stopped."""
import datetime as dt
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitio.operators import sampling as SM
from transitio.plans import study as ST
from transitio.session import scratch_dir
from transitio.sources import runs as RU

KEYS = ["feature", "shot"]
KEY_TYPES = T.StructType([T.StructField("feature", T.StringType()), T.StructField("shot", T.IntegerType())])
METRICS = T.StructType([T.StructField("Accuracy", T.DoubleType()), T.StructField("Macro F1", T.DoubleType()), *KEY_TYPES.fields])
ROWS = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), *KEY_TYPES.fields])


def _rows(spark, keys):
    data = [(i, f'say "{i}",\nthen go', f, s) for f, s in keys for i in range(3)]
    return spark.createDataFrame(data, ROWS), spark.createDataFrame([(0.5, 0.25, f, s) for f, s in keys], METRICS)


def _pending(df):
    return sorted((tuple(r) for r in df.select(*KEYS).collect()), key=str)


def test_nothing_published_leaves_all_pending(spark):
    path = scratch_dir(spark, "t-runs")
    grid = spark.createDataFrame([("a", 1), (None, 1)], KEY_TYPES)
    none = RU.published(spark, path, KEY_TYPES)
    last = RU.newest(none, KEYS)
    assert _pending(RU.pending_published(grid, none, KEYS)) == [("a", 1), (None, 1)]
    assert RU.read_scored(spark, path, ROWS, last, KEYS).count() == 0
    assert _pending(RU.pending_newest_valid(grid, last, RU.read_evaluation(spark, path, METRICS, last, KEYS), KEYS, ["Accuracy"])) \
        == [("a", 1), (None, 1)]


def test_published_together_or_not_at_all(spark):
    path = scratch_dir(spark, "t-runs")
    at = dt.datetime(2024, 1, 1)
    scored, metrics = _rows(spark, [("a", 1), ("b", 1), (None, 0), ("", 5)])
    RU.write_run(scored, metrics, path, KEYS, "one", at)
    broken = metrics.where("feature = 'a'").withColumn("Accuracy", F.raise_error(F.lit("stopped")).cast("double"))
    with pytest.raises(Exception, match="stopped"):  # after the scored rows, before the metrics
        RU.write_run(_rows(spark, [("a", 1), ("c", 1)])[0], broken, path, KEYS, "two", at + dt.timedelta(1))
    RU.write_run(scored.where("feature = 'b'"), metrics.where("feature = 'b'").drop("Macro F1"), path, KEYS, "three", at)  # tied time
    RU.write_run(_rows(spark, [("d", 1)])[0], metrics.where("false"), path, KEYS, "four", at)  # scored only
    grid = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1), (None, 0), (None, 5)], KEY_TYPES)
    attempts = RU.published(spark, path, KEY_TYPES)
    assert attempts.select("attempt").distinct().count() == 3
    assert _pending(RU.pending_published(grid, attempts, KEYS)) == [("c", 1), ("d", 1)]
    last = RU.newest(attempts, KEYS)
    assert {(r.feature, r.shot): r.attempt for r in last.collect()} == \
        {("a", 1): "one", ("b", 1): "three", ("d", 1): "four", (None, 0): "one", (None, 5): "one"}
    got = RU.read_evaluation(spark, path, METRICS, last, KEYS)
    assert _pending(RU.pending_newest_valid(grid, last, got, KEYS, ["Accuracy", "Macro F1"])) == [("b", 1), ("c", 1), ("d", 1)]
    back = RU.read_scored(spark, path, ROWS, last, KEYS)
    assert back.count() == 15 and {r.text for r in back.collect()} == {f'say "{i}",\nthen go' for i in range(3)}


def test_broken_evaluation_file_is_pending(spark):
    path = scratch_dir(spark, "t-runs")
    scored, metrics = _rows(spark, [("a", 1), ("b", 1)])
    RU.write_run(scored, metrics, path, KEYS, "one")
    folder = f"{path}/evaluation/attempt=one/feature=a/shot=1"
    for name in os.listdir(folder):
        os.remove(f"{folder}/{name}") if name.endswith(".crc") else open(f"{folder}/{name}", "w").write('{"Accuracy": 0.5,')
    last = RU.newest(RU.published(spark, path, KEY_TYPES), KEYS)
    got = RU.read_evaluation(spark, path, METRICS, last, KEYS)
    grid = spark.createDataFrame([("a", 1), ("b", 1)], KEY_TYPES)
    assert _pending(RU.pending_newest_valid(grid, last, got, KEYS, ["Accuracy", "Macro F1"])) == [("a", 1)]


def test_stop_and_restart_scores_each_row_once(spark, tmp_path):
    log, go = str(tmp_path / "log"), str(tmp_path / "go")

    def factory():
        def predict(prompts: pd.Series) -> pd.Series:
            if not os.path.exists(go) and (prompts == "p 17 ").any():
                raise RuntimeError("stopped")
            with open(log, "a") as f:
                f.writelines(p + "\n" for p in prompts)
            return prompts + "Label: More Depressed"
        return predict

    rows = [(i, f"p {i} ", "x") for i in range(40)] + [(3, "p 3 ", "again"), (None, "p none ", "x"), (50, None, "x")]
    df = spark.createDataFrame(rows, "id long, prompt string, note string")
    path = scratch_dir(spark, "t-answers")
    with pytest.raises(Exception, match="stopped"):
        ST.score_resumable(df, ["id"], "prompt", factory, path, slices=8)
    kept = {r.id for r in spark.read.parquet(f"{path}/answers").collect()} if os.path.isdir(f"{path}/answers") else set()
    before = open(log).read().splitlines() if os.path.exists(log) else []
    open(go, "w").close()
    out = ST.score_resumable(df, ["id"], "prompt", factory, path, slices=8).collect()
    after = open(log).read().splitlines()[len(before):]
    assert not kept & {int(p.split()[1]) for p in after if p.startswith("p ")}  # what was kept is not scored again
    assert sorted(r.id for r in spark.read.parquet(f"{path}/answers").collect()) == [*range(40), 50]
    assert len(out) == 43 and all((r.predicted, r.parsed) == ("More Depressed", True) for r in out if r.id is not None)
    assert [(r.predicted, r.parsed) for r in out if r.id is None] == [("Remains", False)]
    n = len(open(log).read().splitlines())
    ST.score_resumable(df, ["id"], "prompt", factory, path, slices=8)
    assert len(open(log).read().splitlines()) == n


def test_batches_keep_to_the_token_budget(spark):
    calls = []

    def predict(prompts):
        calls.append([len(p) // 4 + 1 for p in prompts])
        return prompts + "!"
    prompts = pd.Series(["x" * n for n in (400, 8, 0, 4000, 80, 80, 12)] + [None])
    assert ST._answers(predict, prompts, 100).tolist() == ["!"] * 8
    assert all(len(c) == 1 or max(c) * len(c) <= 100 for c in calls) and sum(map(len, calls)) == 8
    assert any(len(c) > 2 for c in calls) and ST._answers(predict, prompts.iloc[:0], 100).empty


def test_rows_without_a_candidate_are_reported(spark):
    pool = spark.createDataFrame([(1, "s", "a"), (2, "s", "b"), (3, "u", "same"), (4, "u", "same"), (5, None, "c")], "id long, st string, txt string")
    q = spark.createDataFrame([(9, "s", "z"), (10, None, "z"), (11, "absent", "z"), (12, "u", "same"), (13, "u", None)], "id long, st string, txt string")
    out = {}
    for r in SM.few_shot_positions(pool, q, "st", "txt", "id", "id", 3, 1).collect():
        out.setdefault(r.id, []).append((r.j, r.example_id, r.n_found))
    assert sorted(e for _, e, _ in out[9]) == [1, 2] and all(n == 2 for _, _, n in out[9])
    assert all(out[i] == [(None, None, 0)] for i in (10, 11, 12))
    assert sorted(e for _, e, _ in out[13]) == [3, 4]
