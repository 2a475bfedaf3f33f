"""Prompts, answer parsing, chats and sources / sinks."""
import datetime as dt
import json
import os
import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitio.operators import prompts as PM
from transitio.session import scratch_dir
from transitio.sources import io as IO


def test_parse_answer(spark):
    rows = [("P", "P Label: Less Depressed"), ("P", "P Label: Remains. Label: More Depressed"), ("P", "P unsure")]
    df = spark.createDataFrame(rows, "p string, g string")
    label, parsed = PM.parse_answer("g", "p")
    out = df.select(label.alias("l"), parsed.alias("ok")).collect()
    assert [(r.l, r.ok) for r in out] == [("Less Depressed", True), ("Remains", True), ("Remains", False)]


def test_render_sequence_formats(spark):
    df = spark.createDataFrame([([57, None, 3], [0.3, None, float("inf")])], "a array<int>, b array<double>")
    r = df.select(PM.render_sequence("a", "int").alias("a"), PM.render_sequence("b").alias("b")).first()
    assert r.a == "57, NaN, 3" and r.b == "0.3, NaN, Inf"


def test_unknown_style_raises():
    import pytest
    with pytest.raises(ValueError):
        PM.style_column("Nope")
    assert PM.style_column("Health_Information") == "Health_Informtion"


def test_chat_render_fallback_template(spark):
    df = spark.createDataFrame([("hello", "Remains")], "data string, label string")
    ex = F.array(F.struct(F.lit("ex").alias("data"), F.lit("More Depressed").alias("label")))
    msgs = PM.chat_messages(F.col("data"), F.col("label"), ex, True)
    r = df.select(F.size(msgs).alias("n"), PM.render_chat(msgs).alias("t")).first()
    assert r.n == 6
    assert r.t.endswith("<start_of_turn>user\nhello<end_of_turn>\n<start_of_turn>model\nLabel: Remains\n<end_of_turn>\n"
                        "<start_of_turn>model\n")
    assert "<start_of_turn>model\nLabel: More Depressed\n<end_of_turn>\n" in r.t


def test_csv_roundtrip_quotes_and_newlines(spark):
    path = scratch_dir(spark, "t-csv")
    df = spark.createDataFrame([(1, 'say "hi",\nthen go', 2.5)], "user long, text string, x double")
    IO.write_csv(df, path)
    back = IO.read_csv(spark, path, df.schema).first()
    assert back.text == 'say "hi",\nthen go' and back.x == 2.5


def test_nested_json_top_level_array(spark):
    path = scratch_dir(spark, "t-json")
    os.makedirs(path)
    data = [{"user": 7, "gender": 1, "group": "patient", "age": 30,
             "data": [{"date_text": "2024-01-15", "PHQ_week2": 12.0, "magnitude_max": [0.3, "NaN", 1]}]}]
    with open(os.path.join(path, "users.json"), "w") as f:
        json.dump(data, f, indent=2)
    r = IO.read_nested_json(spark, path, ["magnitude_max"], top_level_array=True).first()
    assert r.user == 7 and r.date == dt.date(2024, 1, 15) and r.magnitude_max == [0.3, None, 1.0]


def test_restart_detection_from_files(spark):
    root = scratch_dir(spark, "t-results")
    def put(key, name, payload, t):
        d = os.path.join(root, f"feature={key}")
        os.makedirs(d, exist_ok=True)
        p = os.path.join(d, name)
        with open(p, "w") as f:
            f.write(payload)
        os.utime(p, (t, t))
    now = time.time()
    put("a", "old.json", json.dumps({"Accuracy": 0.5, "Macro F1": 0.4}), now - 100)
    put("a", "new.json", json.dumps({"Accuracy": 0.5}), now)                # newest lacks Macro F1
    put("b", "r.json", json.dumps({"Accuracy": 0.6, "Macro F1": 0.5}, indent=4), now)   # pretty-printed
    put("b", "r.csv", "Accuracy\n0.6\n", now + 50)
    put("d", "old.json", json.dumps({"Accuracy": 0.6, "Macro F1": 0.5}), now - 100)
    put("d", "new.json", "", now)                                              # the newest file is empty
    put("e", "r.json", '{"Accuracy": 0.6,', now)                               # broken
    manifest = IO.result_manifest(spark, root, ["feature"], ["Accuracy", "Macro F1"])
    assert manifest.count() == 7
    grid = spark.createDataFrame([(k,) for k in "abcde"], "feature string")
    pending = IO.pending_runs_latest_valid(grid, manifest.where("kind = 'json'"), ["feature"], "file_time", ["Accuracy", "Macro F1"])
    assert sorted(r.feature for r in pending.collect()) == ["a", "c", "d", "e"]
    assert sorted(r.feature for r in IO.pending_runs_both(grid, manifest, ["feature"]).collect()) == ["a", "c", "d", "e"]
    kinds = spark.createDataFrame([("a", "json"), ("b", "json"), ("b", "csv")], "feature string, kind string")
    assert sorted(r.feature for r in IO.pending_runs_both(grid, kinds, ["feature"]).collect()) == ["a", "c", "d", "e"]
