"""Classification metrics as aggregates.

Everything derives from the confusion counts ``(keys..., y, yhat, n)``: one shuffle on the
experiment keys with map-side partial counts, then tiny per-label arithmetic. Labels are
strings; metrics per label are 0 where undefined (zero_division = 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _keys(keys) -> list[str]:
    return list(keys or [])


def confusion_counts(df: DataFrame, y: str, yhat: str, keys=None, n: str | None = None) -> DataFrame:
    """Non-zero confusion cells per experiment key; ``n`` names a column of already counted rows."""
    return df.groupBy(*_keys(keys), F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(
        (F.sum(n) if n else F.count(F.lit(1))).alias("n"))


def confusion_matrix(df: DataFrame, y: str, yhat: str, keys=None) -> DataFrame:
    """A4: every (true, predicted) cell over the union of labels present in y or yhat, zeros included.

    The label spine is built per key from the distinct labels (bounded by the number of
    classes, not by rows): ``collect_set`` on the already-aggregated cells, exploded twice.
    """
    k = _keys(keys)
    cells = confusion_counts(df, y, yhat, k)
    labels = cells.select(*k, F.explode(F.array("y", "yhat")).alias("label")).groupBy(*k).agg(
        F.array_sort(F.collect_set("label")).alias("labels"))
    spine = labels.select(*k, F.explode("labels").alias("y"), "labels") \
        .select(*k, "y", F.explode("labels").alias("yhat"))
    return spine.join(cells, k + ["y", "yhat"], "left").select(
        *k, F.col("y").alias("true_label"), F.col("yhat").alias("pred_label"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def per_label(df: DataFrame, y: str, yhat: str, keys=None, n: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support per label present in y or yhat."""
    k = _keys(keys)
    cells = confusion_counts(df, y, yhat, k, n)
    sides = cells.select(*k, F.explode(F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).cast("bigint").alias("tp")),
        F.struct(F.col("yhat").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
    )).alias("s")).select(*k, "s.*")
    agg = sides.groupBy(*k, "label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                                          F.sum("tp").alias("tp"))
    return agg.select(
        *k, "label",
        F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0).alias("precision"),
        F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0).alias("recall"),
        F.when(F.col("support") + F.col("predicted") > 0,
               2.0 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(0.0).alias("f1"),
        F.col("support").cast("bigint").alias("support"), F.col("tp").cast("bigint").alias("tp"))


def metrics(df: DataFrame, y: str, yhat: str, keys=None, digits: int = 10, n: str | None = None) -> DataFrame:
    """A5 + A7: accuracy, macro and support-weighted precision / recall / F1 per experiment key.
    Macro averages run over the labels present in y or yhat. Rounded to ``digits`` so the
    values do not depend on summation order."""
    k = _keys(keys)
    pl = per_label(df, y, yhat, k, n)
    total = F.sum("support")
    out = pl.groupBy(*k).agg(
        (F.sum("tp") / total).alias("accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("precision") * F.col("support")) / total).alias("weighted_precision"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("weighted_recall"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"),
        total.cast("bigint").alias("n"))
    names = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision",
             "weighted_recall", "weighted_f1"]
    return out.select(*k, *[F.round(c, digits).alias(c) for c in names], "n")


def report(df: DataFrame, y: str, yhat: str, labels: list[str], keys=None, digits: int = 10) -> DataFrame:
    """Report over a fixed label list plus 'accuracy', 'macro avg', 'weighted avg' rows.
    Macro here averages over all listed labels (absent ones count as 0), unlike A7."""
    user_keys = _keys(keys)
    # Without experiment keys, a constant key keeps every step an equi-join.
    k = user_keys or ["_all"]
    base = df if user_keys else df.withColumn("_all", F.lit(0))
    pl = per_label(base, y, yhat, k)
    fixed = F.array(*[F.lit(x) for x in labels])
    spine = pl.select(*k).distinct().select(*k, F.explode(fixed).alias("label"))
    rows = spine.join(pl, k + ["label"], "left").select(
        *k, F.col("label").alias("row"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")],
        F.coalesce("support", F.lit(0)).cast("bigint").alias("support"),
        F.coalesce("tp", F.lit(0)).cast("bigint").alias("tp"))
    # Supports and accuracy over the listed labels (they cover every present label).
    summary = rows.groupBy(*k).agg(
        (F.sum("tp") / F.sum("support")).alias("acc"), F.sum("support").alias("tot"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    extra = summary.select(*k, F.explode(F.array(
        F.struct(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"),
                 F.col("tot").cast("bigint").alias("support")),
        F.struct(F.lit("macro avg").alias("row"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("tot").cast("bigint").alias("support")),
        F.struct(F.lit("weighted avg").alias("row"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1"), F.col("tot").cast("bigint").alias("support")),
    )).alias("s")).select(*k, "s.*")
    out = rows.drop("tp").unionByName(extra)
    return out.select(*user_keys, "row", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")],
                      "support")


def class_counts(df: DataFrame, label: str, keys=None) -> DataFrame:
    """A3 + A12 + T3: rows per class, the mean class size and the number of classes."""
    k = _keys(keys)
    counts = df.groupBy(*k, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*k) if k else Window.partitionBy(F.lit(0))
    # Partitioned by the experiment key over already-aggregated class rows (a handful per key).
    return counts.select(*k, label, "n", F.avg("n").over(w).alias("mean_n"),
                         F.count(F.lit(1)).over(w).alias("n_classes"))


def best_run(runs: DataFrame, keys: list[str], score: str, ordinal: str) -> DataFrame:
    """Per key the run with the highest score; earlier ordinal wins ties, NULL scores
    (failed runs) never win unless nothing else exists."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(ordinal).asc())
    return runs.where(F.col(score).isNotNull()).withColumn("_rn", F.row_number().over(w)) \
        .where(F.col("_rn") == 1).drop("_rn")


def align_predictions(truth: DataFrame, predictions: DataFrame, key: str, predicted: str = "predicted") -> DataFrame:
    """Predictions joined to the true rows by row id; a true row without a prediction keeps NULL
    and ``answered`` false, a prediction without a true row is dropped."""
    p = predictions.select(key, F.col(predicted).alias("predicted"))
    return truth.join(p, key, "left").withColumn("answered", F.col("predicted").isNotNull())
