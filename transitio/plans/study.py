"""Experiment study: configurations, grids, summaries, rankings and model fits
(X2, X3, X5, A9, W6, T1, W7, K13-K17, K19).

Summaries and rankings are DataFrame plans over the results table. Model fits (MLlib) are
the only driver-side loop: one ``fit`` per grid cell and fold over a small grid, each a
distributed Spark job; their metrics come back as DataFrames and are unioned (X5).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitio.functions import scalar as S
from transitio.operators import evaluate as EV
from transitio.operators import prepare as PP
from transitio.operators import prompts as PM
from transitio.operators.sampling import oversample, stratified_folds
from transitio.session import materialize

#: Padded tokens of one predictor call.
BATCH_TOKENS = 16_384
METRICS = ("accuracy", "macro_f1", "weighted_f1", "macro_precision", "macro_recall")


def power_set_configs(features: list[str]) -> list[tuple[int, str, list[bool]]]:
    """The non-empty subsets in itertools.product([True, False]) order, with the
    ``_``-joined name in configuration order (plan-time enumeration of feature names)."""
    out = []
    for i, flags in enumerate(product([True, False], repeat=len(features))):
        if any(flags):
            out.append((i, "_".join(f for f, on in zip(features, flags) if on), list(flags)))
    return out


def config_array(features: list[str]) -> Column:
    """The configurations as an ``array<struct<config, feature_set, flags>>`` literal."""
    return F.array(*[F.struct(F.lit(i).alias("config"), F.lit(name).alias("feature_set"),
                              F.array(*[F.lit(b) for b in flags]).alias("flags"))
                     for i, name, flags in power_set_configs(features)])


def configuration_coverage(records: DataFrame, features: list[str]) -> DataFrame:
    """X2 over data: per configuration, the number of records and of present values its
    features contribute. Per-feature totals are aggregated first (one row), then the
    configurations are exploded from that row - no join with the record table."""
    valid = [F.sum(F.size(F.filter(f, lambda x: x.isNotNull()))).cast("bigint").alias(f"_n_{f}") for f in features]
    totals = records.agg(F.count(F.lit(1)).alias("n_records"), *valid)
    c = totals.select("*", F.explode(config_array(features)).alias("c"))
    n_values = sum((F.when(F.col("c.flags")[i], F.col(f"_n_{f}")).otherwise(F.lit(0))
                    for i, f in enumerate(features)), F.lit(0))
    n_feat = sum((F.col("c.flags")[i].cast("int") for i in range(len(features))), F.lit(0))
    return c.select(F.col("c.config").alias("config"), F.col("c.feature_set").alias("feature_set"),
                    n_feat.cast("int").alias("n_features"), n_values.cast("bigint").alias("n_values"),
                    F.col("n_records").cast("bigint").alias("n_records"))


def experiment_grid(cells: DataFrame, seeds: list[int], model_seed_factor: int = 42) -> DataFrame:
    """X3 + R7: every (model, feature_set) cell once per seed; split seed = seed,
    model seed = 42 * seed. Seeds are a parameter list exploded per cell (no cross join)."""
    return cells.select("model", "feature_set", F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("random_seed")) \
        .select("random_seed", "model", "feature_set", F.col("random_seed").alias("split_seed"),
                (F.col("random_seed") * model_seed_factor).alias("model_seed"))


def summarize(results: DataFrame, metrics=METRICS, digits: int = 4) -> DataFrame:
    """Mean and sample std of each metric per (model, feature_set), first num_features
    (constant per set, taken as min), rounded like pandas (half to even)."""
    aggs = []
    for m in metrics:
        aggs += [S.np_round(F.avg(m), digits).alias(f"{m}_mean"), S.np_round(F.stddev_samp(m), digits).alias(f"{m}_std")]
    return results.groupBy("model", "feature_set").agg(*aggs, F.min("num_features").alias("num_features_first"))


def top_performers(summary: DataFrame, n: int = 10) -> DataFrame:
    """Top n by mean macro F1; ties keep (model, feature_set) order, NULL scores last."""
    return summary.orderBy(F.col("macro_f1_mean").desc_nulls_last(), "model", "feature_set").limit(n)


def best_per_group(summary: DataFrame) -> DataFrame:
    """Best model per feature set and best feature set per model (first in
    (model, feature_set) order on ties)."""
    def best(group: str) -> DataFrame:
        w = Window.partitionBy(group).orderBy(F.col("macro_f1_mean").desc_nulls_last(), "model", "feature_set")
        return summary.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(
            F.lit(group).alias("group_kind"), F.col(group).alias("group_value"), "model", "feature_set",
            "macro_f1_mean", "accuracy_mean")
    return best("feature_set").unionByName(best("model"))


# ---------------------------------------------------------------- model fits
def _assemble(df: DataFrame, cols: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(df)


def _classifier(kind: str, params: dict, seed: int):
    from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
    if kind == "random_forest":
        return RandomForestClassifier(labelCol="y", featuresCol="features", seed=seed, **params)
    if kind == "gradient_boosting":
        # MLlib GBT is binary: one-vs-rest over the classes.
        return OneVsRest(classifier=GBTClassifier(labelCol="y", featuresCol="features", seed=seed, **params),
                         labelCol="y", featuresCol="features")
    raise ValueError(f"unknown model {kind!r}")


def _grid(params: dict[str, list]) -> list[dict]:
    keys = sorted(params)
    return [dict(zip(keys, vals)) for vals in product(*[params[k] for k in keys])]


def fit_and_score(train: DataFrame, test: DataFrame, cols: list[str], kind: str, params: dict,
                  seed: int) -> DataFrame:
    """One fit on ``train`` (columns ``cols``, numeric label ``y``), metrics on ``test``."""
    model = _classifier(kind, params, seed).fit(_assemble(train, cols))
    pred = model.transform(_assemble(test, cols)).select(
        F.col("y").cast("int").cast("string").alias("t"), F.col("prediction").cast("int").cast("string").alias("p"))
    return EV.metrics(pred, "t", "p")


def cross_validate(train: DataFrame, cols: list[str], kind: str, grid: dict[str, list], seed: int,
                   folds: int = 3) -> DataFrame:
    """K13/K14 search: each grid cell scored by mean macro F1 over stratified folds (R6);
    fold membership is a column, so each fold is a filter, not a copy."""
    # Fold membership is materialised once (reliable checkpoint) and reused by every fit.
    fdf = materialize(stratified_folds(train, "y", "row_id", seed, folds))
    rows = []
    for ordinal, params in enumerate(_grid(grid)):
        per_fold = [fit_and_score(fdf.where(F.col("fold") != k), fdf.where(F.col("fold") == k), cols, kind, params, seed)
                    .select("macro_f1") for k in range(folds)]
        u = per_fold[0]
        for p in per_fold[1:]:
            u = u.unionByName(p)
        rows.append(u.agg(F.avg("macro_f1").alias("score")).select(
            F.lit(ordinal).alias("ordinal"), F.lit(repr(params)).alias("params"), "score"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# The search grids of the tree models. MLlib has no minimum split size; its depth
# limit of 30 stands for an unlimited depth.
FULL_GRIDS: dict[str, dict[str, list]] = {
    "gradient_boosting": {"maxIter": [50, 100, 200], "maxDepth": [3, 4, 5, 6], "stepSize": [0.1, 0.05, 0.01],
                          "subsamplingRate": [0.8, 1.0], "featureSubsetStrategy": ["0.8", "all"]},
    "random_forest": {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 15, 30], "minInstancesPerNode": [1, 2, 4]},
}
SCORES = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1")


def study_inputs(data: DataFrame, cols: list[str], seed: int, split: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """The rows a study cell is fitted on: split, train side oversampled (R3, drawn rows get an id
    of their own), coerced (tree path) and scaled with the oversampled train side's statistics."""
    sp = split(data, seed)
    train = oversample(sp.where("side = 'train'").drop("side"), "y", "row_id", seed)
    train = train.withColumn("row_id", F.when(F.col("copy") == 0, F.col("row_id").cast("string"))
                             .otherwise(F.concat_ws("#", "row_id", "draw"))).drop("copy", "draw").withColumn("side", F.lit("train"))
    rest = sp.where("side <> 'train'").withColumn("row_id", F.col("row_id").cast("string"))
    prepared = PP.coerce_columns(materialize(train.unionByName(rest)), cols, fill_after=True)
    return PP.standard_scale(prepared, PP.standard_stats(prepared.where("side = 'train'"), cols), cols)


def run_study(data: DataFrame, feature_sets: dict[str, list[str]], models: dict[str, dict[str, list]] | None,
              seeds: list[int], split: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """K15 + X5 + W7: for each seed, feature set and model: prepare (``study_inputs``), grid search by
    CV macro F1, refit the best, score on the eval side. ``models`` None searches FULL_GRIDS.
    ``data`` has ``row_id``, numeric ``y`` and the feature columns; ``split(df, seed)`` adds ``side``
    in {'train', 'eval', ...}. Exactly one row per requested cell: a cell that can't be fitted has
    NULL scores and the error's text."""
    results = []
    for seed, (fs, cols) in product(seeds, feature_sets.items()):
        # Checkpointed once: every fit below reads it instead of re-running the upstream plan.
        scaled = materialize(study_inputs(data, cols, seed, split))
        train, ev = scaled.where("side = 'train'"), scaled.where("side = 'eval'")
        for kind, grid in (models or FULL_GRIDS).items():
            try:
                cells = cross_validate(train, cols, kind, grid, 42 * seed).collect()  # one row per grid cell
                best = min((r for r in cells if r["score"] is not None), key=lambda r: (-r["score"], r["ordinal"]))
                params, error = _grid(grid)[best["ordinal"]], None
                scores = fit_and_score(train, ev, cols, kind, params, 42 * seed).first()
                values = [float(scores[c]) if scores[c] is not None else None for c in SCORES]
            except Exception as exc:  # reported in the cell's row
                params, values, error = None, [None] * len(SCORES), f"{type(exc).__name__}: {str(exc)[:200]}"
            results.append((seed, kind, fs, len(cols), *values, repr(params) if params is not None else None, error))
    schema = ("random_seed int, model string, feature_set string, num_features int, " +
              ", ".join(f"{c} double" for c in SCORES) + ", best_params string, error string")
    return data.sparkSession.createDataFrame(results, schema)  # one row per cell


# ---------------------------------------------------------------- scoring hook (K16), stats
def _answers(predict: Callable[[pd.Series], pd.Series], prompts: pd.Series, budget: int) -> pd.Series:
    """What the predictor writes after each prompt. It gets batches of prompts of like length whose
    padded size (longest times number, a token taken as four characters) is within ``budget``; a longer prompt goes alone."""
    prompts = prompts.fillna("").reset_index(drop=True)
    size = prompts.str.len().to_numpy() // 4 + 1
    order, out, lo = np.argsort(size, kind="stable"), np.empty(len(prompts), dtype=object), 0
    while lo < len(order):
        padded = size[order[lo:]] * np.arange(1, len(order) - lo + 1)  # ascends: sizes are sorted
        hi = lo + max(1, int(np.searchsorted(padded, budget, side="right")))
        part = prompts.iloc[order[lo:hi]]
        texts = predict(part.reset_index(drop=True)).astype(str)
        out[order[lo:hi]] = [g[len(p):] for g, p in zip(texts, part)]
        lo = hi
    return pd.Series(out)


def generate(df: DataFrame, prompt: str, predictor_factory: Callable[[], Callable[[pd.Series], pd.Series]],
             keep: list[str], budget: int = BATCH_TOKENS) -> DataFrame:
    """(keep..., answer): the generated text after the prompt. The predictor is built once per partition
    and maps prompts to generated texts that begin with them; prompts stay in the task. A null prompt is empty."""
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["answer string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = predictor_factory()
        for pdf in batches:
            out = pdf[keep].reset_index(drop=True)
            out["answer"] = _answers(predict, pdf["_prompt"], budget)
            yield out

    return df.select(*keep, F.col(prompt).alias("_prompt")).mapInPandas(run, schema)


def parse_answers(df: DataFrame) -> DataFrame:
    """K8 in SQL: predicted and parsed in place of ``answer``."""
    label, parsed = PM.parse_answer("answer", "_none")
    return df.withColumn("_none", F.lit("")).select(*[c for c in df.columns if c != "answer"], label.alias("predicted"),
                                                    F.coalesce(parsed, F.lit(False)).alias("parsed"))


def score_prompts(df: DataFrame, prompt: str, predictor_factory: Callable[[], Callable[[pd.Series], pd.Series]],
                  keep: list[str], budget: int = BATCH_TOKENS) -> DataFrame:
    """The one Python surface, ``generate``; parsing stays in SQL (K8)."""
    return parse_answers(generate(df, prompt, predictor_factory, keep, budget))


def score_resumable(df: DataFrame, keys: list[str], prompt: str, predictor_factory: Callable[[], Callable[[pd.Series], pd.Series]],
                    path: str, slices: int = 16, budget: int = BATCH_TOKENS) -> DataFrame:
    """K16 for predictors that take hours: the answers are kept under ``path`` and found again.

    Rows whose key has an answer there are not scored (anti-join). The others are dealt by key hash to
    ``slices``, each one job over the whole cluster whose answers appear when it ends, so a run that
    breaks off loses at most the slice it was in. The prompts are shuffled and stored once, not per slice.

    Returns the columns of ``df`` but the prompt, with predicted and parsed. A key that repeats is
    scored once, by its smallest prompt, and all its rows get that answer; rows with a null in the key
    are not scored (the fallback label, parsed = false).
    """
    spark = df.sparkSession
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("answer", T.StringType())])
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/answers")
    kept = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
    todo = df.dropna(subset=keys).groupBy(*keys).agg(F.min(prompt).alias("_text"))
    if kept:
        todo = todo.join(spark.read.schema(schema).parquet(f"{path}/answers").select(*keys), keys, "left_anti")
    prompts = f"{path}/prompts-{uuid.uuid4().hex[:12]}"
    todo.withColumn("_slice", F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int")).write.partitionBy("_slice").parquet(prompts)
    stored = spark.read.schema(T.StructType([*[df.schema[k] for k in keys], T.StructField("_text", T.StringType()),
                                             T.StructField("_slice", T.IntegerType())])).parquet(prompts)
    for i in range(slices):  # jobs, not rows: their number is a parameter
        generate(stored.where(F.col("_slice") == i), "_text", predictor_factory, keys, budget).write.mode("append").parquet(f"{path}/answers")
    answers = spark.read.schema(schema).parquet(f"{path}/answers")
    return parse_answers(df.drop(prompt).join(answers, keys, "left"))


def fallback_predictor_factory() -> Callable[[pd.Series], pd.Series]:
    """Predictor used when no model is supplied: echoes the prompt and answers 'Remains'
    (the reference's fallback class)."""
    def predict(prompts: pd.Series) -> pd.Series:
        return prompts + "Label: Remains"
    return predict


def prompt_length_stats(prompts: DataFrame, styles: list[str]) -> DataFrame:
    """Characters and whitespace-separated words per prompt style (min / avg / max)."""
    long = prompts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("style"), F.col(s).alias("text"))
                                               for s in styles])).alias("p")).select("p.*")
    words = F.size(F.split(F.trim("text"), r"\s+"))
    long = long.select("style", F.length("text").alias("chars"), words.alias("words"))
    return long.groupBy("style").agg(
        F.min("chars").cast("bigint").alias("min_chars"), F.round(F.avg("chars"), 6).alias("avg_chars"),
        F.max("chars").cast("bigint").alias("max_chars"), F.min("words").cast("bigint").alias("min_words"),
        F.round(F.avg("words"), 6).alias("avg_words"), F.max("words").cast("bigint").alias("max_words"))
