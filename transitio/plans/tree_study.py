"""The tree study: one stored table for all seeds, all fits of a search grown together.

``study_table`` prepares every seed in one plan: subjects are split in two stages, the train side is
oversampled and dealt to folds, labels get their codes. Ids, sides and draws are narrow and stored on
the way; the features join once at the end. Feature sets are column masks over that table, and grid
cells, folds, seeds and sets are fits of ``operators.trees``, not jobs of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitio.operators import evaluate as EV
from transitio.operators import prepare as PP
from transitio.operators import sampling as SM
from transitio.operators import trees as TR
from transitio.operators.skew import balanced_join
from transitio.plans.study import SCORES, _grid
from transitio.session import ensure_checkpoint_dir, materialize

FOLDS = 3
#: Trees of unlimited depth stop here; a deeper one would need that many splits on one path.
UNLIMITED = 64
#: Binned rows per partition of the table that every level reads.
ROWS_PER_PART = 100_000

# The search grids of the tree models.
GRIDS: dict[str, dict[str, list]] = {
    "gradient_boosting": {"n_estimators": [50, 100, 200], "max_depth": [3, 4, 5, 6], "learning_rate": [0.1, 0.05, 0.01],
                          "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0]},
    "random_forest": {"n_estimators": [50, 100, 200], "max_depth": [5, 10, 15, None], "min_samples_split": [2, 5, 10],
                      "min_samples_leaf": [1, 2, 4]},
}


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Parquet in the shared checkpoint folder; columns that a reader doesn't need stay there."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def study_table(data: DataFrame, cols: list[str], seeds: list[int], row_id: str, subject: str, label: str,
                split: Callable[[DataFrame], DataFrame] | None = None, keep: bool = True) -> DataFrame:
    """random_seed, row (id, drawn rows ``id#draw``), draw, side, fold, code, ``row_id`` and ``cols`` (coerced).

    Train and eval rows of every seed. ``fold`` is 0 to FOLDS - 1 on the train side (balanced within each
    label, drawn rows are rows of their own) and TR.EVAL on the eval side; ``code`` is the alphabetical
    code of the label among the seed's train and eval labels. ``split`` adds ``side`` to (random_seed,
    row_id, subject, label); by default subjects are split in two stages per seed. ``data`` is read twice
    and stored for that, unless ``keep`` is false (a plain scan). Columns given as float stay float.
    """
    data = data.select(row_id, subject, label, *cols)
    data = _stored(data, "study-data") if keep else data
    single = [c for c, kind in data.dtypes if kind == "float" and c in cols]
    key = ["random_seed"]
    rows = SM.seeds_frame(data.select(row_id, subject, label), seeds, key[0])
    sides = split(rows) if split else SM.two_stage_split(rows, subject, key[0], keys=key, row_id=row_id)
    sides = materialize(sides.where("side IN ('train', 'eval')").select(*key, row_id, label, "side"))
    # at most one row per seed of the parameter list, the labels of a seed are its classes
    codes = sides.groupBy(*key).agg(F.array_sort(F.collect_set(label)).alias("_labels"))
    codes = codes.select(*key, F.posexplode("_labels").alias("code", label))
    seed = F.col(key[0])
    train = SM.oversample(sides.where("side = 'train'"), label, row_id, seed, keys=key)
    name = F.col(row_id).cast("string")
    train = train.withColumn("row", F.when(F.col("copy") == 0, name).otherwise(F.concat_ws("#", name, F.col("draw")))).drop("copy")
    train = SM.dense_index(materialize(train), [*key, label], SM.seeded_md5(seed * 42, "row"), "row") \
        .withColumn("fold", (F.col("pos") % FOLDS).cast("int")).drop("pos")
    rest = sides.where("side = 'eval'").withColumn("draw", F.lit(0).cast("bigint")).withColumn("row", name) \
        .withColumn("fold", F.lit(TR.EVAL))
    out = balanced_join(train.unionByName(rest), codes, [*key, label], F.struct("row"), "inner")
    features = PP.coerce_columns(data.select(row_id, *cols).withColumns({c: F.col(c).cast("double") for c in single}), cols, fill_after=False)
    features = features.withColumns({c: F.col(c).cast("float") for c in single})
    out = balanced_join(out, features, [row_id], F.struct("random_seed", "draw"), "inner")
    return _stored(out.select(*key, row_id, "row", "draw", "side", "fold", "code", label, *cols), "study-rows")


def scaled(table: DataFrame, cols: list[str]) -> DataFrame:
    """K10 per seed: every column by the mean and population std of the seed's (oversampled) train side."""
    aggs = [a for c in cols for a in (F.avg(c).alias(f"_mu_{c}"), F.stddev_pop(c).alias(f"_sd_{c}"))]
    per_seed = table.where("side = 'train'").groupBy("random_seed").agg(*aggs)
    joined = balanced_join(table, per_seed, ["random_seed"], F.struct("row"), "inner")
    z = [((F.col(c) - F.col(f"_mu_{c}")) / F.when(F.col(f"_sd_{c}") == 0, 1.0).otherwise(F.col(f"_sd_{c}"))).alias(c) for c in cols]
    return joined.select(*[c for c in table.columns if c not in cols], *z)


def _fits(kind: str, grid: dict[str, list], seeds: list[int], sets: dict[str, list[int]]) -> list[tuple[TR.Fit, dict, str]]:
    """The fits that a grid needs, with the parameters they stand for and their feature set. Cells that
    differ in what a finished model can answer (number of trees, depth limit and least split size of
    forests; number of rounds of boosted trees) share a fit."""
    out = []
    for seed, (name, columns), held in product(seeds, sets.items(), [*range(FOLDS), TR.EVAL]):
        if kind == "random_forest":
            for leaf in grid["min_samples_leaf"]:
                out.append((TR.Fit(seed, held, tuple(columns), 42 * seed, min_leaf=leaf), {"min_samples_leaf": leaf}, name))
        else:
            for depth, rate, sub, col in product(*[grid[k] for k in ("max_depth", "learning_rate", "subsample", "colsample_bytree")]):
                out.append((TR.Fit(seed, held, tuple(columns), 42 * seed, depth=depth, rate=rate, subsample=sub, colsample=col),
                            {"max_depth": depth, "learning_rate": rate, "subsample": sub, "colsample_bytree": col}, name))
    return out


def _counts(rows: DataFrame, width: int, classes: int, kind: str, grid: dict[str, list], seeds: list[int],
            sets: dict[str, list[int]]) -> DataFrame:
    """(random_seed, feature_set, ordinal, params, held, y, yhat, n) of every cell of the grid and fold."""
    wanted = _fits(kind, grid, seeds, sets)
    fits = [f for f, _, _ in wanted]
    if kind == "random_forest":
        depths = [d if d is not None else UNLIMITED for d in grid["max_depth"]]
        blocks = TR.grow_forests(rows, width, classes, fits, max(grid["n_estimators"]), max(depths), min(grid["min_samples_split"]))
        counts = TR.score_forests(blocks, width, classes, grid["n_estimators"], depths, grid["min_samples_split"])
        order, answer = TR.in_order(blocks), ["size", "depth", "min_split"]
    else:
        models = TR.boost(rows, width, classes, fits, max(grid["n_estimators"]), _stored)
        counts = TR.score_boosted(rows, models, width, classes, grid["n_estimators"])
        order, answer = TR.in_order([b for b, _ in models]), ["size"]
    # which answer of which fit is which cell: a table of the size of the search, no rows of data
    cells, meaning = [], {f: (params, name) for f, params, name in wanted}
    for number, f in enumerate(order):
        params, name = meaning[f]
        for ordinal, cell in enumerate(_grid(grid)):
            if all(cell[k] == v for k, v in params.items()):
                limit = cell["max_depth"] if cell["max_depth"] is not None else UNLIMITED
                where = (cell["n_estimators"], limit, cell["min_samples_split"]) if kind == "random_forest" else (cell["n_estimators"],)
                cells.append((number, *where, f.key, name, ordinal, repr(cell)))
    schema = "fit int, " + ", ".join(f"{c} int" for c in answer) + ", random_seed int, feature_set string, ordinal int, params string"
    table = counts.sparkSession.createDataFrame(cells, schema)
    return counts.join(F.broadcast(table), ["fit", *answer]).select(
        "random_seed", "feature_set", F.lit(kind).alias("model"), "ordinal", "params", "held",
        F.col("y").cast("string").alias("y"), F.col("yhat").cast("string").alias("yhat"), "n")


def search(table: DataFrame, feature_sets: dict[str, list[str]], models: dict[str, dict[str, list]] | None,
           seeds: list[int], prefix: str = "tree") -> DataFrame:
    """K13 / K14 searches: random_seed, feature_set, model, ordinal, params, held, metrics of every grid cell on
    each held-out fold (held >= 0) and, trained on the whole train side, on the eval side (held = TR.EVAL)."""
    cols = list(dict.fromkeys(c for cs in feature_sets.values() for c in cs))
    sets = {name: [cols.index(c) for c in cs] for name, cs in feature_sets.items()}
    classes = (table.agg(F.max("code")).first()[0] or 0) + 1
    # scaling is monotone per column, so trees are grown on bins of the unscaled values
    n, cores = table.count(), table.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // ROWS_PER_PART), min(cores, n // 16))
    edges = TR.bin_edges(table.where(F.col("fold") != TR.EVAL), cols)
    rows = _stored(TR.binned(table.select(F.col("random_seed").alias("key"), F.xxhash64("row").alias("row"), F.col("code").alias("y"),
                                          "fold", *cols), cols, edges).repartition(parts, "row"), f"{prefix}-bins")
    counts = None
    for kind, grid in (models or GRIDS).items():
        one = _counts(rows, len(cols), classes, kind, grid, seeds, sets)
        counts = one if counts is None else counts.unionByName(one)
    counts = _stored(counts, f"{prefix}-counts")
    return EV.metrics(counts, "y", "yhat", ["random_seed", "feature_set", "model", "ordinal", "params", "held"], n="n")


def run(table: DataFrame, feature_sets: dict[str, list[str]], models: dict[str, dict[str, list]] | None, seeds: list[int]) -> DataFrame:
    """K15 + X5 + W7: one row per (seed, feature set, model): the grid cell of the best mean macro F1 over the
    folds (the earlier cell on ties), its parameters and its scores on the eval side; NULL where a
    seed has no train or eval rows. ``models`` None searches the full GRIDS."""
    cells = materialize(search(table, feature_sets, models, seeds))
    key = ["random_seed", "feature_set", "model"]
    mean = cells.where(F.col("held") != TR.EVAL).groupBy(*key, "ordinal", "params").agg(F.round(F.avg("macro_f1"), 9).alias("cv_macro_f1"))
    best = EV.best_run(mean, key, "cv_macro_f1", "ordinal")
    final = cells.where(F.col("held") == TR.EVAL).select(*key, "ordinal", *SCORES)
    kinds = list((models or GRIDS))
    wanted = [(s, n, len(c), m) for s in seeds for n, c in feature_sets.items() for m in kinds]
    spine = table.sparkSession.createDataFrame(wanted, "random_seed int, feature_set string, num_features int, model string")
    return spine.join(best, key, "left").join(final, [*key, "ordinal"], "left").select(
        "random_seed", "model", "feature_set", "num_features", *SCORES, F.col("params").alias("best_params"), "cv_macro_f1")
