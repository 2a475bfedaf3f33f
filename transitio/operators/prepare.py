"""Model inputs: flat feature rows, coercion, scaling and label encoding
(P10, P11, F11, F17, A10, A11, K9-K12, K18, X4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitio.functions import scalar as S

# Flat column order: identity, then each feature block of ``length`` steps, then targets.
FLAT_FEATURE_ORDER = ("battery_afternoon", "magnitude_max", "screen_off_night_duration",
                      "screen_use_duration_afternoon")


def flatten_sequences(df: DataFrame, features=FLAT_FEATURE_ORDER, length: int = 14) -> list[Column]:
    """``<feature>_1..length`` columns; short arrays pad with NULL, long ones truncate
    (``get`` is NULL out of bounds, unlike ``element_at`` under ANSI)."""
    return [F.get(F.col(f), i).alias(f"{f}_{i + 1}") for f in features for i in range(length)]


def flat_feature_table(pairs: DataFrame, features=FLAT_FEATURE_ORDER, length: int = 14) -> DataFrame:
    """P10 + P11: forecast pairs (with survey columns) in the fixed column order."""
    return pairs.select(
        F.col("user").alias("user_id"), "gender", "group", "age",
        *flatten_sequences(pairs, features, length),
        F.col("phq9").alias("phq_week2"), F.col("future_phq9").alias("future_phq_week2"), "label")


def feature_prefixes(columns: list[str]) -> list[str]:
    """drop the last ``_``-part of each feature column, distinct in first-seen order
    (plan-time, on column names only)."""
    out: list[str] = []
    for c in columns:
        p = "_".join(c.split("_")[:-1])
        if p not in out:
            out.append(p)
    return out


def coerce_columns(df: DataFrame, cols: list[str], fill_after: bool) -> DataFrame:
    """F11 over several columns (tree path ``fill_after=False``, sequence path ``True``)."""
    return df.select(*[c for c in df.columns if c not in cols],
                     *[S.coerce_numeric(c, fill_after).alias(c) for c in cols])


def _one_row(stats: DataFrame) -> Column:
    """A single-row statistics frame as one struct-valued scalar subquery: computed once,
    inlined as a value into the row-level projection (no join)."""
    return stats.select(F.struct(*stats.columns).alias("s")).scalar()


def standard_stats(train: DataFrame, cols: list[str]) -> DataFrame:
    """A10: mean and population std per column over the training rows, ignoring NULLs;
    a zero std scales by 1."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"_mu_{c}"), F.stddev_pop(c).alias(f"_sd_{c}")]
    return train.agg(*aggs)


def standard_scale(df: DataFrame, stats: DataFrame, cols: list[str], digits: int | None = None) -> DataFrame:
    """(x - mean) / std with the training statistics (one scalar-subquery row, bound to one
    column, so the plan holds it once however many columns are scaled)."""
    df, kept = df.withColumn("_st", _one_row(stats)), df.columns
    st = F.col("_st")
    out = []
    for c in cols:
        sd = F.when(st[f"_sd_{c}"] == 0, F.lit(1.0)).otherwise(st[f"_sd_{c}"])
        z = (F.col(c) - st[f"_mu_{c}"]) / sd
        out.append((F.round(z, digits) if digits is not None else z).alias(c))
    return df.select(*[c for c in kept if c not in cols], *out)


def minmax_stats(train: DataFrame, arrays: list[str]) -> DataFrame:
    """Min and max of every element of each sequence column over all training rows
    (per feature across all time steps)."""
    aggs = []
    for a in arrays:
        aggs += [F.min(F.array_min(a)).alias(f"_mn_{a}"), F.max(F.array_max(a)).alias(f"_mx_{a}")]
    return train.agg(*aggs)


def minmax_scale(df: DataFrame, stats: DataFrame, arrays: list[str]) -> DataFrame:
    """(x - min) / (max - min), a zero range scales by 1; evaluation rows use the
    training statistics and are not clipped."""
    # Subqueries may not sit inside lambdas: bind the statistics to one column first.
    bound = df.withColumn("_st", _one_row(stats))
    st = F.col("_st")
    for a in arrays:
        rng = st[f"_mx_{a}"] - st[f"_mn_{a}"]
        bound = bound.withColumn(f"_lo_{a}", st[f"_mn_{a}"]) \
            .withColumn(f"_rng_{a}", F.when(rng == 0, F.lit(1.0)).otherwise(rng))
    def scaler(a: str):
        return lambda x: (x - F.col(f"_lo_{a}")) / F.col(f"_rng_{a}")
    out = [F.transform(a, scaler(a)).alias(a) for a in arrays]
    return bound.select(*[c for c in df.columns if c not in arrays], *out)


def sequence_matrix(prefixes: list[str], length: int = 14) -> Column:
    """Flat ``<prefix>_1..length`` columns -> time-major ``length x k`` matrix."""
    steps = []
    for t in range(length):
        steps.append(F.array(*[F.col(f"{p}_{t + 1}").cast("double") for p in prefixes]))
    return F.array(*steps)


def label_dictionary(frames: list[DataFrame], label: str) -> DataFrame:
    """Sorted distinct labels of the given frames as one row ``labels array<string>``
    (bounded by the number of classes)."""
    u = frames[0].select(label)
    for f in frames[1:]:
        u = u.unionByName(f.select(label))
    return u.groupBy().agg(F.array_sort(F.collect_set(label)).alias("labels"))


def encode_labels(df: DataFrame, dictionary: DataFrame, label: str, name: str = "code") -> DataFrame:
    """K9: alphabetical code of the label (NULL when unseen)."""
    bound = df.withColumn("_pos", F.array_position(_one_row(dictionary)["labels"], F.col(label)))
    return bound.withColumn(name, F.when(F.col("_pos") > 0, (F.col("_pos") - 1).cast("int"))).drop("_pos")


def argmax_class(scores: Column | str) -> Column:
    """Index of the first maximum score."""
    return S.argmax_index(scores)
