"""Deterministic splits, resampling and few-shot selection.

Randomness is a seeded hash, so results do not depend on partitioning and all seeds can run
in one plan (the seed is a column). Three physical patterns:

* dense index - exact 0-based position in hash order within a stratum, computed with
  windows over (stratum, hash bucket) plus a prefix sum of bucket sizes, never a
  one-partition window;
* chunked draws - ``n`` draws per class are generated in bounded chunks, so no task
  explodes an unbounded count;
* systematic sampling - ``n`` distinct pool positions per row from an arithmetic
  progression that skips the row's own text block; an equi-join of N*n rows, not N^2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitio.functions.scalar import md5_int
from transitio.operators.skew import balanced_join
from transitio.session import materialize as checkpointed

BUCKET_HEX_DIGITS = 3  # 4096 hash buckets per stratum
DRAW_CHUNK = 1 << 16


def _seed_col(seed) -> Column:
    return seed if isinstance(seed, Column) else F.lit(str(seed))


def _spread(df: DataFrame, row_id: str | None, on: list[str]) -> Column:
    """What deals the rows of a hot key to parts: the row id, or else the short columns (never a whole text)."""
    if row_id:
        return F.struct(F.col(row_id))
    short = [f.name for f in df.schema.fields
             if f.name not in on and isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType))]
    return F.struct(*[F.col(f"`{c}`") for c in short or df.columns])


def seeded_md5(seed, *parts: Column | str) -> Column:
    items = [_seed_col(seed).cast("string")]
    for p in parts:
        items += [F.lit(":"), (F.col(p) if isinstance(p, str) else p).cast("string")]
    return F.md5(F.concat(*items))


def dense_index(df: DataFrame, strata: list[str], order_hash: Column, tiebreak: str,
                name: str = "pos", digits: int = BUCKET_HEX_DIGITS) -> DataFrame:
    """0-based position of each row within its stratum in (order_hash, tiebreak) order.

    Equals ``row_number() over (partition by strata order by order_hash, tiebreak) - 1``.
    A stratum holding a third of all rows is still spread over 16^digits window partitions;
    the prefix sums are over at most 16^digits bucket rows per stratum.
    """
    d = df.withColumn("_h", order_hash).withColumn("_b", F.substring("_h", 1, digits))
    w = Window.partitionBy(*strata, "_b").orderBy("_h", tiebreak)
    d = d.withColumn("_r", F.row_number().over(w) - 1)
    sizes = d.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_c"))
    ws = (Window.partitionBy(*strata) if strata else Window).orderBy("_b") \
        .rowsBetween(Window.unboundedPreceding, -1)  # over bucket rows: at most 16^digits per stratum
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_c").over(ws), F.lit(0))).drop("_c")
    out = d.join(offsets, strata + ["_b"], "inner")
    return out.withColumn(name, (F.col("_o") + F.col("_r")).cast("bigint")).drop("_h", "_b", "_r", "_o")


def weighted_offsets(df: DataFrame, strata: list[str], order_hash: str, weight: str, name: str,
                     digits: int = BUCKET_HEX_DIGITS) -> DataFrame:
    """Start position of each row when rows of ``weight`` units are laid out in ``order_hash``
    order within the stratum: the sum of the weights of all earlier rows. Same two-level
    scheme as ``dense_index`` (hash-prefix buckets, then a prefix sum over bucket totals)."""
    d = df.withColumn("_b", F.substring(order_hash, 1, digits))
    w = Window.partitionBy(*strata, "_b").orderBy(order_hash).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_r", F.coalesce(F.sum(weight).over(w), F.lit(0)))
    sizes = d.groupBy(*strata, "_b").agg(F.sum(weight).alias("_c"))
    ws = (Window.partitionBy(*strata) if strata else Window).orderBy("_b") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_c").over(ws), F.lit(0))).drop("_c")
    out = d.join(offsets, strata + ["_b"], "inner")
    return out.withColumn(name, (F.col("_o") + F.col("_r")).cast("bigint")).drop("_b", "_r", "_o")


def group_sides(df: DataFrame, group: str, seed, test_fraction: float = 0.4,
                keys: list[str] | None = None) -> DataFrame:
    """R1 on the distinct groups: ``ceil(test_fraction * G)`` groups in hash order go to test.

    Returns (keys..., group, is_test). ``keys`` (e.g. a seed column) split independently.
    """
    k = list(keys or [])
    groups = df.select(*k, group).distinct()
    seed_c = F.col(seed) if isinstance(seed, str) and seed in groups.columns else _seed_col(seed)
    idx = dense_index(groups, k, seeded_md5(seed_c, group), group)
    if k:
        n = groups.groupBy(*k).agg(F.count(F.lit(1)).alias("_g"))
        out = balanced_join(idx, n, k, F.struct(group), "inner", counts=n.withColumnRenamed("_g", "n"))
    else:
        # One global count: a scalar subquery evaluated once, not a join.
        out = idx.withColumn("_g", groups.agg(F.count(F.lit(1))).scalar())
    out = out.withColumn("is_test", F.col("pos") < F.ceil(F.col("_g") * F.lit(test_fraction)))
    return out.select(*k, group, "is_test")


def group_split(df: DataFrame, group: str, seed=1, test_fraction: float = 0.4,
                keys: list[str] | None = None, row_id: str | None = None) -> DataFrame:
    """R1 + J5: every row tagged 'train' or 'test' through its group's side (equi-join, large groups
    in parts by their measured size)."""
    on = list(keys or []) + [group]
    sides = group_sides(df, group, seed, test_fraction, keys)
    out = balanced_join(df, sides, on, _spread(df, row_id, on), "inner")
    return out.withColumn("side", F.when(F.col("is_test"), F.lit("test")).otherwise(F.lit("train"))).drop("is_test")


def two_stage_split(df: DataFrame, group: str, seed=1, test_fraction: float = 0.4, eval_fraction: float = 0.5,
                    keys: list[str] | None = None, row_id: str | None = None) -> DataFrame:
    """R2: test = ceil(0.4 G) groups; the rest is split again by group, ceil(0.5 G') to eval.
    All three sides are returned ('train', 'eval', 'test'); stage 2 uses a salted seed. ``keys``
    (e.g. the seed as a column, named by ``seed``) split independently."""
    k = list(keys or [])
    stage2 = F.concat(F.col(seed).cast("string"), F.lit(":stage2")) if seed in k else f"{seed}:stage2"
    # Both stages run on the distinct groups; the rows meet their side once.
    first = group_sides(df.select(*k, group).distinct(), group, seed, test_fraction, keys)
    second = group_sides(first.where(~F.col("is_test")).select(*k, group), group, stage2, eval_fraction, keys)
    second = second.select(*k, group, F.when(F.col("is_test"), F.lit("eval")).otherwise(F.lit("train")).alias("_s2"))
    sides = first.join(second, k + [group], "left").select(*k, group, F.coalesce("_s2", F.lit("test")).alias("side"))
    return balanced_join(df, sides, k + [group], _spread(df, row_id, k + [group]), "inner")


def chunked_range(df: DataFrame, count: str, name: str, chunk: int = DRAW_CHUNK) -> DataFrame:
    """Rows 0..count-1 for every input row, generated in chunks of at most ``chunk`` so a
    large count is spread over many tasks (chunk rows are hash-partitioned first)."""
    c = df.withColumn("_nc", F.ceil(F.col(count) / F.lit(chunk)).cast("int"))
    c = c.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_nc") - 1)))
    c = c.repartition("_chunk", *[x for x in df.columns if x != count][:1])
    lo = F.col("_chunk") * F.lit(chunk)
    hi = F.least(F.col(count), lo + F.lit(chunk)) - 1
    return c.withColumn(name, F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint")))).drop("_nc", "_chunk")


def oversample(train: DataFrame, label: str, row_id: str, seed=1, keys: list[str] | None = None) -> DataFrame:
    """R3 + X1: for each class with fewer rows than the mean class size, append ``int(mean)``
    rows drawn with replacement: draw j takes position hash(seed:class:j) mod count of the
    class, joined to the class's dense index. Adds ``copy`` (0 original, 1 drawn) and ``draw`` (0, or
    the draw's number from 1 within its class), so (row id, copy, draw) identifies a row."""
    k = list(keys or [])
    counts = train.groupBy(*k, label).agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*k) if k else Window.partitionBy(F.lit(0))  # over class rows only
    counts = counts.withColumn("_mean", F.avg("_cnt").over(w))
    need = counts.where(F.col("_cnt") < F.col("_mean")).withColumn("_n", F.floor("_mean").cast("bigint"))
    draws = chunked_range(need.select(*k, label, "_cnt", "_n"), "_n", "_j")
    seed_c = _seed_col(seed)
    draws = draws.withColumn("pos", F.pmod(md5_int(F.concat(seed_c.cast("string"), F.lit(":"),
                                                            F.col(label).cast("string"), F.lit(":"),
                                                            F.col("_j").cast("string"))), F.col("_cnt")))
    indexed = dense_index(train, k + [label], seeded_md5(seed_c, row_id), row_id)
    drawn = draws.select(*k, label, "pos", (F.col("_j") + 1).alias("draw")).join(indexed, k + [label, "pos"], "inner").drop("pos")
    originals = train.withColumn("copy", F.lit(0)).withColumn("draw", F.lit(0).cast("bigint"))
    return originals.unionByName(drawn.withColumn("copy", F.lit(1)))


def holdout_split(df: DataFrame, row_id: str, seed=1, fraction: float = 0.2) -> DataFrame:
    """Rows permuted by hash; the first int(fraction * n) are validation."""
    idx = dense_index(df, [], seeded_md5(seed, row_id), row_id)
    n = df.agg(F.count(F.lit(1))).scalar()  # scalar subquery, evaluated once
    out = idx.withColumn("side", F.when(F.col("pos") < F.floor(n * F.lit(fraction)), F.lit("validation"))
                         .otherwise(F.lit("train")))
    return out.drop("pos")


def stratified_folds(df: DataFrame, label: str, row_id: str, seed=1, k: int = 3) -> DataFrame:
    """Balanced folds: position within the label in hash order, modulo k."""
    idx = dense_index(df, [label], seeded_md5(seed, row_id), row_id)
    return idx.withColumn("fold", (F.col("pos") % k).cast("int")).drop("pos")


def seeds_frame(df: DataFrame, seeds: list[int], name: str = "seed") -> DataFrame:
    """Every row once per seed (seed as a column; seeds are a small parameter list)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(int(s)) for s in seeds])))


def few_shot_positions(pool: DataFrame, queries: DataFrame, stratum: str, text: str, pool_id: str,
                       query_id: str, n: int, seed=1, hashed: bool = False, materialize: bool = False,
                       keys: list[str] | None = None) -> DataFrame:
    """For each query row, up to ``n`` distinct pool rows of the same stratum whose
    text differs from the query's text, drawn without replacement.

    Pool order: (md5(seed:text), md5(seed:id), id) so equal texts are adjacent. A query whose text block in
    the pool has size b ending at position e takes positions
    ``(e + 1 + (o + j*m) div n') mod count`` for j < n' = min(n, m), m = count - b,
    o = hash(seed:query) mod m: all distinct, never in its own block.
    Returns (query_id, ordinal j, pool_id of the example, n_found). A row without a candidate (its stratum
    is null or not in the pool, or all of it has the row's text) is reported once, with n_found = 0
    and null j and example.
    ``hashed=True``: ``text`` already holds md5(seed:text) (see ``text_hash``).
    ``keys`` (e.g. seed and prompt style, the seed then given as a column) are columns of both tables
    and of the result; each combination samples for itself, all in one plan.
    ``materialize=True`` checkpoints the indexed pool, which three branches read.
    """
    seed_c = _seed_col(seed)
    k = list(keys or [])
    st = [*k, stratum]
    # Texts travel as their seeded md5 (also the pool order), never as whole strings.
    th = F.col(text) if hashed else seeded_md5(seed_c, text)
    p = pool.select(*st, th.alias("_th"), pool_id)
    # Pool order: (text hash, id hash, id). Text blocks are laid out by a weighted prefix sum
    # over one row per distinct text; rows are ranked inside their block by a dense index
    # over id-hash buckets, so many copies of one text never share a window partition.
    blocks = p.groupBy(*st, "_th").agg(F.count(F.lit(1)).alias("_size"))
    blocks = weighted_offsets(blocks, st, "_th", "_size", "_start")
    ranked = dense_index(p, [*st, "_th"], seeded_md5(seed_c, pool_id), pool_id, name="_in")
    pidx = ranked.join(blocks.select(*st, "_th", "_start"), [*st, "_th"], "inner") \
        .select(*st, pool_id, (F.col("_start") + F.col("_in")).alias("pos"))
    if materialize:
        pidx = checkpointed(pidx)
        blocks = checkpointed(blocks)
    sizes = blocks.groupBy(*st).agg(F.sum("_size").alias("_count"))
    blocks = blocks.select(*st, "_th", F.col("_size").alias("_b"), (F.col("_start") + F.col("_size") - 1).alias("_e"))
    q = queries.select(query_id, *st, th.alias("_th"))
    # strata and texts that many queries share are met in parts, as their counts ask for
    per_text = q.groupBy(*st, "_th").agg(F.count(F.lit(1)).alias("n"))
    if materialize:
        per_text = checkpointed(per_text)
    per_stratum = per_text.groupBy(*st).agg(F.sum("n").alias("n"))
    alone = q.where(F.col(stratum).isNull()).select(*k, query_id, *[F.lit(None).cast(t).alias(c) for c, t in (
        ("j", "int"), ("example_id", p.schema[pool_id].dataType))], F.lit(0).alias("n_found"))
    q = balanced_join(q.where(F.col(stratum).isNotNull()), sizes, st, F.struct(query_id), "left", counts=per_stratum)
    q = balanced_join(q, blocks, [*st, "_th"], F.struct(query_id), "left", counts=per_text)
    q = q.withColumn("_count", F.coalesce("_count", F.lit(0))).withColumn("_b", F.coalesce("_b", F.lit(0))).withColumn("_e", F.coalesce("_e", F.lit(-1)))
    q = q.withColumn("_m", F.col("_count") - F.col("_b")).withColumn("n_found", F.least(F.lit(n), F.col("_m")).cast("int"))
    h = md5_int(F.concat(seed_c.cast("string"), F.lit(":q:"), F.col(query_id).cast("string")))
    q = q.withColumn("_o", F.pmod(h, F.greatest("_m", F.lit(1))))
    q = q.withColumn("j", F.explode_outer(F.when(F.col("n_found") > 0, F.sequence(F.lit(0), F.col("n_found") - 1))))
    step = F.floor((F.col("_o") + F.col("j") * F.col("_m")) / F.greatest("n_found", F.lit(1)))
    # a row without a candidate asks for a place that no pool has, rows apart from each other
    q = q.withColumn("pos", F.when(F.col("n_found") > 0, F.pmod(F.col("_e") + 1 + step, F.greatest("_count", F.lit(1))))
                     .otherwise(-1 - F.pmod(h, F.lit(1 << 20))))
    picked = q.select(query_id, *st, "j", "pos", "n_found")
    ex = pidx.select(*st, "pos", F.col(pool_id).alias("example_id"))
    return picked.join(ex, [*st, "pos"], "left").select(*k, query_id, "j", "example_id", "n_found").unionByName(alone)


def text_hash(text: str, seed=1) -> Column:
    """md5(seed:text): the few-shot pool order and text identity, computed once at the scan."""
    return seeded_md5(_seed_col(seed), text)


def shuffled_ordinals(pairs: DataFrame, query_id: str, seed=1, keys: list[str] | None = None) -> DataFrame:
    """K17 helper: re-rank a query's examples by hash so the first k of them are a uniform
    k-subset (nested samples for growing shot counts). Groups are bounded by ``n``."""
    h = seeded_md5(_seed_col(seed), F.lit("rank"), query_id, "example_id")
    w = Window.partitionBy(*(keys or []), query_id).orderBy(h, "example_id")
    return pairs.withColumn("rank", F.row_number().over(w) - 1)
