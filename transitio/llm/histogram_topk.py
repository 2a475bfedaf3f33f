"""Exact top-k search by distributed histogram selection (operator 9).

Vectors become integers floor(1024 * x); a score is the integer inner product. Queries travel in
chunks, candidates in blocks that never move as rows; every chunk meets every block. Rounds of
global histograms locate each query's k-th highest score: scores are counted in 4096 bins over
the open interval, the counts of all blocks are added up, the bin that holds the k-th score is
the next interval, until a bin is one integer wide (2 rounds for unit vectors). A block reports
only bins from its top down to its own k-th score, since no lower bin can hold the global one.
The last round keeps scores above the k-th value, and of those equal to it the smallest ids.

Cases: vectors that are null, empty, without id, hold null or non-finite components or a scaled
component beyond 2^62 take no part; shorter vectors count as padded with zeros; rows with the
query's own id are the query; repeated query rows are one query; with fewer than k candidates all are
returned; scores beyond 64 bits are cut to the nearest long; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitio.llm.common import stored
from transitio.llm.vectors import FINITE, matrix, runs
from transitio.session import materialize

K = 10
SCALE = 1024
BLOCK = 2048
CHUNK = 512
BIN_BITS = 12
SALTS = 16
_LONG = np.iinfo(np.int64)


def integers(table: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    v = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("x")) \
        .where(FINITE.format("x")).where(f"id IS NOT NULL AND forall(x, c -> abs(c * {scale}) < 4611686018427387904D)")
    return v.select("id", F.size("x").alias("dim"), F.expr(f"transform(x, c -> floor(c * {scale}))").alias("v"))


def pack(vectors: DataFrame, rows: int, keys: list[str]) -> DataFrame:
    """(keys..., dim, n, ids, vecs, top): blocks of at most ``rows`` vectors of one partition, in the
    order they come; ``top`` bounds the length of the block's vectors."""
    v = vectors.select(*keys, "dim", "id", "v")
    at_id = len(keys) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in runs(*[b.column(i) for i in range(at_id)]):
                for at in range(lo, hi, rows):
                    k = min(rows, hi - at)
                    ids = np.asarray(b.column(at_id).slice(at, k)).astype(np.int64)
                    m = b.column(at_id + 1).slice(at, k).flatten().to_numpy().astype(np.int64).reshape(k, -1)
                    top = float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max()))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(i).slice(at, 1) for i in range(at_id)] +
                        [pa.array([k], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
                         pa.array([m.tobytes()], pa.binary()), pa.array([top])],
                        names=[*keys, "dim", "n", "ids", "vecs", "top"])

    key_types = "".join(f"{k} {v.schema[k].dataType.simpleString()}, " for k in keys)
    return v.mapInArrow(run, key_types + "dim int, n int, ids binary, vecs binary, top double")


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, exact; in doubles where every partial sum is below 2^53."""
    d = min(q.shape[1], c.shape[1])
    q, c = q[:, :d], c[:, :d]
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * d
    if bound < 2.0 ** 53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    exact = q.astype(object) @ c.T.astype(object)
    return np.clip(exact, _LONG.min + 1, _LONG.max).astype(np.int64)


def _ints(b: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(b, dtype=np.int64).reshape(*shape) if shape else np.frombuffer(b, dtype=np.int64)


def _meet(chunks: DataFrame, blocks: DataFrame, n_chunks: int) -> DataFrame:
    """Every chunk with every block, dealt by (chunk, salt of the block)."""
    c = chunks.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    b = blocks.select(F.col("dim").alias("b_dim"), F.col("n").alias("b_n"), F.col("ids").alias("b_ids"),
                      F.col("vecs").alias("b_vecs"), F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int").alias("salt"),
                      F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"))
    return b.join(c, ["chunk", "salt"]).select("chunk", "part", "dim", "n", "ids", "vecs", "lo", "need",
                                               "b_dim", "b_n", "b_ids", "b_vecs")


def _scored(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for r in range(b.num_rows):
            v = [b.column(i)[r].as_py() for i in range(12)]
            ids, c_ids = _ints(v[4]), _ints(v[10])
            s = scores(_ints(v[5], v[3], v[2]), _ints(v[11], v[9], v[8]))
            s[ids[:, None] == c_ids[None, :]] = _LONG.min  # the query's own rows
            yield v[0], v[1], ids, c_ids, s, np.array(v[6], dtype=np.int64), np.array(v[7], dtype=np.int64)


def _above(s: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Scores that can be among the block's ``need`` highest."""
    k = min(int(need.max(initial=1)), s.shape[1])
    kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    return (s >= kth[:, None]) & (s > _LONG.min)


def _histogram(pairs: DataFrame, shift: int, width: int) -> DataFrame:
    """Global counts per query and bin of 2^shift scores over the open interval [lo, lo + 2^width)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part, ids, _, s, lo, need in _scored(batches):
            inside = s - lo[:, None] if width < 62 else s.astype(object) - lo[:, None].astype(object)
            above = np.asarray(inside >> width > 0, dtype=bool)
            inside_ok = np.asarray((inside >= 0), dtype=bool) & ~above & (s > _LONG.min)
            masked = np.where(inside_ok, s, _LONG.min)
            q, c = np.nonzero(_above(masked, need))
            bins = np.asarray([int(x) >> shift for x in inside[q, c]] if inside.dtype == object else inside[q, c] >> shift, dtype=np.int64)
            key, many = np.unique(q.astype(np.int64) << (BIN_BITS + 1) | bins, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(key), chunk, dtype=np.int32)), pa.array(np.full(len(key), part, dtype=np.int64)),
                 pa.array((key >> (BIN_BITS + 1)).astype(np.int32)),
                 pa.array((key & ((1 << (BIN_BITS + 1)) - 1)).astype(np.int32)), pa.array(many.astype(np.int64))],
                names=["chunk", "part", "q", "bin", "n"])

    return pairs.mapInArrow(run, "chunk int, part bigint, q int, bin int, n bigint") \
        .groupBy("chunk", "part", "q", "bin").agg(F.sum("n").alias("n"))


def _narrowed(chunks: DataFrame, hist: DataFrame, shift: int) -> DataFrame:
    """Chunks with ``lo`` and ``need`` of the bin that holds each query's k-th score; where fewer
    scores are left than needed, of the lowest bin."""
    w = Window.partitionBy("chunk", "part", "q").orderBy(F.desc("bin"))
    state = chunks.select("chunk", "part", F.posexplode(F.arrays_zip("lo", "need")).alias("q", "s")) \
        .select("chunk", "part", "q", "s.lo", "s.need")
    # a query reports at most k bins per block, summed over blocks before this window
    run = hist.withColumn("sum", F.sum("n").over(w)).join(state, ["chunk", "part", "q"])
    hit = run.where("sum - n < need").groupBy("chunk", "part", "q").agg(
        F.min(F.struct("bin", "sum", "n", "lo", "need")).alias("h"))
    new = state.join(hit, ["chunk", "part", "q"], "left").select(
        "chunk", "part", "q", F.when(F.col("h").isNull(), F.col("lo"))
        .otherwise(F.col("h.lo") + F.col("h.bin").cast("bigint") * F.lit(1 << shift)).alias("lo"),
        F.when(F.col("h").isNull(), F.col("need")).otherwise(F.col("h.need") - (F.col("h.sum") - F.col("h.n"))).alias("need"))
    arrays = new.groupBy("chunk", "part").agg(F.sort_array(F.collect_list(F.struct("q", "lo", "need"))).alias("s")) \
        .select("chunk", "part", F.col("s.lo").alias("lo"), F.col("s.need").alias("need"))
    return materialize(chunks.drop("lo", "need").join(arrays, ["chunk", "part"]))


def top_k(table: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
          scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of every query row."""
    vectors = integers(table, id_col, vec_col, scale)
    blocks = stored(pack(vectors, BLOCK, []), "topk-blocks")
    asked = integers(table.where(is_query), id_col, vec_col, scale).dropDuplicates(["id"])
    n_queries = asked.count()
    n_chunks = max(1, -(-n_queries // CHUNK))
    q = asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(n_chunks)).cast("int"))
    q = q.repartition("chunk").sortWithinPartitions("chunk", "dim")
    tops = blocks.agg(F.max("top")).first()[0] or 0.0
    bits = max(1, int(np.ceil(np.log2(tops * tops + 2))) + 1)  # scores are within +-2^(bits - 1)
    bits = min(63, -(-bits // BIN_BITS) * BIN_BITS)
    first = -(1 << (bits - 1))
    chunks = pack(q, CHUNK, ["chunk"]).withColumn("part", F.xxhash64("ids")).drop("top")
    chunks = materialize(chunks.withColumn("lo", F.expr(f"array_repeat(cast({first} as bigint), n)"))
                         .withColumn("need", F.expr(f"array_repeat(cast({k} as bigint), n)")))
    shift = bits
    while shift > 0:
        width, shift = shift, max(0, shift - BIN_BITS)
        chunks = _narrowed(chunks, _histogram(_meet(chunks, blocks, n_chunks), shift, width), shift)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, ids, c_ids, s, lo, _ in _scored(batches):
            out_q, out_c, out_s = [], [], []
            for i in np.flatnonzero((s >= lo[:, None]).any(axis=1)):
                more = np.flatnonzero((s[i] > lo[i]) & (s[i] > _LONG.min))
                ties = np.flatnonzero((s[i] == lo[i]) & (s[i] > _LONG.min))
                ties = ties[np.argsort(c_ids[ties], kind="stable")[:k]]
                take = np.concatenate([more, ties])
                out_q.append(np.full(len(take), ids[i]))
                out_c.append(c_ids[take])
                out_s.append(s[i][take])
            none = np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x]), pa.int64()) for x in (out_q, out_c, out_s)],
                                             names=["query_id", "vec_id", "score"])

    best = _meet(chunks, blocks, n_chunks).mapInArrow(final, "query_id bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
