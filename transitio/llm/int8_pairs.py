"""Embedding near-duplicates by quantised tile products (operator 2).

Vectors of one label (and dimension) are packed into tiles; every pair of tiles of a label is
one unit of work. Vectors are normalised and quantised to int8 with a scale each; the length
of what quantisation left out is kept. For unit vectors u, w and their quantised forms p, q:
|u.w - p.q| <= |u - p| * (1 + |w - q|) + |w - q|, so a pair can reach the threshold only if the
int8 product plus that bound does. Only such pairs are computed in double precision, and only
cosine >= threshold links. A tile pair returns link counts per vector and, for the components,
one edge per vector towards the smallest vector it reaches inside a subtile: never the pairs.

The work grows with the square of a label's vectors (every pair is compared, as asked); the rows
that are shuffled grow with vectors * (tiles of the label).

Cases: vectors that are null, empty, zero or hold null or non-finite components, vectors without
a label or id, and vectors of another dimension link with nothing. Rows with one vec_id are one
vector: they don't link to each other, and their links count per row and are added up. Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitio.llm.common import connected_components, salted_join, stored
from transitio.llm.vectors import FINITE, matrix, runs

THRESHOLD = 0.98
TILE = 4096
SUB = 512


def pack_tiles(vectors: DataFrame, tile: int) -> DataFrame:
    """(label, dim, ids, vecs, count, no): blocks of at most ``tile`` vectors, numbered per label."""
    size = vectors.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    v = salted_join(vectors, size, ["label", "dim"], F.col("id"), "inner") \
        .withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    v = v.repartition("label", "dim", "tile").sortWithinPartitions("label", "dim", "tile") \
        .select("label", "dim", "tile", "id", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo, hi in runs(b.column(0), b.column(1), b.column(2)):
                for at in range(lo, hi, tile):
                    k = min(tile, hi - at)
                    ids = np.asarray(b.column(3).slice(at, k)).astype(np.int64)
                    vecs = matrix(b.column(4).slice(at, k))
                    block += 1
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(at, 1), b.column(1).slice(at, 1), pa.array([block], pa.int64()),
                         pa.array([ids.tobytes()], pa.binary()), pa.array([vecs.tobytes()], pa.binary())],
                        names=["label", "dim", "block", "ids", "vecs"])

    kind = vectors.schema["label"].dataType.simpleString()
    blocks = stored(v.mapInArrow(run, f"label {kind}, dim int, block bigint, ids binary, vecs binary"), "vec-tiles")
    number = blocks.groupBy("label", "dim").agg(F.sort_array(F.collect_set("block")).alias("order"))  # one number per block
    return blocks.join(number, ["label", "dim"]).withColumn("count", F.size("order")) \
        .withColumn("no", F.expr("array_position(order, block) - 1").cast("int")).drop("order", "block")


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values as float32, scale, error length) of unit rows."""
    scale = np.abs(v).max(axis=1) / 127.0
    q = np.rint(v / scale[:, None])
    err = np.sqrt(np.sum((v - q * scale[:, None]) ** 2, axis=1)) * (1 + 1e-12) + 1e-14
    return q.astype(np.float32 if v.shape[1] * 127 * 127 < 1 << 24 else np.float64), scale, err


def subtile_links(a, b, threshold: float) -> np.ndarray:
    """Boolean links of two subtiles (raw, norm, q, scale, err): int8 bound first, then doubles."""
    (ra, na, qa, sa, ea), (rb, nb, qb, sb, eb) = a, b
    near = (qa @ qb.T) * sa[:, None] * sb[None, :]
    maybe = near + ea[:, None] * (1 + eb[None, :]) + eb[None, :] >= threshold - 1e-9
    i, j = np.nonzero(maybe)
    links = np.zeros(maybe.shape, dtype=bool)
    for at in range(0, len(i), 1 << 14):
        x, y = i[at:at + (1 << 14)], j[at:at + (1 << 14)]
        links[x, y] = np.einsum("ij,ij->i", ra[x], rb[y]) / (na[x] * nb[y]) >= threshold
    return links


def smallest_reached(links: np.ndarray, low_a: np.ndarray, low_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id reachable inside a subtile, for its rows and its columns (own id if unlinked)."""
    top = np.iinfo(np.int64).max
    rows, cols = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
    if not len(rows):
        return low_a, low_b
    small = links[np.ix_(rows, cols)]
    a, b = low_a[rows].copy(), low_b[cols].copy()
    while True:
        b2 = np.minimum(b, np.where(small, a[:, None], top).min(axis=0))
        a2 = np.minimum(a, np.where(small, b2[None, :], top).min(axis=1))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    low_a, low_b = low_a.copy(), low_b.copy()
    low_a[rows], low_b[cols] = a, b
    return low_a, low_b


def tile_pair(blocks: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, link counts, edge a, edge b) of one tile with itself or of two tiles with each other."""
    parts = []
    for ids, raw in blocks:
        raw = raw / np.abs(raw).max(axis=1)[:, None]
        norm = np.sqrt(np.sum(raw * raw, axis=1))
        q, scale, err = quantise(raw / norm[:, None])
        parts.append([(ids[s:s + SUB], tuple(x[s:s + SUB] for x in (raw, norm, q, scale, err)))
                      for s in range(0, len(ids), SUB)])
    own = len(parts) == 1
    left, right = parts[0], parts[-1]
    count = [np.zeros(len(b[0]), dtype=np.int64) for b in blocks]
    ea, eb = [], []
    for i, (ids_a, a) in enumerate(left):
        for j, (ids_b, b) in enumerate(right):
            if own and j < i:
                continue
            links = subtile_links(a, b, threshold) & (ids_a[:, None] != ids_b[None, :])
            if not links.any():
                continue
            count[0][i * SUB:i * SUB + len(ids_a)] += links.sum(axis=1)
            if not own or i != j:
                count[-1][j * SUB:j * SUB + len(ids_b)] += links.sum(axis=0)
            low_a, low_b = smallest_reached(links, ids_a, ids_b)
            ea += [ids_a[low_a != ids_a], ids_b[low_b != ids_b]]
            eb += [low_a[low_a != ids_a], low_b[low_b != ids_b]]
    none = np.zeros(0, dtype=np.int64)
    ids, n = np.concatenate([b[0] for b in blocks]), np.concatenate(count)
    return ids[n > 0], n[n > 0], np.concatenate([none, *ea]), np.concatenate([none, *eb])


def near_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """id, n_links, component_id, kept: one row per row of ``table``."""
    src = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
                       F.col(label_col).alias("label"))
    valid = src.where(FINITE.format("vec")).where("exists(vec, x -> x <> 0) AND label IS NOT NULL AND id IS NOT NULL") \
        .withColumn("dim", F.size("vec"))
    blocks = pack_tiles(valid, tile)
    other = F.explode(F.expr("sequence(0, count - 1)")).alias("o")
    pairs = blocks.select("label", "dim", "no", "ids", "vecs", other).select(
        "label", "dim", F.least("no", "o").alias("x"), F.greatest("no", "o").alias("y"), "no", "ids", "vecs")

    def run(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        order = np.argsort(np.asarray(t.column("no")))
        blocks = [(np.frombuffer(t.column("ids")[int(i)].as_py(), dtype=np.int64),
                   np.frombuffer(t.column("vecs")[int(i)].as_py(), dtype=np.float64).reshape(-1, dim)) for i in order]
        ids, n, a, b = tile_pair(blocks, threshold)
        return pa.table({"id": pa.array(np.concatenate([ids, a]), pa.int64()),
                         "n": pa.array(np.concatenate([n, np.zeros(len(a), dtype=np.int64)]), pa.int64()),
                         "low": pa.array(np.concatenate([ids, b]), pa.int64())})

    found = stored(pairs.groupBy("label", "dim", "x", "y").applyInArrow(run, "id bigint, n bigint, low bigint"), "vec-links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    comps = connected_components(found.where("id != low").select(F.col("id").alias("a"), F.col("low").alias("b")))
    out = src.select("id").join(counts, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      F.coalesce("comp", "id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
