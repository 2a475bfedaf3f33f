"""Near-duplicate classes by BagMinHash signatures (operator 1).

Texts are multisets of five-word runs (lower-cased, parted at ASCII white space). Signatures
of the multisets come from hierarchical Poisson processes over the discretised weights:
weight (0, 1], (1, 2], (2, 4], (4, 8] ... of an element is one process each, its points are
generated in ascending order and routed to a unit level by hash bits, and a bag takes the
points whose level lies within its count. Register minima of the points agree between two
bags with a chance equal to their weighted Jaccard similarity. Signatures are cut into bands;
texts that share a band are candidates, and every link is decided by the exact multiset
overlap sum(min) / sum(max) >= threshold.

Classes are the connected components of the links. Within a band bucket the work is never
all pairs of a group: (1) every member is compared with the bucket's centre, the text that shares
buckets with the most rows (of a group of copies usually the text they come from, and the same
one in all its buckets), (2) what still spans several components is compared completely, in tiles:
the members outside the largest component with all members. So no link between candidates is lost.

Cases: exact copies are one text (by MD5) and always share a class; a text that is null or
has no word is never a duplicate; texts of one to four words have a single run of all of them;
repeated rows with one id form one class and keep one row; a null id takes part by its text,
and the class id is the smallest non-null id; empty tables give empty results. Long texts are
taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitio.llm.common import connected_components, salted_join, stored
from transitio.llm.tokens import SPACE, bags, mix, pieces, shingles, unit, words

SHINGLE = 5
THRESHOLD = "0.8"
BANDS = 32
BAND_ROWS = 4
TILE = 1024
MINOR = 256
_U = np.uint64


def signatures(rows: int, row: np.ndarray, elem: np.ndarray, weight: np.ndarray, registers: int) -> np.ndarray:
    """Register minima, shape (rows, registers); infinity throughout for an empty bag.

    ``elem`` are 64-bit hashes and ``weight`` positive integers; (row, elem) is unique.
    """
    sig = np.full(rows * registers, np.inf)
    total = np.bincount(row, weights=weight, minlength=rows)
    with np.errstate(divide="ignore"):
        limit = registers / total * (np.log(registers) + 3.0)
    # One stream per (bag, element, dyadic weight block below the count).
    top = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0)
    many = np.repeat(np.arange(len(row)), top + 1)
    block = np.arange(len(many)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    s_row, s_weight = row[many], weight[many]
    lower = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    length = np.where(block > 0, lower, 1)
    seed = mix(elem[many] ^ (block.astype(_U) * _U(0xA0761D6478BD642F)))
    time = -np.log(unit(mix(seed + _U(1)))) / length
    step = np.ones(len(many), dtype=_U)
    live = np.flatnonzero(time <= limit[s_row])
    while True:
        while len(live):
            h = mix(seed[live] ^ (step[live] * _U(0x9FB21C651E98DF25)))
            # the point's place on the weight axis: kept if its unit level is within the count
            level = lower[live] + 1 + ((h >> _U(32)).astype(np.int64) % length[live])
            take = level <= s_weight[live]
            at = live[take]
            np.minimum.at(sig, s_row[at] * registers + (h[take] & _U(0xFFFFFFFF)).astype(np.int64) % registers, time[at])
            step[live] += _U(1)
            time[live] += -np.log(unit(mix(seed[live] + step[live]))) / length[live]
            live = live[time[live] <= limit[s_row[live]]]
        lacking = (total > 0) & np.isinf(sig.reshape(rows, registers)).any(axis=1)
        if not lacking.any():
            return sig.reshape(rows, registers)
        limit = np.where(lacking, limit * 2, -1.0)  # the streams go on where they stopped
        live = np.flatnonzero(time <= limit[s_row])


def band_keys(sig: np.ndarray, bands: int, band_rows: int) -> np.ndarray:
    """One 64-bit key per band; the band number is part of the key."""
    v = sig.reshape(len(sig), bands, band_rows).view(_U)
    key = np.tile(np.arange(1, bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15), (len(sig), 1))
    for j in range(band_rows):
        key = mix(key ^ v[:, :, j])
    return key.view(np.int64)


def text_bags(text: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for lo, hi, data, offs in pieces(text):
        r, h = shingles(words(data, offs, SPACE), size)
        yield (lo, hi, *bags(r, h))


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, band_rows: int) -> DataFrame:
    """(id, tk, keys): MD5 of the text and its band keys; keys is null for texts without a word."""
    src = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text_col)).alias("tk"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("tk", T.BinaryType()),
                           T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, r, e, w in text_bags(b.column(2), size):
                n = hi - lo
                keys = band_keys(signatures(n, r, e, w, bands * band_rows), bands, band_rows)
                none = np.bincount(r, minlength=n) == 0
                offs = np.concatenate([[0], np.cumsum(np.where(none, 0, bands))])
                arr = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(keys[~none].ravel(), pa.int64()),
                                               mask=pa.array(none))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), b.column(1).slice(lo, n), arr],
                                                 names=["id", "tk", "keys"])

    return src.mapInArrow(run, schema)


def _linked(inter: np.ndarray, union: np.ndarray, at_least: Fraction) -> np.ndarray:
    return inter * at_least.denominator >= union * at_least.numerator


def _verify(edges: DataFrame, texts: DataFrame, size: int, at_least: Fraction) -> DataFrame:
    """(a, b) of those ``edges`` whose multiset overlap reaches the threshold.

    The members of one centre ``a`` are dealt to 8 salts, each next to a copy of the centre's
    text, and streamed in order (centre first): memory holds one centre and one piece.
    """
    salt = F.pmod(F.xxhash64("b"), F.lit(8)).cast("int").alias("salt")
    members = edges.select("a", salt, F.lit(1).alias("role"), F.col("b").alias("tk"))
    centres = edges.select("a", salt, F.lit(0).alias("role"), F.col("a").alias("tk")).distinct()
    rows = members.unionByName(centres).join(texts, "tk").select("a", "salt", "role", "tk", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ce, cw, total = np.zeros(0, _U), np.zeros(0, np.int64), 0
        for b in batches:
            role = np.asarray(b.column(2))
            for lo, hi, r, e, w in text_bags(b.column(4), size):
                at = np.searchsorted(r, np.arange(hi - lo + 1))
                starts = np.flatnonzero(role[lo:hi] == 0)
                good = np.zeros(hi - lo, dtype=bool)
                for k, s in enumerate([-1, *starts]):  # -1: members of the centre before this piece
                    to = starts[k] if k < len(starts) else hi - lo
                    if s >= 0:
                        ce, cw = e[at[s]:at[s + 1]], w[at[s]:at[s + 1]]
                        total = int(cw.sum())
                    if to > s + 1 and len(ce):
                        x = slice(at[s + 1], at[to])
                        pos = np.minimum(np.searchsorted(ce, e[x]), len(ce) - 1)
                        both = np.where(ce[pos] == e[x], np.minimum(cw[pos], w[x]), 0)
                        n, which = to - s - 1, r[x] - (s + 1)
                        inter = np.bincount(which, weights=both, minlength=n).astype(np.int64)
                        own = np.bincount(which, weights=w[x], minlength=n).astype(np.int64)
                        good[s + 1:to] = _linked(inter, total + own - inter, at_least)
                keep = pa.array(np.flatnonzero(good) + lo, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(3).take(keep)], names=["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def tile_links(a: list, b: list, size: int, at_least: Fraction) -> list[tuple[int, int]]:
    """Components of the linked pairs between ``a`` and ``b``: one edge per text to the first text it
    reaches, indices into a + b."""
    every, cut = a + b, len(a)
    n, parts = len(every), []
    for lo, _, r, e, w in text_bags(pa.array(every, pa.string()), size):
        parts.append((r + lo, e, w))
    r, e, w = (np.concatenate([p[i] for p in parts]) for i in range(3))
    total = np.bincount(r, weights=w, minlength=n).astype(np.int64)
    _, col, times = np.unique(e, return_inverse=True, return_counts=True)
    inter = np.zeros((cut, n - cut), dtype=np.float64)
    # sum(min(x, y)) is the sum over levels of [x >= level][y >= level], taken in steps between the
    # counts that occur; elements of one text only can't meet
    shared, below = times[col] > 1, 0
    for level in np.unique(w[shared]).tolist():
        use, step, below = shared & (w >= level), level - below, level
        cols, inv = np.unique(col[use], return_inverse=True)
        rr = r[use]
        for c in range(0, len(cols), 4096):
            m = (inv >= c) & (inv < c + 4096)
            dense = np.zeros((n, min(4096, len(cols) - c)), dtype=np.float32)
            dense[rr[m], inv[m] - c] = 1
            inter += (dense[:cut] @ dense[cut:].T) * step
    inter = np.rint(inter).astype(np.int64)
    ok = _linked(inter, total[:cut, None] + total[None, cut:] - inter, at_least) & (total > 0)[:cut, None]
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(*np.nonzero(ok)):
        p, q = find(int(x)), find(int(y) + cut)
        if p != q:
            parent[max(p, q)] = min(p, q)
    return [(find(x), x) for x in range(n) if find(x) != x]


def _closing(open_members: DataFrame, texts: DataFrame, size: int, at_least: Fraction) -> DataFrame:
    """Links among the members (key, tk, comp) of buckets that still span several components.

    Within a component nothing is left to decide, so the members outside the bucket's largest
    component (the minor ones, in tiles of MINOR texts) are compared with all its members (in
    tiles of TILE texts): every undecided pair is compared, and a bucket whose members are mostly
    one component costs one row per member. A task holds one pair of tiles."""
    comps = open_members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    sizes = comps.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("top")).select(
        "key", F.col("top.comp").alias("major"), F.ceil(F.col("all") / TILE).cast("int").alias("tiles"),
        F.ceil((F.col("all") - F.col("top.n")) / MINOR).cast("int").alias("minors"))
    m = salted_join(open_members.select("key", "tk", "comp"), sizes, ["key"], F.col("tk"), "inner", 8)
    spread = F.xxhash64("tk")
    members = m.select("key", "tk", F.lit(1).alias("role"), F.explode(F.expr("sequence(0, minors - 1)")).alias("x"),
                       F.pmod(spread, F.col("tiles")).cast("int").alias("y"))
    minor = m.where("comp != major").select("key", "tk", F.lit(0).alias("role"), F.pmod(spread, F.col("minors")).cast("int").alias("x"),
                                            F.explode(F.expr("sequence(0, tiles - 1)")).alias("y"))
    rows = members.unionByName(minor).join(texts, "tk")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("tk")  # the first text is the smallest key, whatever the bucket
        role, tk, text = t.column("role").to_pylist(), t.column("tk").to_pylist(), t.column("text").to_pylist()
        ids = [i for i, v in enumerate(role) if v == 0] + [i for i, v in enumerate(role) if v == 1]
        cut = role.count(0)
        links = tile_links([text[i] for i in ids[:cut]], [text[i] for i in ids[cut:]], size, at_least) if 0 < cut < len(ids) else []
        links = [(tk[ids[p]], tk[ids[q]]) for p, q in links if tk[ids[p]] != tk[ids[q]]]
        return pa.table({"a": pa.array([p for p, _ in links], pa.binary()), "b": pa.array([q for _, q in links], pa.binary())})

    return rows.groupBy("key", "x", "y").applyInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: str = THRESHOLD,
                    shingle: int = SHINGLE, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """(id_col, tk, class_id, class_tk) for every row of ``docs``.

    ``class_id`` is the smallest id of the row's class, ``tk`` the MD5 of its text, ``class_tk``
    the key of the class (null for rows that can't have duplicates: their class is themselves).
    """
    at_least = Fraction(threshold)
    sk = stored(sketch(docs, id_col, text_col, shingle, bands, band_rows), "bag-sketch")
    buckets = sk.where("keys is not null").select("tk", F.explode("keys").alias("key"))
    spans = buckets.groupBy("key").agg(F.min("tk").alias("lo"), F.max("tk").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo != hi")
    members = salted_join(buckets, spans.select("key", "n"), ["key"], F.col("tk"), "inner", 8).distinct()
    # a text's rank: the rows it shares buckets with (a text has at most ``bands`` rows here)
    members = members.withColumn("rank", F.sum("n").over(Window.partitionBy("tk"))).select("key", "tk", "rank")
    members = stored(members, "bag-members")
    involved = members.select("tk").distinct()
    texts = docs.select(F.unhex(F.md5(text_col)).alias("tk"), F.col(text_col).alias("text")) \
        .groupBy("tk").agg(F.first("text").alias("text"))
    texts = stored(texts.join(involved, "tk"), "bag-texts")

    centres = members.groupBy("key").agg(F.max(F.struct("rank", "tk")).alias("c")).select("key", F.col("c.tk").alias("a"))
    edges = salted_join(members, centres, ["key"], F.col("tk"), "inner", 8).where("tk != a").select("a", F.col("tk").alias("b")).distinct()
    comps = stored(connected_components(_verify(edges, texts, shingle, at_least)), "bag-comps")
    open_members = _still_open(members, comps)
    if open_members.limit(1).count():
        comps = _merged(comps, _closing(open_members, texts, shingle, at_least))

    by_text = sk.groupBy("tk").agg(F.min("id").alias("low")).join(comps.withColumnRenamed("node", "tk"), "tk", "left")
    by_text = by_text.withColumn("comp", F.coalesce("comp", "tk"))
    low = by_text.groupBy("comp").agg(F.min("low").alias("class_id"))
    by_text = stored(by_text.join(low, "comp").select("tk", "class_id", F.col("comp").alias("class_tk")), "bag-classes")
    rows = salted_join(sk.where("keys is not null").select("id", "tk"), by_text, ["tk"], F.col("id"), "inner")
    alone = sk.where("keys is null").select("id", "tk", F.col("id").alias("class_id"), F.lit(None).cast("binary").alias("class_tk"))
    return rows.unionByName(alone).withColumnRenamed("id", id_col)


def _comp_of(df: DataFrame, comps: DataFrame, node: str, name: str) -> DataFrame:
    """Add the component of ``node``; a node without links is its own."""
    df = df.join(comps.select(F.col("node").alias(node), F.col("comp").alias(name)), node, "left")
    return df.withColumn(name, F.coalesce(name, node))


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: only links between different components count, as edges of the
    components themselves, so the graph that is left is small."""
    across = _comp_of(_comp_of(links.distinct(), comps, "a", "ca"), comps, "b", "cb").where("ca != cb")
    across = stored(across.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "bag-across")
    more = connected_components(across)
    nodes = comps.unionByName(across.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                              .withColumn("comp", F.col("node")).join(comps.select("node"), "node", "left_anti"))
    more = more.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return stored(nodes.join(more, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "bag-comps")


def _still_open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """The members of buckets that span more than one component; of buckets with the same members
    (equal in number and in two 64-bit sums of hashes) one is enough."""
    m = _comp_of(members, comps, "tk", "comp")
    span = m.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("n"),
                                F.bit_xor(F.xxhash64("tk")).alias("x"), F.bit_xor(F.xxhash64("tk", F.lit(1))).alias("y")).where("c0 != c1")
    span = span.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    return stored(salted_join(m, span, ["key"], F.col("tk"), "inner", 8), "bag-open")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one per class, the row with the class's smallest id.

    Repeated rows with that id and text leave one. Rows without a word all stay.
    """
    rows = near_duplicates(docs, id_col, text_col, **options)
    ident = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("null"))
    best = rows.where("class_tk is not null").withColumnRenamed(id_col, "id") \
        .groupBy("class_tk").agg(F.min(F.struct(F.col("id").isNull(), "id", "tk")).alias("k")) \
        .select("k.id", "k.tk").select(ident.alias("ident"), "tk")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    marked = docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.md5(text)).alias("tk"),
                         text.rlike(r"[^\t\n\f\r ]").alias("worded"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    hit = marked.where("worded").select(ident.alias("ident"), "tk", "row").join(stored(best, "bag-best"), ["ident", "tk"], "left_semi")
    # whole rows are combined only if any row stands there twice, which narrow rows tell
    twice = rows.where("class_tk is not null").withColumnRenamed(id_col, "id").select(ident.alias("ident"), "tk") \
        .groupBy("ident", "tk").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if twice.limit(1).count():
        hit = hit.dropDuplicates(["ident", "tk"])
    return hit.select("row.*").unionByName(marked.where("not worded").select("row.*"))
