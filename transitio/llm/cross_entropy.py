"""Language-model scoring by cross-entropy difference (operator 3).

Two interpolated bigram models, of a target corpus and of the whole corpus as background, share
one vocabulary: the words that occur at least LEAST times in the corpus or the target, and one
unknown word. A document's score is its mean loss per token under the target model minus
that under the background model: the lower, the more target-like.

    P(w | h) = L c(h, w) / c(h) + (1 - L K(h) / c(h)) (c(w) + 1) / (N + V)

c counts, K(h) is the sum of the kept c(h, .), V the size of the vocabulary: it sums to one.
Kept are the pairs that occur at least LEAST times. The floor is the same at every size, so the
model grows with the corpus. Counting covers every token of every text.

Texts are written once, dealt to chunks of bounded size in a table bucketed by chunk. What has
to be known of the whole corpus is asked for in two rounds: a chunk sends its distinct keys with
its counts, in blocks by key range; a shard (one key range) adds up the blocks of all chunks and
answers each block with the corpus's counts, in the block's order. The first round asks for pairs,
the second for words and for the mass of kept pairs after them. Then each chunk scores its texts
in place. So a pair that stands everywhere is one entry a chunk, no key is hot; neither texts nor
single tokens are shuffled; blocks are sorted keys as differences, about seven bytes an entry.
The number of shards grows with the corpus.

Words are runs of letters, digits and non-ASCII characters, lower-cased; the first word of a text
follows a start mark. Words and pairs are identified by 64-bit hashes. Losses are added in units of
2^-32 nats, so sums do not depend on their order.

Cases: a null text or one without a word has n_tokens 0 and null losses and score; repeated rows
count again and are scored each; ids that are null or not in the corpus mark no target; without a
target its model is uniform over the vocabulary; empty tables give empty results; only the id and
text columns are read, so other columns may have any name; a text longer than a chunk is a chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitio.llm.common import salted_join, stored
from transitio.llm.tokens import PUNCT, mix, pieces, words
from transitio.session import ensure_checkpoint_dir

LEAST = 2
BIGRAM = 0.5
#: Bytes of text in a chunk; also what sets the number of shards.
CHUNK_BYTES = 8 << 20
#: What a row counts for besides its text, so that empty texts fill a chunk too.
ROW_BYTES = 64
MOST_BUCKETS = 1 << 14
UNIT = float(1 << 32)
#: The history of a text's first word.
START = 1 << 63
_U = np.uint64
BLOCK = "chunk bigint, shard int, n bigint, block binary"


def histories(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    before = np.empty_like(h)
    before[1:] = h[:-1]
    if len(h):
        before[0] = START
        before[1:][row[1:] != row[:-1]] = START
    return before


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a) + b)


def packed(columns: list[np.ndarray]) -> bytes:
    """Equally long columns of 64-bit numbers as compressed byte planes."""
    planes = [np.ascontiguousarray(c, dtype="<u8").view(np.uint8).reshape(-1, 8).T.ravel() for c in columns]
    return pa.Codec("zstd", compression_level=1).compress(np.concatenate(planes).tobytes(), asbytes=True)


def unpacked(block: bytes, n: int, columns: int) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(block, decompressed_size=n * 8 * columns, asbytes=True)
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(p.T).view("<u8").ravel() for p in planes]


def sent(chunk: int, bits: int, keys: np.ndarray, counts: list[np.ndarray]) -> pa.Table:
    """The blocks of a chunk's sorted distinct ``keys`` with their counts, one per shard that has any."""
    shard = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(keys) else np.zeros(0, np.int64)
    end = np.append(at[1:], len(keys))
    blocks = [packed([np.diff(keys[lo:hi], prepend=_U(0)), *[c[lo:hi] for c in counts]]) for lo, hi in zip(at, end)]
    return pa.table({"chunk": pa.array(np.full(len(at), chunk)), "shard": pa.array(shard[at].astype(np.int32)),
                     "n": pa.array((end - at).astype(np.int64)), "block": pa.array(blocks, pa.binary())})


def answered(blocks: pa.Table, columns: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct keys of a shard, per entry of all blocks its key's place, sums per distinct key)."""
    parts = [unpacked(b, n, 1 + columns) for b, n in zip(blocks.column("block").to_pylist(), blocks.column("n").to_pylist())]
    keys, place = np.unique(np.concatenate([np.cumsum(p[0], dtype=_U) for p in parts]), return_inverse=True)
    sums = []
    for i in range(columns):
        total = np.zeros(len(keys), dtype=np.int64)
        np.add.at(total, place, np.concatenate([p[1 + i] for p in parts]).astype(np.int64))
        sums.append(total)
    return keys, place, sums


def _summed(blocks: DataFrame, columns: int) -> DataFrame:
    """The answers to ``blocks``, each with the corpus's counts in its order, and in ``totals`` of one
    more row per shard (chunk null) what the vocabulary needs of the first two counts: number of known keys,
    both sums, both sums over known keys. The start mark is no word."""

    def run(t: pa.Table) -> pa.Table:
        keys, place, sums = answered(t, columns)
        n, out, at = t.column("n").to_pylist(), [], 0
        for k in n:
            out.append(packed([s[place[at:at + k]] for s in sums]))
            at += k
        word = keys != _U(START)
        known = word & (np.maximum(sums[0], sums[1]) >= LEAST)
        totals = [int(known.sum()), *[int(s[word].sum()) for s in sums[:2]], *[int(s[known].sum()) for s in sums[:2]]]
        return pa.table({"chunk": pa.array([*t.column("chunk").to_pylist(), None], pa.int64()),
                         "shard": pa.array([t.column("shard")[0].as_py()] * (len(n) + 1), pa.int32()),
                         "n": pa.array([*n, 0], pa.int64()), "block": pa.array([*out, None], pa.binary()),
                         "totals": pa.array([*[None] * len(n), totals], pa.list_(pa.int64()))})

    return blocks.groupBy("shard").applyInArrow(run, BLOCK + ", totals array<bigint>")


def _chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> tuple[DataFrame, int]:
    """((chunk, pos, id, text) bucketed by chunk, bits of the shard number). The texts are written from
    the scan, not shuffled; a chunk lies within one scan partition and so in one file."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = src.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    parts = max(1, -(-total // chunk_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, used, pos = TaskContext.get().partitionId() << 32, 0, 0
        for t in batches:
            n = t.num_rows
            size = pc.fill_null(pc.binary_length(t.column(1)), 0).to_numpy().astype(np.int64) + ROW_BYTES
            before = np.concatenate([[0], np.cumsum(size)])
            chunk, at = np.zeros(n, dtype=np.int64), 0
            while at < n:
                to = int(np.searchsorted(before, before[at] + chunk_bytes - used, side="right")) - 1
                if to <= at and used:
                    number, used = number + 1, 0
                    continue
                to = max(to, at + 1)
                chunk[at:to] = number
                used, at = used + int(before[to] - before[at]), to
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(np.arange(pos, pos + n)), *t.columns],
                                             names=["chunk", "pos", "id", "text"])
            pos += n

    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("pos", T.LongType()), *src.schema.fields])
    spark, name = docs.sparkSession, f"lm_texts_{uuid.uuid4().hex[:12]}"
    src.mapInArrow(run, schema).write.bucketBy(min(parts, MOST_BUCKETS), "chunk").option("compression", "zstd") \
        .option("path", f"{ensure_checkpoint_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name), min(24, (parts - 1).bit_length())


def _marked(texts: DataFrame, target_ids: DataFrame) -> DataFrame:
    """(chunk, at): the positions of a chunk's target texts; ids only, a chunk's rows are bounded."""
    rows = salted_join(texts.select("chunk", "pos", "id"), target_ids.distinct().hint("merge"), ["id"],
                       F.struct("chunk", "pos"), "left_semi")
    return rows.groupBy("chunk").agg(F.collect_list("pos").alias("at"))


@dataclass
class Tokens:
    """The tokens of a chunk: text (row), history and word of each; the distinct pairs with a first
    token, each token's pair, and the counts of the pairs in the chunk and its target texts."""
    rows: int
    row: np.ndarray
    a: np.ndarray
    b: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    pair: np.ndarray
    counts: list[np.ndarray]
    good: np.ndarray


def tokens(docs: pa.Table, asked: pa.Table) -> Tokens:
    found = []
    for lo, _, data, offs in pieces(docs.column("text")):
        w = words(data, offs, PUNCT)
        h = w.hashes()
        found.append((w.row + lo, histories(w.row, h), h))
    row, a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U))
    marks = [x for at in asked.column("at").to_pylist() if at for x in at]
    good = np.isin(docs.column("pos").to_numpy(), marks)[row] if len(row) else np.zeros(0, dtype=bool)
    keys, first, pair = np.unique(pair_keys(a, b), return_index=True, return_inverse=True)
    counts = [np.bincount(pair, minlength=len(keys)), np.bincount(pair[good], minlength=len(keys))]
    return Tokens(docs.num_rows, row, a, b, keys, first, pair, counts, good)


def replies(asked: pa.Table, round_: str, columns: int) -> list[np.ndarray]:
    """A round's answers to the chunk, in the order of its keys."""
    rows = [r for r in asked.select(["round", "shard", "n", "block"]).to_pylist() if r["round"] == round_]
    parts = [unpacked(r["block"], r["n"], columns) for r in sorted(rows, key=lambda r: r["shard"])]
    return [np.concatenate(x).astype(np.int64) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * columns


def vocabulary(t: Tokens, pairs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(distinct words and the start mark, [count, target count, mass, target mass] in the chunk). The mass
    of a word is the number of its kept pairs' tokens; pairs are kept by the corpus's counts."""
    every = np.unique(np.append(t.b, _U(START)))
    kept = np.maximum(*pairs) >= LEAST
    word, after = np.searchsorted(every, t.b), np.searchsorted(every, t.a[t.first])
    starts = np.searchsorted(every, _U(START))
    out = []
    for use in (np.ones(len(t.row), dtype=bool), t.good):
        n = np.bincount(word[use], minlength=len(every))
        n[starts] = (t.a[use] == _U(START)).sum()
        out.append(n)
    for n in t.counts:
        mass = np.zeros(len(every), dtype=np.int64)
        np.add.at(mass, after[kept], n[kept])
        out.append(mass)
    return every, out


def losses(t: Tokens, pairs: list[np.ndarray], every: np.ndarray, stats: list[np.ndarray], totals: list[int]) -> list[np.ndarray]:
    """Per distinct pair its loss under background and target, in units."""
    kept = np.maximum(*pairs) >= LEAST
    known = np.maximum(stats[0], stats[1]) >= LEAST
    a, b = np.searchsorted(every, t.a[t.first]), np.searchsorted(every, t.b[t.first])
    out = []
    for x in (0, 1):
        total, unknown = totals[1 + x], totals[1 + x] - totals[3 + x]
        uni = (np.where(known, stats[x], unknown) + 1.0) / float(total + totals[0] + 1)
        seen = np.maximum(stats[x], 1)
        rest = 1.0 - BIGRAM * stats[2 + x] / seen
        p = rest[a] * uni[b] + np.where(kept, BIGRAM * pairs[x] / seen[a], 0.0)
        out.append(np.rint(-np.log(p) * UNIT))
    return out


def score_documents(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id, n_tokens, ce_target, ce_background, score (their difference, nats per token)."""
    texts, bits = _chunked(docs, id_col, text_col, chunk_bytes)
    ids = target_ids.select(F.col(id_col).alias("id")).where("id IS NOT NULL")
    side = "chunk bigint, round string, shard int, n bigint, block binary, at array<bigint>"
    names = [f.split()[0] for f in side.split(", ")]

    def asked(df: DataFrame, **values) -> DataFrame:
        typed = dict(f.split() for f in side.split(", "))
        return df.select(*[values[c].alias(c) if c in values else F.col(c) if c in df.columns else
                           F.lit(None).cast(typed[c]).alias(c) for c in names])

    def ask_pairs(docs: pa.Table, known: pa.Table) -> pa.Table:
        t = tokens(docs, known)
        return sent(docs.column("chunk")[0].as_py(), bits, t.keys, t.counts)

    def ask_words(docs: pa.Table, known: pa.Table) -> pa.Table:
        t = tokens(docs, known)
        return sent(docs.column("chunk")[0].as_py(), bits, *vocabulary(t, replies(known, "pairs", 2)))

    marks = asked(stored(_marked(texts, ids), "lm-target"), round=F.lit("target"))
    by_chunk = texts.groupBy("chunk")
    pairs = stored(_summed(by_chunk.cogroup(marks.groupBy("chunk")).applyInArrow(ask_pairs, BLOCK), 2).where("chunk is not null")
                   .drop("totals"), "lm-pairs")
    known = marks.unionByName(asked(pairs, round=F.lit("pairs")))
    vocab = stored(_summed(by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(ask_words, BLOCK), 4), "lm-words")
    totals = [x or 0 for x in vocab.where("chunk is null").agg(*[F.sum(F.col("totals")[i]) for i in range(5)]).first()]
    known = known.unionByName(asked(vocab.where("chunk is not null"), round=F.lit("words")))

    def score(docs: pa.Table, known: pa.Table) -> pa.Table:
        t, pairs = tokens(docs, known), replies(known, "pairs", 2)
        every = np.unique(np.append(t.b, _U(START)))
        n = np.bincount(t.row, minlength=t.rows)
        out = []
        for loss in losses(t, pairs, every, replies(known, "words", 4), totals):
            mean = np.bincount(t.row, weights=loss[t.pair], minlength=t.rows) / UNIT / np.maximum(n, 1)
            out.append(pa.array(mean, mask=n == 0))
        return pa.table({id_col: docs.column("id"), "n_tokens": pa.array(n.astype(np.int64)), "ce_target": out[1],
                         "ce_background": out[0], "score": pc.subtract(out[1], out[0])})

    schema = T.StructType([T.StructField(id_col, texts.schema["id"].dataType), T.StructField("n_tokens", T.LongType()),
                           *[T.StructField(c, T.DoubleType()) for c in ("ce_target", "ce_background", "score")]])
    return by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(score, schema)
