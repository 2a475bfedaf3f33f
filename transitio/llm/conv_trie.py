"""Prefix trie of conversations, measured on balanced parentheses per shard.

A node is a distinct sequence of first turns. Its key is the running XOR, over the turns, of a
128-bit hash of (position, turn), so keys of all prefixes come from windowed prefix sums, in blocks
of BLOCK turns: a conversation of any length is spread over many tasks. Counts per node are plain
aggregates over the keys.

Subtree measures need the trie's shape. Nodes with one child and no end have the members of that
child, so they are drawn together with it (*runs*); what is left branches or ends. Each distinct
sequence is the list of its runs. Sequences are sorted, contiguous stretches of them are shards, and
a shard writes its part of the trie as balanced parentheses: findclose over range min-max blocks of
the excess delimits each subtree, a rank over leaf pairs counts its leaves, a cumulative array over
the opening parentheses gives its savings. A node whose sequences lie in several shards (a shared
spine) has a part in each; its own savings and leaves are written by one sequence only, so parts add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitio.llm.common import stored
from transitio.operators.skew import balanced_join

#: Turns of one conversation that a window holds.
BLOCK = 4096
#: Runs of the sequences that one shard holds (a longer sequence is a shard of its own).
SHARD_RUNS = 1 << 16
#: Parentheses per block of the range min-max tree.
PAREN_BLOCK = 64
#: conv_ids of one stretch of this many make one chunk of the text that is hashed.
ID_STRETCH = 4096
WORD = r"[^\x20\x09-\x0D]+"


def _prefix(df: DataFrame, sums: dict[str, Column], how=F.sum) -> DataFrame:
    """Add running aggregates over ``pos`` (from 1, without gaps) per ``conv``, inside blocks and then
    over the totals of the blocks before: no window holds more than BLOCK turns."""
    df = df.withColumn("_block", F.floor((F.col("pos") - 1) / BLOCK))
    for name, col in sums.items():
        df = df.withColumn(f"_own_{name}", col)
    inside = Window.partitionBy("conv", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy("conv", "_block").agg(*[how(f"_own_{n}").alias(f"_sum_{n}") for n in sums])
    before = Window.partitionBy("conv").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv", "_block", *[how(f"_sum_{n}").over(before).alias(f"_before_{n}") for n in sums]).where("_block > 0")
    out = df.withColumns({n: how(f"_own_{n}").over(inside) for n in sums}).join(totals, ["conv", "_block"], "left")
    zero = F.lit(0).cast("long")
    for n in sums:
        first = F.coalesce(f"_before_{n}", zero)
        out = out.withColumn(n, F.col(n).bitwiseXOR(first) if how is F.bit_xor else F.col(n) + first)
    return out.drop("_block", *[f"_{k}_{n}" for n in sums for k in ("own", "before")])


def _turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their positions (conv, pos, turn digest d, words) and the pieces of the sorted table
    that each conversation lies in (conv, piece, start, n, len). Positions come from one global sort, so
    that a conversation with a third of all turns lies in a third of the pieces."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn",
                                F.unhex(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256)).alias("d"),
                                F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).where("conv IS NOT NULL")
    rows = rows.orderBy("conv", F.asc_nulls_first("turn"), "d").select("conv", "d", "words", F.monotonically_increasing_id().alias("id"))
    rows = stored(rows.withColumn("piece", F.shiftright("id", 33)), "trie-turns")
    every, before = Window.partitionBy("conv"), Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("conv", "piece").agg(F.min("id").alias("start"), F.count(F.lit(1)).alias("n")) \
        .select("conv", "piece", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(every).alias("len"))
    return rows, stored(pieces, "trie-pieces")


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv, pos, d, words, last) and conversations (conv, n: turns of the rebuilt one)."""
    rows, pieces = _turns(conversations)
    group, head = F.col("conv") - F.col("conv") % 20, F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    lens = pieces.where("before = 0").select("conv", "len")
    base_len = lens.select(F.col("conv").alias("base"), F.col("len").alias("base_len"))
    lead = F.least("head", F.coalesce("base_len", F.lit(0)))
    pieces = pieces.withColumns({"base": group, "head": head}).join(base_len, "base", "left").withColumn("lead", lead) \
        .withColumn("total", F.col("lead") + F.greatest(F.col("len") - F.col("head"), F.lit(0)))
    placed = rows.join(pieces, ["conv", "piece"]).withColumn("pos", F.col("id") - F.col("start") + F.col("before") + 1)
    own = placed.where("pos > head").select("conv", (F.col("lead") + F.col("pos") - F.col("head")).alias("pos"), "d", "words", "total")
    # at most three turns per base, met by the conversations of one decade pair
    heads = placed.where("pos <= 3 AND conv % 20 = 0").select(F.col("conv").alias("base"), "pos", "d", "words")
    convs = pieces.where("before = 0").select("conv", "base", "head", "total")
    led = convs.join(heads, "base").where("pos <= head").select("conv", "pos", "d", "words", "total")
    out = own.unionByName(led).select("conv", "pos", "d", "words", (F.col("pos") == F.col("total")).alias("last"))
    return out, convs.select("conv", F.col("total").alias("n"))


def _digests(ends: DataFrame) -> DataFrame:
    """(a, b, n_ends, ends_sha256) of ends (a, b, conv): the hash of the ascending ids, comma-joined.

    Ids of one stretch of ID_STRETCH numbers are joined in parallel; SHA-256 itself runs from front to
    back, so a node's chunks stream through one task, which holds one Arrow batch of them.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = ends.groupBy("a", "b", F.floor(F.col("conv") / ID_STRETCH).alias("stretch")) \
        .agg(ids.alias("ids"), F.count(F.lit(1)).alias("n"))
    chunks = stored(chunks, "trie-ends")
    per = chunks.groupBy("a", "b").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("n_ends"))
    one = chunks.join(per.where("chunks = 1"), ["a", "b"]).select("a", "b", "n_ends", F.sha2("ids", 256).alias("ends_sha256"))
    many = chunks.join(per.where("chunks > 1"), ["a", "b"]).select("a", "b", "n_ends", "stretch", "ids") \
        .repartition("a", "b").sortWithinPartitions("a", "b", "stretch") \
        .mapInArrow(_hash_streams, "a long, b long, n_ends long, ends_sha256 string")
    return one.unionByName(many)


def _hash_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    def batch_of(rows):
        cols = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[i], pa.int64()) for i in range(3)] + [pa.array(cols[3], pa.string())],
                                          ["a", "b", "n_ends", "ends_sha256"])

    at, state, done = None, None, []
    for batch in batches:
        a, b, n, ids = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "n_ends", "ids"))
        for i in range(batch.num_rows):
            key = (a[i].as_py(), b[i].as_py(), n[i].as_py())
            if key != at:
                if at is not None:
                    done.append((*at, state.hexdigest()))
                at, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids[i].as_py().encode())
        yield batch_of(done)
        done = []
    if at is not None:
        yield batch_of([(*at, state.hexdigest())])


def find_close(bits: np.ndarray, block: int = PAREN_BLOCK) -> np.ndarray:
    """Position of the closing parenthesis of every opening one (``bits``: 1 opens, 0 closes).

    The partner of i is the first later position whose excess is below that of i. It is looked for in
    i's block, then in a tree over the blocks' least excess, then in the block that the tree names.
    """
    n = len(bits)
    excess = np.cumsum(2 * bits.astype(np.int32) - 1, dtype=np.int32)
    opens = np.flatnonzero(bits)
    goal = excess[opens] - 1
    blocks = -(-max(n, 1) // block)
    padded = np.full(blocks * block, np.iinfo(np.int32).max, dtype=np.int32)
    padded[:n] = excess
    close = np.full(len(opens), -1, dtype=np.int64)
    left = np.arange(len(opens))
    for step in range(1, block):
        left = left[(opens[left] % block + step < block)]
        if not len(left):
            break
        hit = padded[opens[left] + step] <= goal[left]
        close[left[hit]] = opens[left[hit]] + step
        left = left[~hit]
    todo = np.flatnonzero(close < 0)
    if not len(todo):
        return close
    levels = [padded.reshape(blocks, block).min(axis=1)]
    while len(levels[-1]) > 1:
        low = levels[-1]
        if len(low) % 2:
            levels[-1] = low = np.append(low, np.iinfo(np.int32).max)
        levels.append(low.reshape(-1, 2).min(axis=1))
    node, want = opens[todo] // block, goal[todo]
    at = np.zeros(len(todo), dtype=np.int64)   # level of the subtree that holds the partner
    found = np.zeros(len(todo), dtype=bool)
    for level, low in enumerate(levels[:-1]):
        open_ = ~found
        right = open_ & (node % 2 == 0)
        right[right] = low[node[right] + 1] <= want[right]
        node[right] += 1
        at[right], found[right] = level, True
        up = ~found
        node[up] //= 2
    for level in range(len(levels) - 1, 0, -1):
        down = at == level
        node[down] *= 2
        node[down] += levels[level - 1][node[down]] > want[down]
        at[down] = level - 1
    inside = padded.reshape(blocks, block)[node] <= want[:, None]
    close[todo] = node * block + inside.argmax(axis=1)
    return close


def _measure(paths: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]) -> pa.RecordBatch:
    """One shard: sorted sequences (keys a and b, savings per run, whether the last run is a leaf)."""
    bits: list[int] = [1]
    keys, own, leaf = [(0, 0)], [0], [False]
    path: list[int] = []        # nodes open below the root
    for a, b, w, is_leaf in paths:
        same = 0
        while same < len(path) and same < len(a) and keys[path[same]] == (a[same], b[same]):
            own[path[same]] += w[same]
            same += 1
        bits.extend([0] * (len(path) - same))
        del path[same:]
        for i in range(same, len(a)):
            bits.append(1)
            path.append(len(keys))
            keys.append((a[i], b[i]))
            own.append(w[i])
            leaf.append(False)
        leaf[path[-1]] = is_leaf
    bits.extend([0] * (len(path) + 1))
    parens = np.array(bits, dtype=np.int8)
    opens, close = np.flatnonzero(parens), find_close(parens)
    # a leaf pair is "()" where no other shard goes on below
    pair = np.zeros(len(parens) + 1, dtype=np.int64)
    pair[opens + 1] = np.array(leaf) & (close == opens + 1)
    pairs = np.cumsum(pair)                                   # leaf pairs that open before a position
    saved = np.concatenate([[0], np.cumsum(np.array(own, dtype=np.int64))])
    rank = np.cumsum(parens)                                  # opening parentheses up to a position
    first = np.arange(len(opens))
    arrays = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
              pa.array(pairs[close] - pairs[opens], pa.int64()), pa.array(saved[rank[close]] - saved[first], pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["a", "b", "n_leaves", "saved"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, runs = [], 0
    for batch in batches:
        a, b, w, leaf = (batch.column(batch.schema.get_field_index(c)) for c in ("ka", "kb", "w", "leaf"))
        for i in range(batch.num_rows):
            held.append((a[i].as_py(), b[i].as_py(), w[i].as_py(), leaf[i].as_py()))
            runs += len(held[-1][0])
            if runs >= SHARD_RUNS:
                yield _measure(held)
                held, runs = [], 0
    if held:
        yield _measure(held)


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 per node.

    ``conversations`` (conv_id, turn, role, text): turns are in order of ``turn``, null first; turns
    that tie are in order of the SHA-256 of role and text. Null roles and texts are empty; an empty turn
    is a turn. Rows without a conv_id belong to no conversation. Repeated rows are repeated turns. Texts
    are hashed and counted whole. Every conversation is rebuilt: the first h turns of conversation
    c - c % 20, then its own after its first h, h = crc32(c) % 4. Conversations without rebuilt turns
    are members of the root. Other columns, whatever their names, are not read. Without conversations
    there are no nodes.
    """
    spark = conversations.sparkSession
    rebuilt, convs = _rebuilt(conversations)
    convs = stored(convs, "trie-convs")
    n_all, g = convs.agg(F.count(F.lit(1)), F.min("conv")).first()
    hashed = _prefix(rebuilt, {k: F.xxhash64("d", "pos", F.lit(i)) for i, k in enumerate("ab")}, F.bit_xor)
    own = [F.xxhash64("d", "pos", F.lit(i)) for i in range(2)]
    rows = stored(hashed.select("conv", "pos", "words", "last", "a", "b", F.col("a").bitwiseXOR(own[0]).alias("pa"),
                                F.col("b").bitwiseXOR(own[1]).alias("pb")), "trie-rows")

    nodes = stored(rows.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("m"), F.min("words").alias("words"),
        F.min("pa").alias("pa"), F.min("pb").alias("pb")), "trie-nodes")
    children = nodes.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    root_ends = convs.where("n = 0").select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv")
    ends = stored(rows.where("last").select("a", "b", "conv").unionByName(root_ends), "trie-end-rows")
    digests = stored(_digests(ends), "trie-digests")
    children = stored(children, "trie-children")
    shape = stored(nodes.select("a", "b", "n_convs", "m", "words")
                   .join(children, ["a", "b"], "left").join(digests.select("a", "b", "n_ends"), ["a", "b"], "left")
                   .na.fill(0, ["n_children", "n_ends"]), "trie-shape")

    # one conversation per distinct sequence; it owns the nodes whose smallest member it is
    firsts = ends.where("a != 0 OR b != 0").groupBy("a", "b").agg(F.min("conv").alias("conv")).select("conv")
    paths = balanced_join(rows.select("conv", "pos", "a", "b"), firsts, ["conv"], F.col("pos"), "left_semi",
                          counts=convs.select("conv", "n"))
    paths = balanced_join(paths, shape, ["a", "b"], F.col("conv"), "inner", counts=shape.select("a", "b", F.col("n_convs").alias("n"))) \
        .withColumn("saving", F.when(F.col("m") == F.col("conv"), (F.col("n_convs") - 1) * F.col("words")).otherwise(0)) \
        .withColumn("stop", ((F.col("n_children") != 1) | (F.col("n_ends") > 0)).cast("long"))
    paths = _prefix(paths, {"saved_to": F.col("saving"), "stops": F.col("stop")})
    paths = stored(paths.withColumn("run", F.col("stops") - F.col("stop")), "trie-paths")
    bottom = F.struct("pos", "a", "b", "m", "n_children")
    runs = stored(paths.groupBy("conv", "run").agg(F.sum("saving").alias("w"), F.min(F.col("saved_to") - F.col("saving")).alias("w0"),
                                                   F.count(F.lit(1)).alias("n"), F.max(bottom).alias("s"))
                  .select("conv", "run", "w", "w0", "n", "s.a", "s.b", "s.m", "s.n_children"), "trie-runs")

    # a sequence has a run per branching or end above it, at most about the root of twice the number of turns
    sequences = runs.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("run", "a", "b", "w", "n_children"))).alias("p")) \
        .select(F.transform("p", lambda s: F.struct(s["a"], s["b"])).alias("key"), F.col("p.a").alias("ka"), F.col("p.b").alias("kb"),
                F.col("p.w").alias("w"), (F.element_at("p", -1)["n_children"] == 0).alias("leaf"))
    parts = sequences.orderBy("key").select("ka", "kb", "w", "leaf") \
        .mapInArrow(_shards, "a long, b long, n_leaves long, saved long")
    subtrees = stored(parts.groupBy("a", "b").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")), "trie-subtrees")

    # every node stands on the path of its owner; nodes of a run have the subtree of its bottom
    owned = paths.where("m = conv").select("conv", "pos", "a", "b", "run", "n_convs", "n_children", "saving", "saved_to")
    below = runs.where("m = conv").join(subtrees, ["a", "b"]).select("conv", "run", "w0", "n_leaves", "saved")
    measured = balanced_join(owned, below, ["conv", "run"], F.col("pos"), "inner", counts=runs.select("conv", "run", "n")) \
        .withColumn("saved_tokens", F.col("saved") - (F.col("saved_to") - F.col("saving") - F.col("w0")))
    tops = paths.groupBy("conv").agg(F.min(F.when(F.col("m") == F.col("conv"), F.col("pos"))).alias("pos"),
                                     F.max_by("m", F.when(F.col("m") != F.col("conv"), F.col("pos"))).alias("up"))
    tops = tops.select("conv", "pos", F.coalesce("up", F.lit(g).cast("long")).alias("up"))
    none = F.sha2(F.lit(""), 256)
    below_root = measured.join(tops, ["conv", "pos"], "left").join(digests.select("a", "b", "ends_sha256"), ["a", "b"], "left") \
        .select(F.col("conv").alias("conv_id"), F.col("pos").cast("long").alias("depth"), F.coalesce("up", "conv").alias("parent_conv_id"),
                "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
    def of_root(table: DataFrame, col: str, default: Column) -> Column:
        return F.coalesce(table.where("a = 0 AND b = 0").agg(F.max(col)).scalar(), default).alias(col)

    top = spark.range(1 if n_all else 0).select(
        F.lit(g).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(n_all).cast("long").alias("n_convs"), of_root(children, "n_children", F.lit(0)), of_root(subtrees, "n_leaves", F.lit(1)),
        of_root(subtrees, "saved", F.lit(0)).alias("saved_tokens"), of_root(digests, "ends_sha256", none))
    return below_root.unionByName(top)
