"""Decision trees of many fits at once: random forests and boosted trees from distributed histograms.

A *fit* is one model to train: a split seed (``key``), a held-out fold, a set of columns and its
parameters. All fits of a search grow together, level by level: one Spark job builds, for every open
node of every tree of every fit, the histogram of (column, bin) from the binned rows, adds up the
partial histograms per node and picks each node's split. The driver keeps boosted trees (bounded by
their depth limit) and the upper nodes of forests, those of more than LOCAL_ROWS rows; a forest's
smaller nodes are grown in the tasks that get their rows; whole trees are stored as a table and read by
the tasks that score, trees of nodes of large forests are not kept.

* Rows are binned once (quantiles of the training rows); a missing value has a bin of its own, and
  every split learns the side that missing values go to.
* Statistics are whole numbers (row counts, bootstrap weights, gradients in fixed point), so sums do
  not depend on the order of rows or tasks, and a plain single-process version gives equal trees.
* Randomness (bootstrap weights, row and column samples) is a hash of the row and the tree.
* Forests whose cells differ only in the number of trees, the depth limit or the least size of a
  split share their trees: a smaller forest is a prefix, a lower limit stops the walk earlier.
"""

from __future__ import annotations

import io
import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitio.session import ensure_checkpoint_dir

# The functions below run in executors' Python workers; they travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BINS = 32           # value bins per column
MISSING = MAX_BINS      # the bin of missing values
BINS = MAX_BINS + 1
EVAL = -1               # the fold of evaluation rows; no fit trains on it
BLOCK_TREES = 512       # trees that one task walks at a time
PIECE_CELLS = 1 << 20   # rows x trees that are held in memory at a time
DENSE_CELLS = 1 << 21   # histogram cells of a task that are held as one array; beyond it they are held sparse
LOCAL_ROWS = 1 << 20    # a forest's nodes of more rows are split by distributed histograms, others in one task
TASKS_PER_CORE = 4      # tasks that a search's forests are dealt to, if it has as many
LEVEL_CELLS = 1 << 17   # (node, column, bin) cells that such a task looks at at a time
UNIT = 1 << 24          # one unit of gradient in fixed point
STORE_ROUNDS = 3        # boosting rounds between two stored tables of margins
ROW_SCHEMA = "key int, row long, y int, fold int, bins binary"
TREES_SCHEMA = "fit int, tree int, body binary"
SHARES_SCHEMA = "fit int, row long, y int, step int, shares binary"
ANSWERS_SCHEMA = "fit int, held int, size int, depth int, min_split int, y int, yhat int, n long"
_U = np.uint64


def mix(x) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = np.array(x, dtype=_U)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0 ** -53


#: P(count <= i) of a Poisson distribution of mean 1: bootstrap weights by inversion.
_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, i + 1, dtype=np.float64))) for i in range(19)])


def bootstrap(rows: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """Weights (rows x trees) of a bootstrap sample, each Poisson of mean 1."""
    with np.errstate(over="ignore"):
        u = unit(mix(rows.astype(_U)[:, None] ^ mix(trees.astype(_U))[None, :]))
    return np.searchsorted(_POISSON, u, side="right").astype(np.int64)


# ---------------------------------------------------------------- rows
def bin_edges(rows: DataFrame, cols: list[str], max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Upper bounds of the bins of each column: quantiles of the present values, one aggregate."""
    probs = [i / max_bins for i in range(1, max_bins)]
    aggs = [F.percentile_approx(F.when(~F.isnan(F.col(c)), F.col(c)), probs, 100_000).alias(f"e{i}") for i, c in enumerate(cols)]
    got = rows.agg(*aggs).first()
    return [np.unique(np.array(e if e is not None else [], dtype=np.float64)) for e in got]


def binned(rows: DataFrame, cols: list[str], edges: list[np.ndarray]) -> DataFrame:
    """(key, row, y, fold, bins): one byte per column, bin b holds values up to edge b; NULL and NaN are MISSING."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.empty((batch.num_rows, len(cols)), dtype=np.uint8)
            for i in range(len(cols)):
                v = batch.column(4 + i).cast(pa.float64()).to_numpy(zero_copy_only=False)
                x[:, i] = np.where(np.isnan(v), MISSING, np.searchsorted(edges[i], v, side="left"))
            body = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + [body], ["key", "row", "y", "fold", "bins"])
    head = [F.col("key").cast("int"), F.col("row").cast("long"), F.col("y").cast("int"), F.col("fold").cast("int")]
    return rows.select(*head, *[F.col(c).cast("double") for c in cols]).mapInArrow(run, ROW_SCHEMA)


def _arrays(batch: pa.RecordBatch, width: int) -> tuple:
    """row, y, fold, bins (rows x columns) of a batch, and margins if it has them."""
    def col(name):
        return batch.column(batch.schema.get_field_index(name))
    x = np.frombuffer(b"".join(col("bins").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, width)
    margins = np.frombuffer(b"".join(col("margins").to_pylist()), dtype=np.float64).reshape(batch.num_rows, -1) \
        if "margins" in batch.schema.names else None
    return col("row").to_numpy(), col("y").to_numpy(), col("fold").to_numpy(), x, margins


# ---------------------------------------------------------------- fits and trees
@dataclass(frozen=True)
class Fit:
    """One model to train. ``held``: the fold left out, which it is scored on (EVAL: none left out)."""
    key: int
    held: int
    columns: tuple[int, ...]
    seed: int
    min_leaf: int = 1
    depth: int = 3
    rate: float = 0.1
    subsample: float = 1.0
    colsample: float = 1.0


@dataclass
class Trees:
    """Nodes of several trees in flat arrays; children are neighbours (left, left + 1)."""
    roots: np.ndarray
    feature: np.ndarray
    split: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    path: np.ndarray
    stats: np.ndarray
    tree: np.ndarray

    @staticmethod
    def planted(paths: np.ndarray, width: int) -> Trees:
        n = len(paths)
        return Trees(np.arange(n), np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n, np.int64),
                     np.zeros(n, np.int32), paths.astype(_U), np.zeros((n, width)), np.arange(n))

    def grow(self, nodes: np.ndarray, feature, split, missing_left, left_stats, right_stats) -> np.ndarray:
        """Split ``nodes``; returns their children, left and right in turn."""
        n = len(self.feature)
        kids = n + np.arange(2 * len(nodes))
        self.feature[nodes], self.split[nodes], self.missing_left[nodes], self.left[nodes] = feature, split, missing_left, kids[::2]
        two = np.repeat(nodes, 2)
        with np.errstate(over="ignore"):
            path = mix(self.path[two] * _U(2) + np.tile([0, 1], len(nodes)).astype(_U))
        stats = np.empty((len(kids), self.stats.shape[1]))
        stats[::2], stats[1::2] = left_stats, right_stats
        self.feature = np.append(self.feature, np.full(len(kids), -1, np.int32))
        self.split = np.append(self.split, np.zeros(len(kids), np.int32))
        self.missing_left = np.append(self.missing_left, np.zeros(len(kids), bool))
        self.left = np.append(self.left, np.zeros(len(kids), np.int64))
        self.depth = np.append(self.depth, self.depth[two] + 1)
        self.path = np.append(self.path, path)
        self.tree = np.append(self.tree, self.tree[two])
        self.stats = np.concatenate([self.stats, stats])
        return kids

    def walk(self, x: np.ndarray, stop: np.ndarray | None = None) -> np.ndarray:
        """Node (rows x trees) that each row ends in; nodes marked in ``stop`` count as leaves."""
        inner = self.feature >= 0 if stop is None else (self.feature >= 0) & ~stop
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        if not inner.any():
            return at
        row = np.arange(len(x))[:, None]
        while True:
            go = inner[at]
            if not go.any():
                return at
            v = x[row, np.maximum(self.feature[at], 0)]
            to_left = np.where(v == MISSING, self.missing_left[at], v <= self.split[at])
            at = np.where(go, self.left[at] + ~to_left, at)


@dataclass
class Block:
    """Fits of one key whose trees are walked together, and the rows they read."""
    rows: DataFrame
    fits: list[Fit]
    fit_of: np.ndarray                      # fit of every tree
    trees: Trees
    tree_seed: np.ndarray
    open: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    columns: np.ndarray | None = None       # candidate columns of the open nodes
    # forests: the trees' numbers, nodes that are grown where they are scored, limits of growth
    tree_id: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    frontier: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    max_depth: int = 0
    min_split: int = 2


def _trained(fits: list[Fit], fold: np.ndarray) -> np.ndarray:
    """Which rows each fit trains on (rows x fits)."""
    held = np.array([f.held for f in fits])
    return (fold[:, None] != EVAL) & (fold[:, None] != held[None, :])


def _sum_keys(keys: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, vals = keys[order], vals[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(vals, at, axis=0) if len(at) else vals


def _same_columns(tree: np.ndarray, columns: np.ndarray) -> list[tuple[int, int, int, np.ndarray]] | None:
    """(tree, first node, last node + 1, columns) if the nodes of every tree have equal columns, else None."""
    out = []
    for t in np.unique(tree).tolist():
        mine = np.flatnonzero(tree == t)
        if (columns[mine] != columns[mine[0]]).any():
            return None
        cols = columns[mine[0]]
        out.append((t, int(mine[0]), int(mine[-1]) + 1, cols[cols >= 0]))
    return out


def _partials(block: Block, width: int, cells: int, values: Callable, n_values: int, base: int) -> Callable:
    """Map side: histograms of the open nodes over the rows of one task, as sparse (cell, sums) per node.

    ``values(row arrays, trees' nodes)`` gives each (row, tree)'s weight, its offset inside a (column,
    bin) cell and its addends. A node's histogram has columns x BINS x ``cells`` cells.
    """
    fits, fit_of, trees, columns = block.fits, block.fit_of, block.trees, block.columns
    slot_of = np.full(len(trees.feature), -1, np.int64)
    slot_of[block.open] = np.arange(len(block.open))
    k = columns.shape[1]
    size = k * BINS * cells
    cells_all = len(block.open) * size
    # trees whose open nodes all have the same columns (boosted ones) are counted tree by tree
    shared = _same_columns(trees.tree[block.open], columns) if cells_all <= DENSE_CELLS else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((cells_all, n_values), dtype=np.int64) if cells_all <= DENSE_CELLS else None
        keys, vals, held = [], [], 0
        piece = max(1, PIECE_CELLS // max(1, len(trees.roots)))
        place = (np.arange(k) * BINS)[None, :]
        for batch in batches:
            row, y, fold, x, margins = _arrays(batch, width)
            for a in range(0, len(row), piece):
                s = slice(a, a + piece)
                xs = x[s]
                weight, offset, addends = values(row[s], y[s], xs, None if margins is None else margins[s])
                weight = weight * _trained(fits, fold[s])[:, fit_of]
                slot = slot_of[trees.walk(xs)]
                if shared is not None:
                    for t, lo, hi, cols in shared:
                        r = np.flatnonzero((slot[:, t] >= 0) & (weight[:, t] > 0))
                        if not len(r):
                            continue
                        add = addends(r, t, weight[r, t])
                        key = ((slot[r, t] - lo) * size + offset(r))[:, None] + (place[:, :len(cols)] + xs[r[:, None], cols]) * cells
                        for v in range(n_values):   # whole numbers below 2^53 add up exactly as doubles
                            many = None if (add[:, v] == 1).all() else np.repeat(add[:, v], len(cols))
                            dense[lo * size:hi * size, v] += np.bincount(key.ravel(), weights=many, minlength=(hi - lo) * size).astype(np.int64)
                    continue
                rows_, trees_ = np.nonzero((slot >= 0) & (weight > 0))
                for c in range(0, len(rows_), max(1, PIECE_CELLS // k)):
                    r, t = rows_[c:c + max(1, PIECE_CELLS // k)], trees_[c:c + max(1, PIECE_CELLS // k)]
                    add, at = addends(r, t, weight[r, t]), slot[r, t]
                    cols = columns[at]
                    key = (at * size + offset(r))[:, None] + (place + xs[r[:, None], cols]) * cells
                    ok = cols >= 0
                    if dense is not None:
                        flat = key[ok]
                        for v in range(n_values):   # whole numbers below 2^53 add up exactly as doubles
                            many = np.broadcast_to(add[:, v:v + 1], ok.shape)[ok]
                            dense[:, v] += np.bincount(flat, weights=many, minlength=cells_all).astype(np.int64)
                        continue
                    keys.append(key[ok])
                    vals.append(np.broadcast_to(add[:, None], (*ok.shape, n_values))[ok])
                    held += len(keys[-1])
                    if held > PIECE_CELLS * 4:
                        one = _sum_keys(np.concatenate(keys), np.concatenate(vals))
                        keys, vals, held = [one[0]], [one[1]], len(one[0])
        if dense is not None:
            key = np.flatnonzero(dense[:, n_values - 1])
            val = dense[key]
        elif keys:
            key, val = _sum_keys(np.concatenate(keys), np.concatenate(vals))
        else:
            key = np.zeros(0, np.int64)
        if not len(key):
            return
        slots, first = np.unique(key // size, return_index=True)
        ends = np.append(first[1:], len(key))
        for c in range(0, len(slots), 1024):
            part = range(c, min(c + 1024, len(slots)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + int(slots[i]) for i in part], pa.int64()),
                 pa.array([(key[first[i]:ends[i]] - slots[i] * size).astype(np.int32).tobytes() for i in part], pa.binary()),
                 pa.array([val[first[i]:ends[i]].tobytes() for i in part], pa.binary())], ["slot", "cells", "sums"])
    return run


def _reduce(shape: tuple[int, ...], n_values: int, choose: Callable, width: int) -> Callable:
    """Reduce side: add up the partial histograms of each node (they arrive in order) and choose its split."""
    size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, hists = [], []
        most = max(1, (1 << 22) // (size * n_values))

        def out():
            chosen = choose(np.array(slots), np.stack(hists).reshape(len(slots), *shape, n_values))
            return pa.RecordBatch.from_arrays(
                [pa.array(slots, pa.int64()), *[pa.array(c, t) for c, t in zip(chosen[:3], (pa.int32(), pa.int32(), pa.bool_()))],
                 *[pa.array([r.tobytes() for r in c.astype(np.float64)], pa.binary()) for c in chosen[3:]]],
                ["slot", "feature", "split", "missing_left", "total", "left"])
        for batch in batches:
            for i in range(batch.num_rows):
                slot = batch.column(0)[i].as_py()
                if not slots or slots[-1] != slot:
                    if len(slots) >= most:
                        yield out()
                        slots, hists = [], []
                    slots.append(slot)
                    hists.append(np.zeros((size, n_values), dtype=np.int64))
                cells = np.frombuffer(batch.column(1)[i].as_py(), dtype=np.int32)
                hists[-1][cells] += np.frombuffer(batch.column(2)[i].as_py(), dtype=np.int64).reshape(-1, n_values)
        if slots:
            yield out()
    return run


def _best(score: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First best (column, bin, side of missing) of scores (nodes, columns, bins, 2)."""
    flat = np.where(valid, score, -np.inf).reshape(len(score), -1)
    at = flat.argmax(axis=1)
    return at, flat[np.arange(len(flat)), at], valid.reshape(len(score), -1).any(axis=1)


def _sides(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left sums of every split (nodes, columns, bins, missing right / left, values) and totals; without
    missing values there is one side only."""
    left = np.cumsum(hist[:, :, :MAX_BINS], axis=2)
    miss = hist[:, :, MISSING:MISSING + 1]
    total = left[:, :, -1:] + miss
    return (np.stack([left, left + miss], axis=3) if miss.any() else left[:, :, :, None]), total


def choose_gini(columns: np.ndarray, min_leaf: np.ndarray, classes: int) -> Callable:
    """Split of the lowest weighted Gini impurity; both sides hold at least ``min_leaf`` rows.
    Histograms (node, column, bin, class, [weight, rows])."""
    def run(slots, hist):
        cols = columns[slots]
        h = np.concatenate([hist[..., 0], hist[..., 1].sum(axis=3, keepdims=True)], axis=3)   # class weights, rows
        left, total = _sides(h)
        right = total[:, :, :, None] - left
        nl, nr = left[..., :classes].sum(-1).astype(np.float64), right[..., :classes].sum(-1).astype(np.float64)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = (left[..., :classes].astype(np.float64) ** 2).sum(-1) / nl + (right[..., :classes].astype(np.float64) ** 2).sum(-1) / nr
        least = min_leaf[slots][:, None, None, None]
        valid = (left[..., classes] >= least) & (right[..., classes] >= least) & (nl > 0) & (nr > 0) & (cols >= 0)[:, :, None, None]
        at, best, any_ = _best(score, valid)
        tot = total[:, 0, 0].astype(np.float64)
        whole = (tot[:, :classes] ** 2).sum(-1) / np.maximum(tot[:, :classes].sum(-1), 1)
        ok = any_ & (best > whole * (1 + 1e-12))
        return _chosen(at, ok, left, total, cols, classes)
    return run


def choose_gain(columns: np.ndarray, penalty: float = 1.0, min_weight: float = 1.0) -> Callable:
    """Split of the largest second-order gain with a penalty on leaf weights; both sides hold at least
    ``min_weight`` of hessian. Histograms (node, column, bin, [gradient, hessian, rows]) in fixed point."""
    def run(slots, hist):
        cols = columns[slots]
        left, total = _sides(hist[:, :, :, 0])
        right = total[:, :, :, None] - left

        def value(s):
            return (s[..., 0] / UNIT) ** 2 / (s[..., 1] / UNIT + penalty)
        gain = value(left) + value(right) - value(total)[:, :, :, None]
        least = min_weight * UNIT
        valid = (left[..., 1] >= least) & (right[..., 1] >= least) & (left[..., 2] > 0) & (right[..., 2] > 0) \
            & (cols >= 0)[:, :, None, None]
        at, best, any_ = _best(gain, valid)
        return _chosen(at, any_ & (best > 1e-6), left, total, cols, 2)
    return run


def _chosen(at, ok, left, total, cols, count):
    n, k = left.shape[:2]
    j, b, side = np.unravel_index(at, left.shape[1:4])
    i = np.arange(n)
    chosen, tot = left[i, j, b, side], total[:, 0, 0]
    # without missing values in the node they go with the larger side
    no_missing = left[i, j, b, 0, count] == left[i, j, b, -1, count]
    goes_left = np.where(no_missing, 2 * chosen[:, count] > tot[:, count], side == 1)
    return np.where(ok, cols[i, j], -1).astype(np.int32), b.astype(np.int32), goes_left, tot, chosen


def _level(blocks: list[Block], width: int, cells: int, values: list[Callable], n_values: int, choose: Callable) -> None:
    """One level of all blocks: histograms, splits, children. Afterwards ``open`` holds the new children."""
    work, base = None, 0
    bases = []
    for block, value in zip(blocks, values):
        bases.append(base)
        if len(block.open):
            part = block.rows.mapInArrow(_partials(block, width, cells, value, n_values, base), "slot long, cells binary, sums binary")
            work = part if work is None else work.unionByName(part)
        base += len(block.open)
    if work is None:
        return
    k = max(b.columns.shape[1] for b in blocks if len(b.open))
    shape = (k, BINS, cells)
    rows = work.repartition("slot").sortWithinPartitions("slot").mapInArrow(
        _reduce(shape, n_values, choose, width),
        "slot long, feature int, split int, missing_left boolean, total binary, left binary").collect()  # a row per open node
    by_slot = sorted(rows, key=lambda r: r.slot)
    slots = np.array([r.slot for r in by_slot], dtype=np.int64)
    feature = np.array([r.feature for r in by_slot], dtype=np.int32)
    split = np.array([r.split for r in by_slot], dtype=np.int32)
    missing = np.array([r.missing_left for r in by_slot], dtype=bool)
    total = np.array([np.frombuffer(r.total) for r in by_slot])
    left = np.array([np.frombuffer(r.left) for r in by_slot])
    for block, base in zip(blocks, bases):
        mine = (slots >= base) & (slots < base + len(block.open))
        nodes = block.open[slots[mine] - base]
        block.trees.stats[nodes] = total[mine]
        ok = feature[mine] >= 0
        tot, lft = total[mine][ok], left[mine][ok]
        block.open = block.trees.grow(nodes[ok], feature[mine][ok], split[mine][ok], missing[mine][ok], lft, tot - lft)


def _stack_columns(blocks: list[Block]) -> np.ndarray:
    """Candidate columns of all open nodes, padded with -1 to one width."""
    k = max([b.columns.shape[1] for b in blocks if len(b.open)], default=1)
    for b in blocks:
        pad = k - b.columns.shape[1]
        if pad:
            b.columns = np.concatenate([b.columns, np.full((len(b.columns), pad), -1, b.columns.dtype)], axis=1)
    return np.concatenate([b.columns for b in blocks if len(b.open)])


def sampled_columns(paths: np.ndarray, columns: np.ndarray, k: int) -> np.ndarray:
    """``k`` of the columns per path, those of the smallest hashes, in ascending order."""
    with np.errstate(over="ignore"):
        h = mix(paths.astype(_U)[:, None] ^ mix(columns.astype(_U) + _U(1))[None, :])
    return np.sort(columns[np.argsort(h, axis=1, kind="stable")[:, :k]], axis=1)


def _blocks(rows: DataFrame, fits: list[Fit], per_fit: int, step: int, tree_seeds: Callable[[Fit], np.ndarray], width: int) -> list[Block]:
    """Blocks of ``step`` fits of one key, ``per_fit`` trees each."""
    out, by_key = [], {}
    for f in fits:
        by_key.setdefault(f.key, []).append(f)
    for key, mine in by_key.items():
        for a in range(0, len(mine), step):
            part = mine[a:a + step]
            seeds = np.concatenate([tree_seeds(f) for f in part])
            out.append(Block(rows.where(F.col("key") == key), part, np.repeat(np.arange(len(part)), per_fit),
                             Trees.planted(mix(seeds), width), seeds))
    return out


def in_order(blocks: list[Block]) -> list[Fit]:
    """The fits by the number that the score tables give them."""
    return [f for fits in dict.fromkeys(tuple(b.fits) for b in blocks) for f in fits]


# ---------------------------------------------------------------- random forests
def grow_forests(rows: DataFrame, width: int, classes: int, fits: list[Fit], n_trees: int, max_depth: int,
                 min_split: int = 2) -> list[Block]:
    """``n_trees`` trees for every fit, on bootstrap weights and sqrt(columns) candidates per node.

    ``rows`` as ``binned`` gives them, ``width`` columns. A node is split while it is impure, shallower
    than ``max_depth`` and holds ``min_split`` rows. Node statistics: class weights, then rows.

    Grown here are only the nodes of more than LOCAL_ROWS rows; the driver holds those and their
    children (``frontier``: still to be grown). ``score_forests`` grows the rest in its tasks, one tree
    after the other: an unlimited tree has about as many nodes as rows.
    """
    step = max(1, min(n_trees, BLOCK_TREES))
    blocks, per_block = [], max(1, BLOCK_TREES // step)
    for a in range(0, n_trees, step):
        ids = np.arange(a, min(a + step, n_trees))
        made = _blocks(rows, fits, len(ids), per_block, lambda f, ids=ids: mix(mix(np.full(len(ids), f.seed)) + ids.astype(_U)), classes + 1)
        for b in made:
            b.tree_id = np.tile(ids, len(b.fits))
        blocks += made
    held = {(r["key"], r["fold"]): r["n"] for r in rows.where(F.col("fold") != EVAL).groupBy("key", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    for b in blocks:
        b.max_depth, b.min_split = max_depth, min_split
        most = np.array([sum(n for (key, fold), n in held.items() if key == f.key and fold != f.held) for f in b.fits])
        large = most[b.fit_of] > LOCAL_ROWS
        b.open, b.frontier = b.trees.roots[large], b.trees.roots[~large]

    def bootstrapped(block: Block) -> Callable:
        seeds = block.tree_seed

        def run(row, y, x, margins):
            return bootstrap(row, seeds), lambda r: y[r], lambda r, t, w: np.stack([w, np.ones(len(w), np.int64)], axis=1)
        return run

    while any(len(b.open) for b in blocks):
        for b in blocks:
            b.columns = np.full((len(b.open), 1), -1, np.int64)
            fit = b.fit_of[b.trees.tree[b.open]]
            for i, f in enumerate(b.fits):
                mine = np.flatnonzero(fit == i)
                k = max(1, int(np.sqrt(len(f.columns))))
                if len(mine):
                    if b.columns.shape[1] < k:
                        b.columns = np.concatenate([b.columns, np.full((len(b.open), k - b.columns.shape[1]), -1, np.int64)], axis=1)
                    b.columns[mine, :k] = sampled_columns(b.trees.path[b.open[mine]], np.array(f.columns, dtype=np.int64), k)
        columns = _stack_columns(blocks)
        least = np.concatenate([np.array([f.min_leaf for f in b.fits])[b.fit_of[b.trees.tree[b.open]]] for b in blocks if len(b.open)])
        _level(blocks, width, classes, [bootstrapped(b) for b in blocks], 2, choose_gini(columns, least, classes))
        for b in blocks:
            kids = b.open[_splittable(b.trees, b.open, classes, min_split, max_depth)]
            large = b.trees.stats[kids, classes] > LOCAL_ROWS
            b.open, b.frontier = kids[large], np.append(b.frontier, kids[~large])
    return blocks


def _splittable(trees: Trees, nodes: np.ndarray, classes: int, min_split: int, max_depth: int) -> np.ndarray:
    s = trees.stats[nodes]
    return ((s[:, :classes] > 0).sum(axis=1) > 1) & (s[:, classes] >= min_split) & (trees.depth[nodes] < max_depth)


def _gini_splits(x: np.ndarray, y: np.ndarray, weight: np.ndarray, at: np.ndarray, columns: np.ndarray, min_leafs: list[int],
                 classes: int) -> list[tuple]:
    """``choose_gini`` for nodes whose rows are at hand (row i is in node ``at[i]`` of ``len(columns)``), over the
    bins that occur: per least leaf size (ascending) the nodes that are split, column, bin, missing left, totals,
    left sums and the split's place among those of its node."""
    n, k = columns.shape
    piece = max(1, PIECE_CELLS // k)
    pieces = [slice(a, a + piece) for a in range(0, len(x), piece)]
    key, count = np.empty((len(x), k), np.int32), np.zeros(n * k * BINS, np.int64)
    for s in pieces:
        key[s] = (at[s, None] * k + np.arange(k)) * BINS + np.take_along_axis(x[s], columns[at[s]], axis=1)
        count += np.bincount(key[s].ravel(), minlength=len(count))
    cell = np.flatnonzero(count)                            # (node, column, bin) that occur, in order
    place = np.zeros(n * k * BINS, np.int64)
    place[cell] = np.arange(len(cell))
    held = count[cell].astype(np.float64)                   # rows; all sums are whole numbers, exact as doubles
    stat = np.zeros(len(cell) * classes)
    for s in pieces:
        stat += np.bincount((place[key[s]] * classes + y[s, None]).ravel(), weights=np.repeat(weight[s], k), minlength=len(stat))
    stat = stat.reshape(-1, classes)
    part, bin_ = cell // BINS, cell % BINS                  # part: (node, column)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    part_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(cell))))
    last = np.append(first[1:], len(cell)) - 1
    some = bin_[last] == MISSING                            # parts with missing values
    miss, miss_rows = np.where(some[:, None], stat[last], 0.0), np.where(some, held[last], 0.0)
    total, rows = np.add.reduceat(stat, first, axis=0), np.add.reduceat(held, first)
    stat[first[1:]] -= total[:-1]                           # every part's running sums start anew
    held[first[1:]] -= rows[:-1]
    left, lrows, of, b, side = np.cumsum(stat, axis=0), np.cumsum(held), part_of, bin_, np.zeros(len(cell), np.int64)
    if some.any():
        value = np.flatnonzero(bin_ != MISSING)
        both = value[some[part_of[value]]]                  # the same splits with missing values on the left
        lone = np.flatnonzero(some & (bin_[first] > 0))     # missing values alone on the left of bin 0
        of = np.concatenate([part_of[value], part_of[both], lone])
        left = np.concatenate([left[value], left[both] + miss[part_of[both]], miss[lone]])
        lrows = np.concatenate([lrows[value], lrows[both] + miss_rows[part_of[both]], miss_rows[lone]])
        b = np.concatenate([bin_[value], bin_[both], np.zeros(len(lone), np.int64)])
        side = np.repeat([0, 1, 1], [len(value), len(both), len(lone)])
    ones = np.ones(classes)
    whole, squares = total @ ones, np.einsum("ij,ij->i", total, total)
    nl, rrows = left @ ones, rows[of] - lrows
    nr = whole[of] - nl
    ok = np.flatnonzero((lrows >= min_leafs[0]) & (rrows >= min_leafs[0]) & (nl > 0) & (nr > 0))
    ll = np.einsum("ij,ij->i", left, left)
    lt = np.einsum("ij,ij->i", left, total[of])
    of, side, b, smaller = of[ok], side[ok], b[ok], np.minimum(lrows, rrows)[ok]
    node, j = np.divmod(part[first][of], k)
    score = ll[ok] / nl[ok] + (squares[of] - 2 * lt[ok] + ll[ok]) / nr[ok]   # squares of the left and the right sums
    order = (j * BINS + b) * 2 + side

    def pick(among: np.ndarray) -> np.ndarray:
        """The first of the best ones of every node."""
        best, early = np.full(n, -np.inf), np.full(n, k * BINS * 2)
        np.maximum.at(best, node[among], score[among])
        hit = among[score[among] == best[node[among]]]
        np.minimum.at(early, node[hit], order[hit])
        won = hit[order[hit] == early[node[hit]]]
        return won[score[won] > squares[of[won]] / np.maximum(whole[of[won]], 1) * (1 + 1e-12)]
    won, out = pick(np.arange(len(ok))), []
    for least in min_leafs:
        short = smaller[won] < least                        # the other nodes' best splits stay the best
        if short.any():
            again = np.zeros(n, bool)
            again[node[won[short]]] = True
            won = np.concatenate([won[~short], pick(np.flatnonzero(again[node] & (smaller >= least)))])
        won = won[np.argsort(node[won])]
        lft = np.column_stack([left[ok[won]], lrows[ok[won]]])
        tot = np.column_stack([total[of[won]], rows[of[won]]])
        goes_left = np.where(some[of[won]], side[won] == 1, 2 * lft[:, classes] > tot[:, classes])
        out.append((node[won], columns[node[won], j[won]], b[won], goes_left, tot, lft, order[won]))
    return out


def _finish(trees: list[Trees], open_: np.ndarray, fits: list[Fit], x: np.ndarray, y: np.ndarray, weight: np.ndarray, at: np.ndarray,
            classes: int, min_split: int, max_depth: int) -> None:
    """Grow a node of one tree of every fit to the end from its rows. The fits differ in ``min_leaf`` only (ascending).

    ``open_`` holds the node's number in every fit's tree, row i is in ``open_[at[i]]``. As long as fits choose the
    same splits a node is theirs in common and looked at once; where one chooses another, it gets nodes of its own.
    """
    columns = np.array(fits[0].columns, dtype=np.int64)
    k, leafs = max(1, int(np.sqrt(len(columns)))), [f.min_leaf for f in fits]
    rows = np.argsort(at, kind="stable")
    at = at[rows]
    for w, ids in enumerate(open_):
        mine = rows[at == w]
        for t, i in zip(trees, ids):
            t.stats[i] = np.append(np.bincount(y[mine], weights=weight[mine], minlength=classes), len(mine))
    while len(open_):
        n = len(open_)
        paths = np.zeros(n, _U)
        for t, ids in zip(trees, open_.T):
            paths[ids >= 0] = t.path[ids[ids >= 0]]
        most, got = max(1, LEVEL_CELLS // (k * BINS)), []
        for a in range(0, n, most):
            mine = slice(*np.searchsorted(at, [a, a + most]))
            if at[mine].size:
                r = rows[mine]
                for i, one in enumerate(_gini_splits(x[r], y[r], weight[r], at[mine] - a, sampled_columns(paths[a:a + most], columns, k),
                                                     leafs, classes)):
                    got.append((i, one[0] + a, *one[1:]))
        # every fit's tree gets its nodes; of the nodes at work, which split each fit chose
        place, kid = np.full((len(fits), n), -1), np.full((len(fits), n), -1)
        column, bin_, side = np.zeros((len(fits), n), np.int64), np.zeros((len(fits), n), np.int64), np.zeros((len(fits), n), bool)
        for i, (t, ids) in enumerate(zip(trees, open_.T)):
            mine = [g[1:] for g in got if g[0] == i]
            if not mine:
                continue
            node, feature, split, missing_left, total, left, order = (np.concatenate(c) for c in zip(*mine))
            own = np.flatnonzero(ids[node] >= 0)
            own = own[np.argsort(ids[node[own]])]           # a level's nodes lie in the order of their parents
            node = node[own]
            kid[i, node] = t.grow(ids[node], feature[own], split[own], missing_left[own], left[own], (total - left)[own])[::2]
            place[i, node], column[i, node], bin_[i, node], side[i, node] = order[own], feature[own], split[own], missing_left[own]
        kids, moved, base = [], [], 0
        for i in range(len(fits)):
            first = np.flatnonzero((place[i] >= 0) & (place[:i] != place[i]).all(axis=0))
            pair = np.full((2 * len(first), len(fits)), -1)
            for o in range(i, len(fits)):
                same = np.flatnonzero(place[o, first] == place[i, first])
                pair[2 * same, o], pair[2 * same + 1, o] = kid[o, first[same]], kid[o, first[same]] + 1
            slot = np.full(n, -1)
            slot[first] = base + 2 * np.arange(len(first))
            here = np.flatnonzero(slot[at] >= 0)
            r, w = rows[here], at[here]
            v = x[r, column[i, w]]
            moved.append((r, slot[w] + ~np.where(v == MISSING, side[i, w], v <= bin_[i, w])))
            kids.append(pair)
            base += len(pair)
        open_ = np.concatenate(kids)
        go = np.zeros(len(open_), bool)
        for t, ids in zip(trees, open_.T):
            go[ids >= 0] = _splittable(t, ids[ids >= 0], classes, min_split, max_depth)
        slot = np.where(go, np.cumsum(go) - 1, -1)
        rows, at = (np.concatenate(c) for c in zip(*moved))
        at = slot[at]
        rows, at = rows[at >= 0], at[at >= 0]
        order = np.argsort(at, kind="stable")
        rows, at, open_ = rows[order], at[order], open_[go]


def _stops(trees: Trees, root: int, stop: np.ndarray) -> np.ndarray:
    """For every node of the tree under ``root`` the node that a walk ends in if it ends at nodes marked in ``stop``."""
    ends, level = np.arange(len(trees.feature)), np.array([root])
    while len(level):
        level = level[trees.feature[level] >= 0]
        kids = trees.left[level][:, None] + np.arange(2)
        above = ends[level]
        ends[kids] = np.where(stop[above][:, None], above[:, None], kids)
        level = kids.ravel()
    return ends


@dataclass
class Unit:
    """What one task grows of a large fit: a terminal node of a tree's upper part."""
    block: int
    fit: int
    trees: np.ndarray
    node: int


def _local(block: Block) -> np.ndarray:
    """Which fits of a block are grown whole in a task (their trees have no upper part)."""
    out = np.ones(len(block.fits), bool)
    out[block.fit_of[~np.isin(block.trees.roots, block.frontier)]] = False
    return out


def _units(blocks: list[Block]) -> list[Unit]:
    """The terminal nodes of the upper parts."""
    return [Unit(i, f, np.array([t]), int(n)) for i, b in enumerate(blocks) for f in np.flatnonzero(~_local(b)).tolist()
            for t in np.flatnonzero(b.fit_of == f) for n in np.flatnonzero((b.trees.tree == t) & (b.trees.feature < 0))]


def _only(trees: Trees, tree: int) -> Trees:
    """The nodes of one tree."""
    mine = np.flatnonzero(trees.tree == tree)
    new = np.zeros(len(trees.feature), np.int64)
    new[mine] = np.arange(len(mine))
    return Trees(new[trees.roots[tree:tree + 1]], trees.feature[mine], trees.split[mine], trees.missing_left[mine], new[trees.left[mine]],
                 trees.depth[mine], trees.path[mine], trees.stats[mine], np.zeros(len(mine), np.int64))


def score_forests(blocks: list[Block], width: int, classes: int, sizes: list[int], depths: list[int],
                  splits: list[int]) -> DataFrame:
    """(fit, held, size, depth, min_split, y, yhat, n): predictions of every fit and cell on its scored
    rows, counted. A forest's answer is the class of the largest mean leaf share. ``fit`` is the number in
    ``in_order(blocks)``.

    Trees are grown by tasks that read the key's rows where they are stored, some trees of one fit each, and
    written to a table; a task of the scoring reads the trees of a fit and its rows, adds up the leaf shares of
    its scored rows and counts the answers. Where there are many fits, a task does both for all trees of a fit
    and nothing is stored. Neither rows nor shares are shuffled. Of fits with upper parts the
    rows go to the tasks that grow a node (``Unit``), and their shares are shuffled.
    """
    sizes = sorted(sizes)
    order = {f: i for i, f in enumerate(in_order(blocks))}
    cells = [(d, s) for d in depths for s in splits]
    sums, counts = [], []
    grow, score = _tasks(blocks, order)
    if grow and not score:
        b = blocks[0]
        counts.append(_side_by_side([rows.coalesce(1).mapInArrow(_grow_and_score(plan, b.max_depth, b.min_split, width, classes, sizes, cells), ANSWERS_SCHEMA)
                                     for rows, plan in grow], ANSWERS_SCHEMA))
    elif grow:
        spark, b = blocks[0].rows.sparkSession, blocks[0]
        path = f"{ensure_checkpoint_dir(spark)}/forest-trees-{uuid.uuid4().hex[:12]}"
        _side_by_side([rows.coalesce(1).mapInArrow(_grow_rows(plan, b.max_depth, b.min_split, width, classes), TREES_SCHEMA)
                       for rows, plan in grow], TREES_SCHEMA).write.partitionBy("fit").parquet(path)
        grown = spark.read.schema(TREES_SCHEMA).parquet(path)
        parts = []
        for rows, plan in score:
            trees = grown.where(F.col("fit").isin([i for i, _, _ in plan]))
            both = rows.select("row", "y", "fold", "bins").unionByName(trees, allowMissingColumns=True)
            parts.append(both.coalesce(1).mapInArrow(_score_rows(plan, width, classes, sizes, cells), ANSWERS_SCHEMA))
        counts.append(_side_by_side(parts, ANSWERS_SCHEMA))
    units = _units(blocks)
    by_key: dict[int, list[int]] = {}
    for i, u in enumerate(units):
        by_key.setdefault(blocks[u.block].fits[u.fit].key, []).append(i)
    sent = None
    for mine in by_key.values():
        b = blocks[units[mine[0]].block]
        one = b.rows.mapInArrow(_route(blocks, {i: units[i] for i in mine}, width), "unit int, row long, y int, fold int, bins binary")
        sent = one if sent is None else sent.unionByName(one)
    if sent is not None:
        n = min(len(units), 16 * blocks[0].rows.sparkSession.sparkContext.defaultParallelism)
        sums.append(sent.repartition(n, "unit").groupBy("unit").applyInArrow(
            _grow_units(blocks, units, order, width, classes, sizes, cells), SHARES_SCHEMA))
    if sums:
        held = {i: f.held for f, i in order.items()}
        both = sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1])
        counts.append(both.repartition("fit", "row").sortWithinPartitions("fit", "row").mapInArrow(_answers(held, classes, sizes, cells), ANSWERS_SCHEMA))
    out = counts[0] if len(counts) == 1 else counts[0].unionByName(counts[1])
    keys = ["fit", "held", "size", "depth", "min_split", "y", "yhat"]
    return out.groupBy(*keys).agg(F.sum("n").alias("n"))


def _tasks(blocks: list[Block], order: dict[Fit, int]) -> tuple[list[tuple[DataFrame, list]], list[tuple[DataFrame, list]]]:
    """A key's rows and a plan for every task of the fits that are grown whole. Growing: (fits that differ in
    ``min_leaf`` only and their numbers, trees and their seeds); scoring: (fit's number, fit, part of its rows),
    none if there are enough fits for the tasks that grow all trees of one."""
    of: dict[Fit, list[Block]] = {}
    for b in blocks:
        for f, local in zip(b.fits, _local(b)):
            if local:
                of.setdefault(f, []).append(b)
    if not of:
        return [], []
    rows = {f.key: own[0].rows for f, own in of.items()}
    cores = blocks[0].rows.sparkSession.sparkContext.defaultParallelism
    alike: dict[Fit, list[Fit]] = {}
    # fits that train on more rows first: those without a fold held out
    for f in sorted(of, key=lambda f: (f.held != EVAL, f.min_leaf)):
        alike.setdefault(replace(f, min_leaf=0), []).append(f)
    grow, score = [], []
    split = TASKS_PER_CORE * cores // len(alike)
    for fits in alike.values():
        mine = [(b, np.flatnonzero(b.fit_of == b.fits.index(fits[0]))) for b in of[fits[0]]]
        ids, seeds = (np.concatenate([getattr(b, c)[m] for b, m in mine]) for c in ("tree_id", "tree_seed"))
        parts = min(len(ids), max(1, split))
        grow += [(fits[0].key, ([(order[f], f) for f in fits], ids[a::parts], seeds[a::parts])) for a in range(parts)]
    for f in (f for fits in alike.values() for f in fits if split > 1):
        parts = max(1, cores // len(of))
        score += [(f.key, (order[f], f, (a, parts))) for a in range(parts)]

    def dealt(items):
        slots = max(1, TASKS_PER_CORE * cores // len(rows))
        by_key = {key: [p for k, p in items if k == key] for key in rows}
        return [(rows[key], by_key[key][a::slots]) for a in range(slots) for key in rows if by_key[key][a::slots]]
    return dealt(grow), dealt(score)


def _side_by_side(parts: list[DataFrame], schema: str) -> DataFrame:
    """DataFrames of one partition each, in as many tasks (their union as DataFrames may be one task)."""
    spark = parts[0].sparkSession
    return spark.createDataFrame(spark.sparkContext.union([p.rdd for p in parts]), schema, verifySchema=False)


def _add_shares(shares: np.ndarray, trees: Trees, xs: np.ndarray, cells: list[tuple[int, int]], classes: int) -> None:
    """Add one tree's leaf shares to those of the rows ``xs`` (cells x rows x classes)."""
    leaf = trees.walk(xs)[:, 0]
    rows_in = trees.stats[:, classes]
    share = trees.stats[:, :classes] / np.maximum(trees.stats[:, :classes].sum(axis=1, keepdims=True), 1)
    for c, (depth, least) in enumerate(cells):
        shares[c] += share[_stops(trees, int(trees.roots[0]), (trees.depth >= depth) | (rows_in < least))[leaf]]


def _shares(fit: int, row: np.ndarray, y: np.ndarray, step: int, shares: np.ndarray) -> pa.RecordBatch:
    n = len(row)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, fit, np.int32)), pa.array(row), pa.array(y, pa.int32()), pa.array(np.full(n, step, np.int32)),
         pa.array([s.tobytes() for s in shares.transpose(1, 0, 2)], pa.binary())], ["fit", "row", "y", "step", "shares"])


def _narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in as few bytes as they need."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _packed(trees: Trees) -> bytes:
    """One tree as it is stored: splits of the inner nodes and rows and class weights of the leaves, in the
    order of levels; a level's children lie in the order of their parents."""
    inner = trees.feature >= 0
    leaves = trees.stats[~inner]
    leaf, label = np.nonzero(leaves[:, :-1])
    out = io.BytesIO()
    np.savez_compressed(out, inner=inner, feature=_narrow(trees.feature[inner]), split=_narrow(trees.split[inner]),
                        missing_left=np.packbits(trees.missing_left[inner]), rows=_narrow(leaves[:, -1]),
                        labels=_narrow(np.bincount(leaf, minlength=len(leaves))), label=_narrow(label), weight=_narrow(leaves[leaf, label]))
    return out.getvalue()


def _unpacked(body: bytes, classes: int) -> Trees:
    with np.load(io.BytesIO(body)) as z:
        inner = z["inner"]
        n = len(inner)
        t = Trees.planted(np.zeros(n, _U), classes + 1)
        t.roots, t.tree = t.roots[:1], np.zeros(n, np.int64)
        at, leaf = np.flatnonzero(inner), np.flatnonzero(~inner)
        t.feature[at], t.split[at], t.left[at] = z["feature"], z["split"], 1 + 2 * np.arange(len(at))
        t.missing_left[at] = np.unpackbits(z["missing_left"], count=len(at))
        t.stats[leaf, classes] = z["rows"]
        t.stats[np.repeat(leaf, z["labels"]), z["label"]] = z["weight"]
    ends = [0, 1]
    while ends[-1] < n:
        ends.append(ends[-1] + 2 * int(inner[ends[-2]:ends[-1]].sum()))
    for depth in range(len(ends) - 2, -1, -1):              # a node holds what its children hold
        a, b = ends[depth], ends[depth + 1]
        t.depth[a:b] = depth
        up = a + np.flatnonzero(inner[a:b])
        t.stats[up] = t.stats[t.left[up]] + t.stats[t.left[up] + 1]
    return t


def _task_rows(batches: list[pa.RecordBatch], width: int, folds: set[int] | None) -> tuple:
    """row, y, fold and bins of the batches, of some folds only."""
    got = []
    for batch in batches:
        part = _arrays(batch, width)[:4]
        keep = np.flatnonzero(np.isin(part[2], list(folds))) if folds is not None else np.arange(len(part[2]))
        got.append(tuple(a[keep] for a in part))
    return tuple(np.concatenate(a) for a in zip(*got))


def _grown(plan: list[tuple], max_depth: int, min_split: int, classes: int, row: np.ndarray, y: np.ndarray, fold: np.ndarray,
           x: np.ndarray) -> Iterator[tuple]:
    """The trees of ``plan`` from all rows of the key, one after the other: fits and their numbers, tree, its form for every fit."""
    for numbered, ids, seeds in plan:
        fits = [f for _, f in numbered]
        taught = np.flatnonzero((fold != EVAL) & (fold != fits[0].held))
        for tree, seed in zip(ids.tolist(), seeds):
            w = bootstrap(row[taught], np.array([seed]))[:, 0]
            use = taught[w > 0]
            trees = [Trees.planted(mix(np.array([seed])), classes + 1) for _ in fits]
            _finish(trees, np.zeros((1, len(fits)), np.int64), fits, x[use], y[use], w[w > 0], np.zeros(len(use), np.int64),
                    classes, min_split, max_depth)
            yield numbered, tree, trees


def _grow_rows(plan: list[tuple], max_depth: int, min_split: int, width: int, classes: int) -> Callable:
    """Grow the trees of ``plan`` from the task's rows, all those of the key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = _task_rows(batches, width, None)
        del batches
        for numbered, tree, trees in _grown(plan, max_depth, min_split, classes, *rows):
            for (number, _), t in zip(numbered, trees):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([tree], pa.int32()), pa.array([_packed(t)], pa.binary())],
                                                 ["fit", "tree", "body"])
    return run


def _grow_and_score(plan: list[tuple], max_depth: int, min_split: int, width: int, classes: int, sizes: list[int],
                    cells: list[tuple[int, int]]) -> Callable:
    """The counted answers of the fits of ``plan``, which has all their trees."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        row, y, fold, x = _task_rows(batches, width, None)
        del batches
        counts: dict[tuple, int] = {}
        for one in plan:
            mine = np.flatnonzero(fold == one[0][0][1].held)
            xs, ys = x[mine], y[mine]
            shares = [np.zeros((len(cells), len(mine), classes)) for _ in one[0]]
            for numbered, tree, trees in _grown([one], max_depth, min_split, classes, row, y, fold, x):
                for (number, f), t, sums in zip(numbered, trees, shares):
                    _add_shares(sums, t, xs, cells, classes)
                    if tree + 1 in sizes:
                        _count(counts, number, f, tree + 1, cells, ys, sums)
        yield _counts(["fit", "held", "size", "depth", "min_split", "y", "yhat"], counts)
    return run


def _count(counts: dict[tuple, int], number: int, fit: Fit, size: int, cells: list[tuple[int, int]], y: np.ndarray, shares: np.ndarray) -> None:
    """Count the answers of a forest of ``size`` trees in every cell."""
    for cell, sums in zip(cells, shares):
        for pair, n in _pairs(y, np.round(sums, 9).argmax(axis=1)):
            key = (number, fit.held, size, *cell, *pair)
            counts[key] = counts.get(key, 0) + n


def _score_rows(plan: list[tuple], width: int, classes: int, sizes: list[int], cells: list[tuple[int, int]]) -> Callable:
    """The counted answers of the fits of ``plan``; a task gets the key's rows and the trees of its fits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies: dict[int, list[tuple[int, bytes]]] = {}
        rows = []
        for batch in batches:
            fit = batch.column(batch.schema.get_field_index("fit"))
            if batch.num_rows > fit.null_count:
                trees = batch.filter(fit.is_valid())
                for i, tree, body in zip(*(trees.column(trees.schema.get_field_index(c)).to_pylist() for c in ("fit", "tree", "body"))):
                    bodies.setdefault(i, []).append((tree, body))
            if fit.null_count:
                rows.append(_task_rows([batch.filter(fit.is_null())], width, {f.held for _, f, _ in plan}))
        if not rows:
            return
        row, y, fold, x = (np.concatenate(a) for a in zip(*rows))
        rows.clear()
        counts: dict[tuple, int] = {}
        for number, f, (part, parts) in plan:
            mine = np.flatnonzero((fold == f.held) & (row.astype(_U) % _U(parts) == part))
            xs, ys = x[mine], y[mine]
            shares = np.zeros((len(cells), len(mine), classes))
            for tree, body in sorted(bodies.get(number, [])):
                _add_shares(shares, _unpacked(body, classes), xs, cells, classes)
                if tree + 1 in sizes:
                    _count(counts, number, f, tree + 1, cells, ys, shares)
        yield _counts(["fit", "held", "size", "depth", "min_split", "y", "yhat"], counts)
    return run


def _route(blocks: list[Block], units: dict[int, Unit], width: int) -> Callable:
    """The rows that each unit trains on or scores: those that reach its node."""
    upper = {(u.block, int(u.trees[0])): _only(blocks[u.block].trees, int(u.trees[0])) for u in units.values()}
    new = {k: np.cumsum(blocks[k[0]].trees.tree == k[1]) - 1 for k in upper}
    plan = [(i, blocks[u.block].fits[u.fit], (u.block, int(u.trees[0])), blocks[u.block].tree_seed[u.trees],
             int(new[u.block, int(u.trees[0])][u.node])) for i, u in units.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, fold, x, _ = _arrays(batch, width)
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("row", "y", "fold", "bins")]
            ends: dict[tuple, np.ndarray] = {}
            for i, f, tree, seeds, node in plan:
                if tree not in ends:
                    ends[tree] = upper[tree].walk(x)[:, 0]
                go = (ends[tree] == node) & ((fold == f.held) | ((fold != EVAL) & (bootstrap(row, seeds)[:, 0] > 0)))
                at = pa.array(np.flatnonzero(go), pa.int64())
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), *[c.take(at) for c in cols]],
                                                     ["unit", "row", "y", "fold", "bins"])
    return run


def _grow_units(blocks: list[Block], units: list[Unit], order: dict[Fit, int], width: int, classes: int, sizes: list[int],
                cells: list[tuple[int, int]]) -> Callable:
    """Grow a unit's node to the end; per scored row its leaf shares in every cell (depth limit, least split size)."""
    plan = []
    for u in units:
        b, t = blocks[u.block], int(u.trees[0])
        step = int(np.searchsorted(sizes, b.tree_id[t], side="right"))
        plan.append((b.fits[u.fit], b.tree_seed[u.trees], step, b.max_depth, b.min_split, _only(b.trees, t),
                     int((b.trees.tree[:u.node] == t).sum()), u.node in set(b.frontier.tolist())))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        f, seeds, step, max_depth, min_split, top, node, grown = plan[key[0].as_py()]
        t = t.combine_chunks()
        row, y, fold = (t.column(c).to_numpy() for c in ("row", "y", "fold"))
        x = np.frombuffer(b"".join(t.column("bins").to_pylist()), dtype=np.uint8).reshape(t.num_rows, width)
        scored, taught = np.flatnonzero(fold == f.held), np.flatnonzero((fold != EVAL) & (fold != f.held))
        shares = np.zeros((len(cells), len(scored), classes))
        trees = replace(top, stats=top.stats.copy(), **{c: getattr(top, c).copy() for c in ("feature", "split", "missing_left", "left")})
        if grown:
            w = bootstrap(row[taught], seeds)[:, 0]
            _finish([trees], np.array([[node]]), [f], x[taught], y[taught], w, np.zeros(len(taught), np.int64), classes, min_split, max_depth)
        _add_shares(shares, trees, x[scored], cells, classes)
        return pa.Table.from_batches([_shares(order[f], row[scored], y[scored], step, shares)])
    return run


def _answers(held: dict[int, int], classes: int, sizes: list[int], cells: list[tuple[int, int]]) -> Callable:
    """Sums of shares in order of (fit, row): the answers of every size and cell, counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, int] = {}

        def answer(fit, y, total):
            yhat = np.round(np.cumsum(total, axis=1), 9).argmax(axis=3)
            for i in np.unique(fit).tolist():
                for s, size in enumerate(sizes):
                    for c, cell in enumerate(cells):
                        for pair, n in _pairs(y[fit == i], yhat[fit == i, s, c]):
                            key = (i, held[i], size, *cell, *pair)
                            counts[key] = counts.get(key, 0) + n
        rest = None                                         # the last row, which may go on in the next batch
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                fit, row, y, step = (part.column(c).to_numpy() for c in range(4))
                own = np.frombuffer(b"".join(part.column(4).to_pylist()), dtype=np.float64).reshape(-1, len(cells), classes)
                new = np.append(True, (fit[1:] != fit[:-1]) | (row[1:] != row[:-1]))
                to, first = np.cumsum(new) - 1, np.flatnonzero(new)
                total = np.zeros((len(first), len(sizes), len(cells), classes))
                np.add.at(total, (to, step), own)
                if rest is not None and rest[:2] == (fit[0], row[0]):
                    total[0] += rest[3]
                elif rest is not None:
                    answer(np.array([rest[0]]), np.array([rest[2]]), rest[3][None])
                answer(fit[first[:-1]], y[first[:-1]], total[:-1])
                rest = (fit[-1], row[-1], y[-1], total[-1])
        if rest is not None:
            answer(np.array([rest[0]]), np.array([rest[2]]), rest[3][None])
        yield _counts(["fit", "held", "size", "depth", "min_split", "y", "yhat"], counts)
    return run


def _counts(names: list[str], rows: dict[tuple, int]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32()) for c in cols] + [pa.array(list(rows.values()), pa.int64())],
                                      [*names, "n"])


def _pairs(y: np.ndarray, yhat: np.ndarray) -> list[tuple[tuple[int, int], int]]:
    both, n = np.unique(np.stack([y, yhat]), axis=1, return_counts=True)
    return [((int(both[0, i]), int(both[1, i])), int(n[i])) for i in range(both.shape[1])]


# ---------------------------------------------------------------- boosted trees
def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def gradients(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Softmax gradient and (doubled) hessian per (row, fit, class), in fixed point."""
    p = softmax(margins)
    g = p - (np.arange(margins.shape[-1]) == y[:, None])[:, None, :]
    h = np.maximum(2 * p * (1 - p), 1e-16)
    return np.rint(g * UNIT).astype(np.int64), np.rint(h * UNIT).astype(np.int64)


def leaf_weights(stats: np.ndarray, rate: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    return -(stats[:, 0] / UNIT) / (stats[:, 1] / UNIT + penalty) * rate


@dataclass
class Round:
    """The finished trees of one boosting round of a block: leaf values per node."""
    trees: Trees
    value: np.ndarray


def _margins(x: np.ndarray, before: np.ndarray | None, rounds: list[Round], n_fits: int, classes: int) -> np.ndarray:
    m = np.zeros((len(x), n_fits * classes)) if before is None else before.copy()
    for r in rounds:
        m += r.value[r.trees.walk(x)]
    return m.reshape(len(x), n_fits, classes)


def boost(rows: DataFrame, width: int, classes: int, fits: list[Fit], rounds: int, stored: Callable[[DataFrame, str], DataFrame],
          penalty: float = 1.0, min_weight: float = 1.0) -> list[tuple[Block, list[Round]]]:
    """``rounds`` rounds of one tree per class for every fit: softmax loss, second-order splits, a penalty
    on leaf weights, row samples per round and column samples per tree.

    A round's margins are those stored last plus the trees since; every STORE_ROUNDS rounds they are
    written with the rows (``stored``), so a pass walks a bounded number of trees.
    """
    def seeds(f: Fit, t: int) -> np.ndarray:
        return mix(mix(mix(np.full(classes, f.seed)) + _U(t)) + np.arange(classes, dtype=_U))

    blocks = _blocks(rows, fits, classes, max(1, BLOCK_TREES // classes), lambda f: seeds(f, 0), 3)
    done: list[list[Round]] = [[] for _ in blocks]
    since: list[list[Round]] = [[] for _ in blocks]
    for t in range(rounds):
        for b in blocks:
            b.tree_seed = np.concatenate([seeds(f, t) for f in b.fits])
            b.trees = Trees.planted(mix(b.tree_seed), 3)
            b.open = b.trees.roots.copy()
        picked = [[sampled_columns(b.tree_seed[j:j + 1], np.array(f.columns, dtype=np.int64), max(1, round(f.colsample * len(f.columns))))[0]
                   for i, f in enumerate(b.fits) for j in range(i * classes, (i + 1) * classes)] for b in blocks]
        while any(len(b.open) for b in blocks):
            for b, cols in zip(blocks, picked):
                k = max(len(c) for c in cols)
                wide = np.full((len(cols), k), -1, np.int64)
                for i, c in enumerate(cols):
                    wide[i, :len(c)] = c
                b.columns = wide[b.trees.tree[b.open]]
            columns = _stack_columns(blocks)
            _level(blocks, width, 1, [_boosted(b, s, classes) for b, s in zip(blocks, since)], 3, choose_gain(columns, penalty, min_weight))
            for b in blocks:
                deep = np.array([f.depth for f in b.fits])[b.fit_of[b.trees.tree[b.open]]]
                b.open = b.open[b.trees.depth[b.open] < deep]
        for i, b in enumerate(blocks):
            rate = np.array([f.rate for f in b.fits])[b.fit_of[b.trees.tree]]
            r = Round(b.trees, leaf_weights(b.trees.stats, rate, penalty))
            done[i].append(r)
            since[i].append(r)
            if len(since[i]) == STORE_ROUNDS and t + 1 < rounds:
                b.rows = stored(_with_margins(b, since[i], width, classes), "boost-margins")
                since[i] = []
    return list(zip(blocks, done))


def _boosted(block: Block, since: list[Round], classes: int) -> Callable:
    fits, seeds, since = block.fits, block.tree_seed, list(since)
    share = np.array([f.subsample for f in fits])

    def run(row, y, x, margins):
        g, h = gradients(_margins(x, margins, since, len(fits), classes), y)
        g, h = g.reshape(len(x), -1), h.reshape(len(x), -1)
        # one row sample per fit and round, the same for its classes
        u = unit(mix(row.astype(_U)[:, None] ^ seeds[::classes][None, :]))
        weight = np.repeat((u < share[None, :]).astype(np.int64), classes, axis=1)
        return weight, lambda r: 0, lambda r, t, w: np.stack([g[r, t], h[r, t], w], axis=1)
    return run


def _with_margins(block: Block, since: list[Round], width: int, classes: int) -> DataFrame:
    n_fits, since = len(block.fits), list(since)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, _, x, margins = _arrays(batch, width)
            m = _margins(x, margins, since, n_fits, classes).reshape(len(x), -1)
            body = pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(5)] + [body], ["key", "row", "y", "fold", "bins", "margins"])
    head = block.rows.select("key", "row", "y", "fold", "bins", *[c for c in block.rows.columns if c == "margins"])
    return head.mapInArrow(run, ROW_SCHEMA + ", margins binary")


def score_boosted(rows: DataFrame, models: list[tuple[Block, list[Round]]], width: int, classes: int, sizes: list[int]) -> DataFrame:
    """(fit, held, size, y, yhat, n): predictions of every fit after each number of rounds in ``sizes``."""
    out, base = None, 0
    for block, done in models:
        one = rows.where(F.col("key") == block.fits[0].key).mapInArrow(
            _score_boost(block.fits, done, base, width, classes, sizes), "fit int, held int, size int, y int, yhat int, n long")
        out = one if out is None else out.unionByName(one)
        base += len(block.fits)
    return out.groupBy("fit", "held", "size", "y", "yhat").agg(F.sum("n").alias("n"))


def _score_boost(fits, done, base, width, classes, sizes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, int] = {}
        piece = max(1, PIECE_CELLS // (classes * len(fits)))
        for batch in batches:
            row, y, fold, x, _ = _arrays(batch, width)
            for a in range(0, len(row), piece):
                s = slice(a, a + piece)
                m = np.zeros((len(row[s]), len(fits) * classes))
                for t, r in enumerate(done, 1):
                    m += r.value[r.trees.walk(x[s])]
                    if t in sizes:
                        yhat = np.round(m.reshape(len(m), len(fits), classes), 9).argmax(axis=2)
                        for i, f in enumerate(fits):
                            at = fold[s] == f.held
                            for pair, n in _pairs(y[s][at], yhat[at, i]):
                                key = (base + i, f.held, t, *pair)
                                counts[key] = counts.get(key, 0) + n
        yield _counts(["fit", "held", "size", "y", "yhat"], counts)
    return run
