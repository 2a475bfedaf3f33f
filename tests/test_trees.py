"""Forests and boosted trees of many fits against a plain, recursive, single-process version."""

import numpy as np
import pytest

from transitio.operators import trees as T

K = 3


def _table(n=160, d=5, seed=0):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, d)).round(1)
    y = ((x[:, 0] > 0).astype(int) + ((x[:, 1] + x[:, 2] > 0.5) & (x[:, 0] > -1))).astype(int)
    x[rnd.random((n, d)) < 0.15] = np.nan
    fold = np.where(np.arange(n) % 5 == 4, T.EVAL, np.arange(n) % 3)
    return x, y, fold


def _spark_rows(spark, x, y, fold, parts=3):
    cols = [f"c{i}" for i in range(x.shape[1])]
    rows = [(1, 1000 + i, int(y[i]), int(fold[i]), *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(len(x))]
    df = spark.createDataFrame(rows, "key int, row long, y int, fold int, " + ", ".join(f"{c} double" for c in cols)).repartition(parts)
    edges = T.bin_edges(df.where("fold != -1"), cols)
    bins = np.stack([np.where(np.isnan(x[:, i]), T.MISSING, np.searchsorted(edges[i], x[:, i])) for i in range(len(cols))], axis=1)
    return T.binned(df, cols, edges).cache(), bins


def _best_split(bins, stat, columns, score, allowed):
    """First best (score, column, bin, missing left) by trying every split."""
    best = None
    for c in columns:
        for b in range(T.MAX_BINS):
            for missing_left in (False, True):
                v = bins[:, c]
                to_left = np.where(v == T.MISSING, missing_left, v <= b)
                lo, hi = stat[to_left].sum(axis=0), stat[~to_left].sum(axis=0)
                if allowed(lo, hi) and (best is None or score(lo) + score(hi) > best[0]):
                    best = (score(lo) + score(hi), c, b, missing_left, to_left, v)
    return best


def _direction(best):
    _, c, b, side, to_left, v = best
    if (v == T.MISSING).any():
        return c, b, side
    return c, b, 2 * to_left.sum() > len(to_left)


def _plain_forest_tree(bins, y, weight, columns, k, path, depth, fit, max_depth):
    stat = np.concatenate([np.eye(K, dtype=np.int64)[y] * weight[:, None], np.ones((len(y), 1), np.int64)], axis=1)
    node = {"stat": stat.sum(axis=0), "kids": None}
    if depth < max_depth and len(y) >= 2 and len(np.unique(y)) > 1:
        def score(s):
            return float((s[:K].astype(float) ** 2).sum() / s[:K].sum())
        best = _best_split(bins, stat, T.sampled_columns(np.array([path]), np.array(columns), k)[0], score,
                           lambda a, b: min(a[K], b[K]) >= fit.min_leaf and a[K] > 0 and b[K] > 0)
        if best and best[0] > score(node["stat"]) * (1 + 1e-12):
            c, b, side = _direction(best)
            left = best[4]
            node["kids"] = (c, b, side, *[
                _plain_forest_tree(bins[m], y[m], weight[m], columns, k,
                                   T.mix(np.array([path], dtype=np.uint64) * np.uint64(2) + np.uint64(i))[0], depth + 1, fit, max_depth)
                for i, m in enumerate((left, ~left))])
    return node


def _walk(node, row, depth=10 ** 6, least=0, at=0):
    while node["kids"] and at < depth and node["stat"][K] >= least:
        c, b, side, left, right = node["kids"]
        node = left if (side if row[c] == T.MISSING else row[c] <= b) else right
        at += 1
    return node


def test_forests_equal_plain_trees(spark):
    x, y, fold = _table()
    rows, bins = _spark_rows(spark, x, y, fold)
    fits = [T.Fit(1, held, cols, seed=7, min_leaf=leaf) for held in (0, 2, T.EVAL) for leaf in (1, 4)
            for cols in ((0, 1, 2, 3, 4), (1, 3))]
    blocks = T.grow_forests(rows, 5, K, fits, 6, max_depth=8)
    sizes, depths, splits = [2, 6], [2, 8], [2, 9]
    got = {(r.fit, r.size, r.depth, r.min_split, r.y, r.yhat): r.n
           for r in T.score_forests(blocks, 5, K, sizes, depths, splits).collect()}
    ids = np.arange(len(y)) + 1000
    want = {}
    for i, f in enumerate(T.in_order(blocks)):
        seeds = T.mix(T.mix(np.full(6, f.seed)) + np.arange(6, dtype=np.uint64))
        mine = (fold != T.EVAL) & (fold != f.held)
        grown = []
        for s in seeds:
            w = T.bootstrap(ids, np.array([s]))[:, 0] * mine
            m = w > 0
            grown.append(_plain_forest_tree(bins[m], y[m], w[m], f.columns, int(np.sqrt(len(f.columns))), T.mix(np.array([s]))[0], 0, f, 8))
        for size in sizes:
            for depth in depths:
                for least in splits:
                    for r in np.flatnonzero(fold == f.held):
                        shares = [(n := _walk(t, bins[r], depth, least)["stat"][:K].astype(float)) / max(n.sum(), 1) for t in grown[:size]]
                        key = (i, size, depth, least, int(y[r]), int(np.round(np.sum(shares, axis=0), 9).argmax()))
                        want[key] = want.get(key, 0) + 1
    assert got == want
    whole = {k: n for k, n in got.items() if len(T.in_order(blocks)[k[0]].columns) == 5 and k[1:4] == (6, 8, 2)}
    assert sum(n for k, n in whole.items() if k[4] == k[5]) / sum(whole.values()) > 0.55


def _plain_boost(bins, y, ids, fit, rounds):
    m = np.zeros((len(y), K))
    out = []
    trained = fit.mask
    for t in range(rounds):
        seeds = T.mix(T.mix(T.mix(np.full(K, fit.fit.seed)) + np.uint64(t)) + np.arange(K, dtype=np.uint64))
        g, h = (a[:, 0] for a in T.gradients(m[:, None, :], y))
        used = trained & (T.unit(T.mix(ids.astype(np.uint64) ^ seeds[0])) < fit.fit.subsample)
        step = np.zeros_like(m)
        for c in range(K):
            cols = T.sampled_columns(seeds[c:c + 1], np.array(fit.fit.columns), max(1, round(fit.fit.colsample * len(fit.fit.columns))))[0]

            def grow(mask, every, depth):
                stat = np.stack([g[:, c], h[:, c], np.ones(len(y), np.int64)], axis=1)
                tot = stat[mask].sum(axis=0)

                def score(s):
                    return (s[0] / T.UNIT) ** 2 / (s[1] / T.UNIT + 1.0)
                best = None
                if depth < fit.fit.depth:
                    best = _best_split(bins[mask], stat[mask], cols, score,
                                       lambda a, b: min(a[1], b[1]) >= T.UNIT and a[2] > 0 and b[2] > 0)
                if best is None or best[0] - score(tot) <= 1e-6:
                    step[every, c] = -(tot[0] / T.UNIT) / (tot[1] / T.UNIT + 1.0) * fit.fit.rate
                    return
                col, b, side = _direction(best)
                v = bins[:, col]
                left = np.where(v == T.MISSING, side, v <= b).astype(bool)
                for half in (left, ~left):
                    grow(mask & half, every & half, depth + 1)
            grow(used, np.ones(len(y), bool), 0)
        m = m + step
        out.append(np.round(m, 9).argmax(axis=1))
    return out


@pytest.mark.parametrize("store", [10, 2])
def test_boosting_equals_plain_trees(spark, monkeypatch, store, tmp_path):
    monkeypatch.setattr(T, "STORE_ROUNDS", store)
    x, y, fold = _table(120, 4, 3)
    rows, bins = _spark_rows(spark, x, y, fold)
    fits = [T.Fit(1, held, cols, 42, depth=d, rate=r, subsample=s, colsample=c)
            for held, cols, d, r, s, c in ((0, (0, 1, 2, 3), 2, 0.3, 1.0, 1.0), (1, (0, 2, 3), 3, 0.1, 0.8, 0.8), (T.EVAL, (0, 1, 2, 3), 3, 0.3, 0.8, 1.0))]

    def stored(df, name):
        path = str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}")
        df.write.parquet(path)
        return spark.read.parquet(path)
    models = T.boost(rows, 4, K, fits, 5, stored)
    got = {(r.fit, r["size"], r.y, r.yhat): r.n for r in T.score_boosted(rows, models, 4, K, [1, 3, 5]).collect()}
    ids = np.arange(len(y)) + 1000

    class Case:
        def __init__(self, fit):
            self.fit, self.mask = fit, (fold != T.EVAL) & (fold != fit.held)
    want = {}
    for i, f in enumerate(fits):
        pred = _plain_boost(bins, y, ids, Case(f), 5)
        for size in (1, 3, 5):
            for r in np.flatnonzero(fold == f.held):
                key = (i, size, int(y[r]), int(pred[size - 1][r]))
                want[key] = want.get(key, 0) + 1
    assert got == want


def test_results_do_not_depend_on_partitions(spark):
    x, y, fold = _table(90, 4, 5)

    def counts(parts):
        rows, _ = _spark_rows(spark, x, y, fold, parts)
        blocks = T.grow_forests(rows, 4, K, [T.Fit(1, 0, (0, 1, 2, 3), 3)], 4, max_depth=6)
        return sorted(map(str, T.score_forests(blocks, 4, K, [4], [6], [2]).collect()))
    assert counts(1) == counts(7)


def test_empty_side_and_constant_columns(spark):
    x = np.full((6, 2), 1.0)
    y, fold = np.array([0, 1, 2, 0, 1, 2]), np.zeros(6, int)
    rows, _ = _spark_rows(spark, x, y, fold)
    blocks = T.grow_forests(rows, 2, K, [T.Fit(1, 0, (0, 1), 3), T.Fit(1, 1, (0, 1), 3)], 2, max_depth=4)
    assert len(blocks[0].trees.feature) == len(blocks[0].trees.roots)
    assert T.score_forests(blocks, 2, K, [2], [4], [2]).agg({"n": "sum"}).first()[0] == 6


@pytest.mark.parametrize("cells", [T.LEVEL_CELLS, 200])
def test_upper_nodes_on_the_driver_and_the_rest_in_tasks(spark, monkeypatch, cells):
    x, y, fold = _table(200, 5, 8)
    rows, _ = _spark_rows(spark, x, y, fold)
    fits = [T.Fit(1, held, (0, 1, 2, 3, 4), seed=7, min_leaf=leaf) for held in (0, T.EVAL) for leaf in (1, 3)]

    def counts(blocks):
        return sorted(map(tuple, T.score_forests(blocks, 5, K, [2, 6], [3, 64], [2, 9]).collect()))
    small = T.grow_forests(rows, 5, K, fits, 6, max_depth=64)
    # unlimited trees have nodes in number of the rows: none of them stays on the driver
    assert sum(len(b.trees.feature) for b in small) == sum(len(b.trees.roots) for b in small) == 24
    want = counts(small)
    monkeypatch.setattr(T, "LOCAL_ROWS", 30)
    monkeypatch.setattr(T, "LEVEL_CELLS", cells)
    mixed = T.grow_forests(rows, 5, K, fits, 6, max_depth=64)
    grown = sum(len(b.trees.feature) for b in mixed)
    assert 24 < grown < 24 * 30 and counts(mixed) == want
    monkeypatch.setattr(T, "LOCAL_ROWS", 0)     # every level by distributed histograms
    assert counts(T.grow_forests(rows, 5, K, fits, 6, max_depth=64)) == want


def test_boosted_histograms_skip_padding_and_add_up_by_tree(spark, monkeypatch):
    x, y, fold = _table(120, 6, 4)
    rows, _ = _spark_rows(spark, x, y, fold)
    fits = [T.Fit(1, h, c, 42, depth=3, subsample=0.8, colsample=0.8) for h in (0, T.EVAL) for c in ((0, 1, 2, 3, 4, 5), (1, 4))]
    tree, columns = np.array([0, 0, 1]), np.array([[2, 3, 5], [2, 3, 5], [1, 4, -1]])
    assert [(t, lo, hi, c.tolist()) for t, lo, hi, c in T._same_columns(tree, columns)] == [(0, 0, 2, [2, 3, 5]), (1, 2, 3, [1, 4])]
    assert T._same_columns(tree, np.array([[2, 3, 5], [2, 3, 4], [1, 4, -1]])) is None
    assert 2 * T.STORE_ROUNDS < 10     # ten rounds of a study don't walk all earlier ones at every level

    def counts():
        models = T.boost(rows, 6, K, fits, 4, lambda df, name: df.cache())
        return sorted(map(tuple, T.score_boosted(rows, models, 6, K, [2, 4]).collect()))
    want = counts()
    monkeypatch.setattr(T, "_same_columns", lambda *_: None)
    assert counts() == want


def test_whole_forests_shuffle_neither_rows_nor_shares(spark, monkeypatch, tmp_path):
    x, y, fold = _table(120, 5, 6)
    _spark_rows(spark, x, y, fold)[0].write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    fits = [T.Fit(1, held, (0, 1, 2, 3, 4), seed=7, min_leaf=leaf) for held in (0, 1, T.EVAL) for leaf in (1, 2, 4)]

    def grown(some):
        return T.grow_forests(rows, 5, K, some, 6, max_depth=64)

    def scored(some):
        blocks = grown(some)
        out = T.score_forests(blocks, 5, K, [2, 6], [3, 64], [2, 9])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "shares" not in plan and "hashpartitioning(unit" not in plan and "hashpartitioning(fit" in plan
        return sorted(tuple(r)[1:] for r in out.collect() if T.in_order(blocks)[r.fit] == some[0])
    want = scored(fits)
    grow, score = T._tasks(grown(fits), {f: i for i, f in enumerate(fits)})
    # fits that differ in the least leaf only are grown together, tree by tree; every fit is scored once
    assert sorted((f.held, t) for _, plan in grow for fs, ids, _ in plan for _, f in fs for t in ids.tolist() if f.min_leaf == 4) \
        == [(h, t) for h in (T.EVAL, 0, 1) for t in range(6)]
    assert all([f.min_leaf for _, f in fs] == [1, 2, 4] for _, plan in grow for fs, _, _ in plan) and len(grow) == 15
    assert len(score) == 9 and all("Exchange" not in r.coalesce(1)._jdf.queryExecution().executedPlan().toString() for r, _ in grow + score)
    # more cores than fits: the scored rows of one are dealt out
    assert len(T._tasks(grown(fits[:1]), {fits[0]: 0})[1]) == 4 and scored(fits[:1]) == want
    # many fits share the tasks of their key, which grow and score whole ones
    monkeypatch.setattr(T, "TASKS_PER_CORE", 0)
    assert [len(t) for t in T._tasks(grown(fits), {f: i for i, f in enumerate(fits)})] == [1, 0]
    assert scored(fits) == want


@pytest.mark.parametrize("cells", [T.LEVEL_CELLS, 200])
def test_trees_grown_together_equal_trees_grown_alone(monkeypatch, cells):
    monkeypatch.setattr(T, "LEVEL_CELLS", cells)
    rnd = np.random.default_rng(2)
    x = rnd.integers(0, 12, (500, 6)).astype(np.uint8)
    x[rnd.random(x.shape) < 0.1] = T.MISSING
    y, w = (x[:, 0].astype(int) + rnd.integers(0, 4, 500)) % K, rnd.integers(1, 4, 500)
    fits = [T.Fit(1, 0, (0, 1, 2, 3, 4, 5), 7, min_leaf=leaf) for leaf in (1, 2, 4, 30)]

    def grow(some):
        trees = [T.Trees.planted(T.mix(np.array([5])), K + 1) for _ in some]
        T._finish(trees, np.zeros((1, len(some)), np.int64), some, x, y, w, np.zeros(500, np.int64), K, 2, 64)
        return trees
    together = grow(fits)
    assert len({len(t.feature) for t in together}) == 4
    for f, t in zip(fits, together):
        stored = T._unpacked(T._packed(t), K)
        alone = grow([f])[0]
        for c in ("roots", "feature", "split", "missing_left", "left", "depth", "stats", "tree"):
            assert (getattr(t, c) == getattr(alone, c)).all() and (getattr(stored, c) == getattr(alone, c)).all(), c
        assert (t.path == alone.path).all()
        leaves = t.stats[t.feature < 0, K]
        assert leaves.min() >= f.min_leaf and leaves.sum() == 500


def test_study_table_keeps_float_columns(spark):
    from transitio.plans import tree_study as TS
    rows = [(i, f"s{i}", "ab"[i % 3 == 0], None if i % 7 == 0 else i / 10, float("nan") if i % 5 == 0 else i / 3) for i in range(40)]
    tables = []
    for kind, keep in (("double", True), ("float", False)):
        data = spark.createDataFrame(rows, "id long, subject string, label string, a float, b float")
        data = data.select("id", "subject", "label", *[data[c].cast(kind).alias(c) for c in ("a", "b")])
        tables.append(TS.study_table(data, ["a", "b"], [1, 2], "id", "subject", "label", keep=keep))
    wide, narrow = tables
    assert dict(wide.dtypes)["a"] == "double" and dict(narrow.dtypes)["a"] == "float"
    assert sorted(map(str, map(tuple, wide.collect()))) == sorted(map(str, map(tuple, narrow.collect())))
    for e, f in zip(*[T.bin_edges(t.where("fold != -1"), ["a", "b"]) for t in tables]):
        assert e.tolist() == f.tolist()
