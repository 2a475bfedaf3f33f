"""Int8 tile pairs and histogram top-k against numpy."""
import math
import random

import numpy as np
import pytest

from transitio.llm import histogram_topk as H
from transitio.llm import int8_pairs as P

NAN, INF = float("nan"), float("inf")


def brute_pairs(rows):
    ok = [(i, np.array(v, dtype=float) / max(map(abs, v)), l) for i, v, l in rows
          if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, *_ in rows}
    n = {i: 0 for i, *_ in rows}
    for i, x, l in ok:
        for j, y, m in ok:
            if i != j and l == m and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links[i].add(j)
                n[i] += 1
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (n[i], None if i is None else min(x for x in seen))
    return out


def vector_rows(seed=0, n=90, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0 or not rows:
            v = rng.normal(size=dim)
        else:
            v = np.array(rows[rng.integers(0, len(rows))][1]) * rng.uniform(0.5, 2) + rng.normal(size=dim) * rng.uniform(0.02, 0.3)
        rows.append((i, [float(x) for x in v], int(i % 2)))
    bad = [(200, None, 0), (201, [0.0] * dim, 0), (202, [NAN] * dim, 0), (203, [1.0] * (dim - 1) + [INF], 0), (204, rows[0][1], None),
           (205, rows[0][1][:-1] + [None], 0), (206, [], 0), (207, [1.0, 2.0], 0), (208, [2.0, 4.0], 0),
           (209, [1e200 * x for x in rows[0][1]], 0)]
    return rows + bad


@pytest.mark.parametrize("tile", [16, 4096])
def test_links_match_brute_force(spark, tile):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in P.near_vectors(df, tile=tile).collect()}
    assert got == brute_pairs(rows)


def test_null_ids_and_repeated_rows(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(None, v, 1), (1, v, 1), (1, v, 1), (2, v, 1)], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in P.near_vectors(df).collect())
    assert got == [(-1, 0, -1, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_one_id_in_more_rows_than_a_tile_holds(spark):
    rows = [(5, [1.0, 0.0], 1)] * 40 + [(6, [1.0, 0.01], 1), (7, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {(r.vec_id, r.n_links, r.component_id) for r in P.near_vectors(df, tile=8).collect()}
    assert got == {(5, 40, 5), (6, 40, 5), (7, 0, 7)}


def test_quantisation_bound_holds():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    q, s, e = P.quantise(v)
    near = (q @ q.T) * s[:, None] * s[None, :]
    bound = e[:, None] * (1 + e[None, :]) + e[None, :]
    assert (np.abs(v @ v.T - near) <= bound).all()


def test_dense_group_reports_counts_not_pairs():
    ids, vecs = np.arange(700), np.ones((700, 8)) + np.random.default_rng(0).normal(size=(700, 8)) * 1e-3
    got, n, a, b = P.tile_pair([(ids, vecs)], 0.98)
    assert (n == 699).all() and len(got) == 700 and len(a) <= 4 * 700 and (b < a).all()


def brute_top(rows, k=10):
    ok = {i: [math.floor(1024 * x) for x in v] for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, x in ok.items():
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in ok.items() if j != q)[:k]
            out += [(q, r + 1, j, -v) for r, (v, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 300.0, 1e6])
def test_top_k_matches_brute_force(spark, scale):
    from pyspark.sql import functions as F
    rng = random.Random(2)
    rows = [(i, [scale * rng.choice([-1.0, -0.5, 0.25, 0.5, 1.0]) for _ in range(6)]) for i in range(260)]
    rows += [(300, rows[100][1]), (301, rows[100][1]), (302, None), (303, [NAN] * 6), (None, rows[0][1]), (400, [1.0, 2.0]),
             (500, [0.5, None]), (600, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in H.top_k(df, F.col("vec_id") % 100 == 0).collect())
    want = brute_top(rows)
    assert got == want


def test_top_k_with_few_candidates_and_empty(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in H.top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 1, 1024 * 2048), (0, 2, 2, 1024 * 2048)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert H.top_k(empty, F.col("vec_id") % 100 == 0).count() == 0
    assert P.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_one_long_vector_takes_no_rows_from_the_others(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(300, 8))
    unit[1:] = unit[0] + rng.normal(size=(299, 8)) * 1e-3  # scores within a few thousand of each other
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(unit)] + [(777, [1e6] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in H.top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == brute_top(rows)
