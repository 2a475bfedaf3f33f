"""BagMinHash: unbiased signatures, exact links, classes against plain Python."""
import itertools
import random
from collections import Counter

import numpy as np

from transitio.llm import bagminhash as B


def bag(text):
    w = (text or "").lower().split()
    if not w:
        return Counter()
    return Counter([" ".join(w[i:i + 5]) for i in range(len(w) - 4)] or [" ".join(w)])


def jaccard(a, b):
    x, y = bag(a), bag(b)
    keys = set(x) | set(y)
    top = sum(max(x[k], y[k]) for k in keys)
    return sum(min(x[k], y[k]) for k in keys) / top if top else 0.0


def classes(rows):
    """Brute force: every pair of rows; class = smallest id reachable by equal or linked texts."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = rows[i][1], rows[j][1]
        if bag(a) and bag(b) and (a == b or jaccard(a, b) * 10 >= 8 - 1e-12):
            p, q = find(i), find(j)
            parent[max(p, q)] = min(p, q)
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        if not bag(text):
            out[i] = doc_id
        else:
            out[i] = min((rows[j][0] for j in range(len(rows)) if find(j) == find(i) and bag(rows[j][1]) and rows[j][0] is not None),
                         default=None)
    return out


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def fixture_rows(seed=1):
    rng, rows = random.Random(seed), []
    for g in range(6):
        base = words(rng, 80)
        rows.append((10 * g, " ".join(base)))
        for c in range(1, 5):
            near = list(base)
            for _ in range(c):
                near[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
            rows.append((10 * g + c, " ".join(near)))
    rows += [(100, rows[0][1]), (100, rows[0][1]), (None, rows[5][1]), (101, None), (102, ""), (103, " \t\n"), (104, "one two"),
             (105, "ONE two"), (106, "one"), (107, "a b " * 40), (108, "a b " * 41), (None, None), (109, "é " * 3000)]
    return rows


def test_signature_agreement_is_the_weighted_jaccard_similarity():
    rng = np.random.default_rng(0)
    elem = np.arange(1, 201).astype(np.uint64)
    x, y = rng.integers(0, 9, 200), rng.integers(0, 9, 200)
    row = np.repeat([0, 1], 200)
    keep = np.concatenate([x, y]) > 0
    sig = B.signatures(2, row[keep], np.concatenate([elem, elem])[keep], np.concatenate([x, y])[keep], 4096)
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_signatures_do_not_depend_on_the_batch():
    e, w = np.arange(7, dtype=np.uint64), np.arange(1, 8)
    alone = B.signatures(1, np.zeros(7, int), e, w, 64)
    with_others = B.signatures(3, np.array([0] * 7 + [2]), np.append(e, np.uint64(99)), np.append(w, 1), 64)
    assert (alone[0] == with_others[0]).all() and np.isinf(with_others[1]).all()


def test_classes_match_brute_force(spark):
    rows = fixture_rows()
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, tk string, id int")
    got = sorted(((r.doc_id, r.class_id) for r in B.near_duplicates(df).collect()), key=str)
    want = classes(rows)
    assert got == sorted(((rows[i][0], c) for i, c in want.items()), key=str)


def test_keep_first_leaves_one_row_per_class_and_all_columns(spark):
    rows = fixture_rows(2)
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, tk string, id int")
    kept = B.keep_first(df)
    assert kept.columns == df.columns
    want = classes(rows)
    n_classes = len({c for i, c in want.items() if bag(rows[i][1])})
    blank = sum(not bag(t) for _, t in rows)
    assert kept.count() == n_classes + blank


def test_pairs_left_after_the_two_centres_are_found(spark):
    """A bucket whose smallest and largest keys link with nobody still yields the links inside."""
    import hashlib
    rng = random.Random(5)
    base = words(rng, 40)
    texts = sorted((" ".join(base + words(rng, 12)) for _ in range(40)), key=lambda t: hashlib.md5(t.encode()).digest())
    mid = texts[20].split()
    mid[45] = "changed"
    rows = list(enumerate([*texts, " ".join(mid)]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in B.near_duplicates(df).collect()}
    assert got == {rows[i][0]: c for i, c in classes(rows).items()}
    assert got[40] != 40


def test_tile_links_agree_with_pairs():
    texts = [t for _, t in fixture_rows(4) if t and t.strip()][:20] + ["a b " * n for n in (300, 360, 420, 900)]
    for cut in (1, 7, len(texts) - 1):
        comp = {i: i for i in range(len(texts))}
        for a, b in B.tile_links(texts[:cut], texts[cut:], 5, B.Fraction("0.8")):
            comp[b] = comp[a]
        pairs = [(i, j) for i in range(cut) for j in range(cut, len(texts)) if jaccard(texts[i], texts[j]) >= 0.8]
        assert all(comp[i] == comp[j] for i, j in pairs) and len(set(comp.values())) >= len(texts) - len(pairs)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert B.near_duplicates(df).count() == 0 and B.keep_first(df).count() == 0
