"""Poisson mixing and length buckets against plain Python."""
import hashlib
import itertools
import math
from collections import Counter

import numpy as np

from transitio.llm import length_buckets as P
from transitio.llm import poisson_mix as M

SCHEMA = "doc_id long, text string, source string, _id string, copy int, row string"


def rows():
    out = [(i, "x" * (10 + i % 7), f"s{i % 3}" if i % 5 else "big", "u", 1, "r") for i in range(300)]
    return out + [(1000, None, "s0", "u", 1, "r"), (1001, "", None, "u", 1, "r"), (1002, "abc", None, "u", 1, "r"), (None, "zz", "s1", "u", 1, "r"),
                  (5, out[5][1], out[5][2], "u", 1, "r"), (1003, None, "empty", "u", 1, "r")]


def brute(rows, targets=None, alpha=0.5, epochs=1.0):
    mass = Counter()
    for _, t, s, *_ in rows:
        mass[s] += len(t or "")
    want = {s: (m ** alpha if targets is None else targets.get(s, 0.0)) if m else 0.0 for s, m in mass.items()}
    total, norm = sum(mass.values()), sum(want.values())
    out = Counter()
    for i, t, s, *_ in rows:
        rate = want[s] / norm * total / mass[s] * epochs if mass[s] else epochs
        parts = max(1, math.ceil(rate / 32))
        mean, n = rate / parts, 0
        ident = str(i) if i is not None else hashlib.md5(t.encode()).hexdigest() if t is not None else ""
        for j in range(parts):
            u = int(hashlib.md5(f"mix:{ident}:{j}".encode()).hexdigest()[:13], 16) / 2 ** 52
            p = c = math.exp(-mean)
            k = 0
            while c <= u and k < mean + 12 * math.sqrt(mean) + 20:
                k += 1
                p *= mean / k
                c += p
            n += k
        for c in range(1, n + 1):
            out[(i, t, s, c, hashlib.md5(f"mix#{ident}#{c}".encode()).hexdigest())] += 1
    return out


def check(spark, **options):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = M.mix_sources(df, **options)
    assert got.columns == ["doc_id", "text", "source", "_id", "row", "copy", "mix_key"]
    assert Counter((r.doc_id, r.text, r.source, r.copy, r.mix_key) for r in got.collect()) == brute(rows(), **options)


def test_mix_matches_brute_force(spark):
    check(spark)


def test_mix_to_given_weights_with_large_rates(spark):
    check(spark, targets={"s0": 0.01, "big": 5.0, "s1": 90.0}, epochs=40.0)


def test_mix_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST_BYTES", 0)
    check(spark)


def test_mix_empty(spark):
    assert M.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def padded(bounds, lengths, counts):
    return sum(c * min(b for b in bounds if b >= x) for x, c in zip(lengths, counts))


def test_boundaries_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = np.sort(rng.choice(60, 9, replace=False))
        counts = rng.integers(1, 50, 9)
        for k in (1, 2, 4, 9, 12):
            got = P.boundaries(lengths, counts, k)
            best = min(padded([*c, lengths[-1]], lengths, counts) for c in itertools.combinations(lengths[:-1].tolist(), min(k, 9) - 1))
            assert padded(got, lengths, counts) == best and len(got) == min(k, 9) and got == sorted(got)


def test_pack_keeps_every_word_and_fills_batches(spark):
    texts = [(i, "w " * (i * 7 % 53)) for i in range(200)] + [(500, "w " * 1000), (501, None), (502, " "), (None, "a b"), (3, "w " * 21)]
    df = spark.createDataFrame([(i, t, 1, "h") for i, t in texts], "doc_id long, text string, bucket int, key string")
    got = P.pack(df, max_len=64, buckets=4, budget=256).collect()
    words = Counter()
    for r in got:
        words[r.doc_id] += r.n_tokens
        assert r.n_tokens <= r.padded_len <= 64 and r.start == r.piece * 64
    assert words == Counter({k: sum(len((t or "").split()) for i, t in texts if i == k) for k, _ in texts})
    per = Counter((r.bucket, r.batch) for r in got)
    for (b, batch), n in per.items():
        cap = max(1, 256 // max(1, next(r.padded_len for r in got if r.bucket == b)))
        last = max(x for y, x in per if y == b)
        assert n == cap or batch == last and n <= cap
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(got)


def test_pack_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
