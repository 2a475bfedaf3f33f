"""The trie against plain Python, findclose against a stack."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitio.llm import conv_trie
from transitio.llm.conv_trie import find_close, trie

SCHEMA = "conv_id long, turn long, role string, text string, a long, pos int, m string"


def _plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * words
    return sorted((min(v), len(p), min(members[p[:-1]]) if p else None, len(v), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, v in members.items())


def _got(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in trie(df).collect())


def _check(spark, rows):
    # extra columns have the names that the operator uses inside
    df = spark.createDataFrame([(*r, 1, 2, "m") for r in rows], SCHEMA)
    got = _got(df)
    assert got == _plain(rows)
    return got


def _talks(seed, n, texts=("hello you", "go on", "x", "")):
    rnd = random.Random(seed)
    return [(c, t, rnd.choice("ua"), rnd.choice(texts)) for c in range(-30, n) for t in range(rnd.randint(1, 7))]


def test_find_close_equals_a_stack():
    rnd = random.Random(1)
    for n in (1, 2, 40, 700, 5000):
        for deep in (0.5, 0.9):
            bits, depth, opened = [1], 1, 1
            while depth:
                if opened < n and rnd.random() < deep:
                    bits.append(1)
                    depth, opened = depth + 1, opened + 1
                elif depth > 1 or opened >= n:
                    bits.append(0)
                    depth -= 1
            stack, want = [], {}
            for i, b in enumerate(bits):
                if b:
                    stack.append(i)
                else:
                    want[stack.pop()] = i
            arr = np.array(bits, dtype=np.int8)
            for block in (2, 5, 64):
                assert find_close(arr, block).tolist() == [want[i] for i in np.flatnonzero(arr)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_python(spark, monkeypatch, small):
    if small:  # many shards with shared spines, many blocks of turns, ids hashed in many chunks, every key in parts
        monkeypatch.setattr(conv_trie, "SHARD_RUNS", 3)
        monkeypatch.setattr(conv_trie, "BLOCK", 2)
        monkeypatch.setattr(conv_trie, "ID_STRETCH", 7)
        monkeypatch.setattr(conv_trie, "PAREN_BLOCK", 4)
        monkeypatch.setattr(conv_trie, "balanced_join", lambda *a, f=conv_trie.balanced_join, **k: f(*a, rows_per_part=2, **k))
    _check(spark, _talks(5, 120))


def test_nulls_ties_repeats_and_turnless(spark):
    rows = [(0, None, None, None), (0, 1, "user", "a b"), (0, 1, "user", "a b"), (0, 1, "assistant", "c"), (1, 0, "user", None),
            (None, 0, "user", "nobody"), (None, None, None, None), (45, 0, "u", "no base"), (46, 0, "u", "no base"), (47, 9, "u", "x " * 20_000),
            (2, 5, "us", "er"), (3, 5, "u", "ser"), (-7, 0, "u", "below zero"), (2**62, 0, "u", "far")]
    got = _check(spark, rows)
    assert got[0][0] == -7


def test_only_turnless(spark):
    # 45 and 46 lose their only turn where h > 0, and their base is absent
    c = next(i for i in range(41, 60) if zlib.crc32(str(i).encode()) % 4 > 0)
    assert len(_check(spark, [(c, 0, "u", "gone")])) == 1


def test_one_long_conversation_and_a_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr(conv_trie, "BLOCK", 64)
    rows = [(20, t, "u", f"turn {t}") for t in range(400)]
    rows += [(c, t, "u", f"turn {t}") for c in range(21, 40) for t in range(10 * (c - 20))]
    rows += [(c, t, "u", f"copy {t}") for c in range(100, 400) for t in range(3)]
    _check(spark, rows)


def test_empty(spark):
    assert _got(spark.createDataFrame([], SCHEMA)) == []
    assert _got(spark.createDataFrame([(None, 1, "u", "x", 1, 1, "")], SCHEMA)) == []


def test_no_cross_join(spark):
    plan = trie(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
