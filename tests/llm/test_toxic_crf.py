"""CRF: recursions against enumeration, accuracy on held-out rows, odd inputs."""
import itertools
import random

import numpy as np
import pyarrow as pa

from transitio.llm import toxic_crf as X
from transitio.llm.tokens import PUNCT, pieces, words


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    lengths = [1, 5, 0, 9]
    row = np.repeat(np.arange(4), lengths)
    unary, trans, start = rng.normal(size=len(row)), rng.normal(size=(2, 2)), 0.3
    old = X.BLOCK
    try:
        for block in (2, 4, 64):
            X.BLOCK = block
            marg, moves, log_z = X.Chains(row, 4).run(unary, trans, start)
            want_m, want_t, want_z = np.zeros(len(row)), np.zeros((2, 2)), 0.0
            for r, n in enumerate(lengths):
                if not n:
                    continue
                u = unary[row == r]
                total, m, t = 0.0, np.zeros(n), np.zeros((2, 2))
                for y in itertools.product((0, 1), repeat=n):
                    w = np.exp(start * y[0] + sum(u[i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
                    total += w
                    m += w * np.array(y)
                    for i in range(n - 1):
                        t[y[i], y[i + 1]] += w
                want_m[row == r] = m / total
                want_t += t / total
                want_z += np.log(total)
            assert np.allclose(marg, want_m) and np.allclose(moves, want_t) and np.isclose(log_z, want_z)
    finally:
        X.BLOCK = old


def test_word_bounds_and_hashes():
    texts = ["Ab, ç d\n", "", None, "ab AB!x", "é" * 3]
    seen = []
    for lo, hi, data, offs in pieces(pa.array(texts, pa.string())):
        w = words(data, offs, PUNCT)
        h = w.hashes()
        for r, s, e, k in zip(w.row, w.start, w.end, h):
            seen.append((int(r) + lo, bytes(data[s:e]).decode(), int(k)))
    assert [(r, t) for r, t, _ in seen] == [(0, "ab"), (0, "ç"), (0, "d"), (3, "ab"), (3, "ab"), (3, "x"), (4, "ééé")]
    assert len({k for _, t, k in seen}) == len({t for _, t, _ in seen})


def corpus(n=500, seed=0):
    rng = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(rng.randrange(2, 8)):
                text[rng.randrange(len(text))] = rng.choice(["vilexx", "zorkel", "Zorkelig", "grumfy"])
        rows.append((i, " ".join(text), "k", 1))
        labels.append((i, toxic))
    return rows, labels


SCHEMA = "doc_id long, text string, id string, score int"


def test_held_out_documents_and_spans(spark):
    rows, labels = corpus()
    rows += [(1000, None, "k", 1), (1001, "", "k", 1), (1002, "!!!", "k", 1), (None, "vilexx zorkel é zorkel", "k", 1),
             (1003, "é vilexx, ok. " + "bal " * 5000, "k", 1), (1003, "é vilexx, ok. " + "bal " * 5000, "k", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labs = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = X.score_documents(docs, labs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and all(r.predicted == truth[r.doc_id] for r in held)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    assert by[1000].score == by[1001].score == by[1002].score < 0.3 and by[1000].spans == []
    assert by[None].predicted == 1 and by[None].held_out is False and [list(s) for s in by[None].spans] == [[0, 13], [16, 22]]
    assert [list(s) for s in by[1003].spans] == [[2, 8]]
    kept = X.reject_toxic(docs, labs)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "k", 1)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted, r.spans) for r in X.score_documents(docs, none).collect()] == [(0.0, 0, [])]
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert X.score_documents(docs, one).first().predicted == 0 and X.reject_toxic(docs, one).count() == 1
    assert X.score_documents(docs.limit(0), none).count() == 0


def test_the_fit_runs_its_full_rounds():
    rows, labels = corpus(120)
    texts, y = [t for _, t, *_ in rows], [l for _, l in labels]
    got, want = X.fit(texts, y, 0.2), X.fit(texts, y, 0.2, rounds=20)
    assert np.array_equal(got.weights, want.weights) and np.array_equal(got.curve, want.curve)


def test_chains_are_fitted_in_tasks_not_on_the_driver(spark, monkeypatch):
    rows, labels = corpus(150)
    docs, labs = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    sample, share = X.training_rows(docs, labs, "doc_id", "text", "toxic", 1000)
    taught = sorted(map(tuple, sample.select("_id", "_y", "_text").collect()))
    want = X.fit([r[2] for r in taught], [r[1] for r in taught], share)

    def on_driver(*_):
        raise AssertionError("trained on the driver")
    monkeypatch.setattr(X, "fit", on_driver)
    got = X.fit_rows(sample, share)
    assert np.array_equal(got.weights, want.weights) and np.array_equal(got.trans, want.trans) and got.start == want.start
    assert np.allclose(got.curve, want.curve, rtol=1e-12, atol=0)
    scores = {r.doc_id: r.score for r in X.score_documents(docs, labs).collect()}
    again = {r.doc_id: r.score for r in X.apply_model(docs, want, "doc_id", "text", X.PREDICT_AT).collect()}
    assert len(scores) == 150 and all(abs(scores[i] - again[i]) < 1e-9 for i in scores)
