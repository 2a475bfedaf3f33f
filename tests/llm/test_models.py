"""Language identification and cross-entropy scoring against plain Python."""
import math
import random
import re
from collections import Counter

import numpy as np

from transitio.llm import bloom_langid as G
from transitio.llm import cross_entropy as C


def test_filters_hold_every_member_and_masks_agree():
    rng = np.random.default_rng(0)
    members = [rng.integers(0, 2 ** 63, 4000).astype(np.uint64) for _ in range(70)]
    table, rate = G.build([f"l{i}" for i in range(70)], members)
    assert table.shape[1] == 2
    for l in (0, 63, 64, 69):
        mask = np.bitwise_and.reduce([table[G.slots(members[l], k), l // 64] for k in range(G.HASHES)])
        assert ((mask >> np.uint64(l % 64)) & np.uint64(1)).all()
    other = rng.integers(0, 2 ** 63, 20000).astype(np.uint64)
    hit = np.bitwise_and.reduce([table[G.slots(other, k), 0] for k in range(G.HASHES)]) & np.uint64(1)
    assert abs(hit.mean() - rate[0]) < 0.01


def lang_rows(n=600, seed=0):
    rng = random.Random(seed)
    parts = {"aa": ["ba", "da", "ga", "lo"], "bb": ["pri", "tru", "ska", "lo"], "cc": ["né", "mé", "çu", "lo"]}
    rows = []
    for i in range(n):
        lang = rng.choice("aab")
        lang = {"a": "aa", "b": "bb"}[lang] if rng.random() < 0.8 else "cc"
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(30)), lang, "x"))
    return rows


def test_held_out_languages(spark):
    rows = lang_rows() + [(1000, None, "aa", "x"), (1001, "123 !?", "aa", "x"), (1002, "", None, "x"), (1003, "qqqqqqq", None, "x"),
                          (None, "ba da ga badaga dagaba", None, "x"), (1004, "Ba DA ga badaga " * 3000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = G.predict(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    held = [(by[i].lang_pred, lang) for i, _, lang, _ in rows[:600] if by[i].held_out]
    assert len(held) > 150 and all(a == b for a, b in held)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[1003].lang_pred in ("aa", "bb", "cc") and by[None].lang_pred == by[1004].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in G.predict(df.limit(3).withColumn("lang", df.lang.substr(99, 1)).where("false")).collect()} == set()


def test_without_languages_all_is_undetermined(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "def", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in G.predict(df).collect()] == ["und", "und"]


def lm_rows(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(vocab, weights=range(1, 41) if i % 3 else range(40, 0, -1), k=rng.randrange(5, 60)))) for i in range(120)]
    return rows + [(500, None), (501, ""), (502, "...!"), (503, "new-word W1 unseen"), (None, "w1 w2 w3"), (3, rows[3][1])]


def brute_scores(rows, good):
    toks = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    sets = [[toks(t) for _, t in rows], [toks(t) for i, t in rows if i in good]]
    bg = Counter(w for d in sets[0] for w in d)
    vocab = {w for w, c in bg.items() if c >= C.LEAST}
    size = len(vocab) + 1
    ident = lambda w: w if w in vocab else None
    models = []
    kept = None
    for s in sets:
        uni = Counter(ident(w) for d in s for w in d)
        pairs = Counter((a, b) for d in s for a, b in zip(["<s>", *map(ident, d)], map(ident, d)) if a is not None and b is not None)
        if kept is None:
            kept = {p for p, c in pairs.items() if c >= C.LEAST}
        pairs = {p: pairs[p] for p in kept}
        hist = Counter(uni)
        hist["<s>"] = sum(bool(d) for d in s)
        mass = Counter()
        for (a, _), c in pairs.items():
            mass[a] += c
        models.append((uni, pairs, hist, mass, sum(uni.values())))

    def loss(model, a, w):
        uni, pairs, hist, mass, total = model
        c = max(hist[a], 1)
        return -math.log(C.BIGRAM * pairs.get((a, w), 0) / c + (1 - C.BIGRAM * mass[a] / c) * (uni[w] + 1) / (total + size))

    out = []
    for i, t in rows:
        d = [ident(w) for w in toks(t)]
        ce = [sum(loss(m, a, w) for a, w in zip(["<s>", *d], d)) / len(d) if d else None for m in models]
        out.append((i, len(d), ce[1], ce[0]))
    return out, models, vocab, loss


def test_scores_match_brute_force_and_sum_to_one(spark):
    rows, good = lm_rows(), {i for i in range(0, 120, 3)}
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, id int")
    target = spark.createDataFrame([(i,) for i in good] + [(None,), (9999,), (0,)], "doc_id long")
    got = sorted(((r.doc_id, r.n_tokens, r.ce_target, r.ce_background) for r in C.score_documents(docs, target).collect()), key=str)
    want, models, vocab, loss = brute_scores(rows, good)
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:2] == w[:2] and (w[2] is None and g[2] is None or abs(g[2] - w[2]) < 1e-9 and abs(g[3] - w[3]) < 1e-9)
    for m in models:
        assert abs(sum(math.exp(-loss(m, "w7", w)) for w in [*vocab, None]) - 1) < 1e-9


def test_empty_corpus_and_no_target(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([], "doc_id long")
    assert C.score_documents(docs, target).count() == 0
    one = spark.createDataFrame([(1, "a a b")], "doc_id long, text string")
    assert C.score_documents(one, target).first().n_tokens == 3


def test_rare_words_stay_known_in_a_large_corpus(spark):
    rows = [(i, "a b " * 20000) for i in range(10)] + [(100 + i, "rare gem " + "c d " * 5) for i in range(3)] + [(200, "never seen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(100 + i,) for i in range(3)], "doc_id long")
    got = {r.doc_id: r for r in C.score_documents(docs, target).collect()}  # 400,000 tokens
    want = {i: (t, b) for i, _, t, b in brute_scores(rows, {100, 101, 102})[0]}
    for i, r in got.items():
        assert abs(r.ce_target - want[i][0]) < 1e-9 and abs(r.ce_background - want[i][1]) < 1e-9
    probe = spark.createDataFrame(rows + [(300, "rare gem")], "doc_id long, text string")
    got = {r.doc_id: r for r in C.score_documents(probe, target).collect()}
    assert got[300].ce_target < got[200].ce_target - 1 and got[300].ce_background < got[200].ce_background - 1  # were the same


def test_scores_do_not_depend_on_chunks_and_shards(spark):
    rows, good = lm_rows(), range(0, 120, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in good], "doc_id long")
    runs = [sorted((tuple(r) for r in C.score_documents(docs, target, chunk_bytes=x).collect()), key=str) for x in (150, 3000, 1 << 20)]
    assert runs[0] == runs[1] == runs[2]


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2 ** 64, 5000, dtype=np.uint64))
    counts = [rng.integers(1, 9, len(keys)), rng.integers(0, 2 ** 40, len(keys))]
    t = C.sent(7, 3, keys, counts)
    assert t.num_rows == 8 and sum(t.column("n").to_pylist()) == len(keys)
    back = [C.unpacked(b, n, 3) for b, n in zip(t.column("block").to_pylist(), t.column("n").to_pylist())]
    assert (np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in back]) == keys).all()
    for i, c in enumerate(counts):
        assert (np.concatenate([p[1 + i] for p in back]).astype(np.int64) == c).all()
    assert C.sent(7, 3, keys[:0], [keys[:0]]).num_rows == 0


def test_texts_are_not_shuffled_for_scoring(spark):
    docs = spark.createDataFrame(lm_rows(), "doc_id long, text string")
    plan = C.score_documents(docs, docs.select("doc_id").limit(5))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # the answers alone move


def test_rare_language_is_learned_beside_a_hot_one(spark):
    rows = [(i, "ba da ga lo", "aa") for i in range(3000)] + [(5000 + i, "pri tru ska priska truska", "bb") for i in range(3)] \
        + [(None, "skapri trupri priska", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    totals, rates = G.gram_rates(df, "doc_id", "text", "lang", 1)
    assert set(totals) == {"aa", "bb"} and rates["bb"] and totals["aa"] > 1500
    assert [r.lang_pred for r in G.predict(df, sample=1).where("doc_id IS NULL").collect()] == ["bb"]
