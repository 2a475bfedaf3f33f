"""Toxicity by a linear-chain conditional random field (operator 8).

Tokens are tagged clean or toxic by a two-state chain over the words of the whole text; features
of a word are its hash, its prefixes and its suffixes. Labels are per document, so the training
tokens are labelled from them: a token of a toxic document is toxic if one of its features is
tied to toxic documents (log-likelihood ratio and precision over the sample). The chain is
fitted to these tokens by maximum likelihood; forward-backward marginals of a text add up to its
document features, and a logistic curve fitted on the sample turns them into the score.

The classifier is fitted on a bounded sample of labelled rows: at most SAMPLE per class, first
in the order of a hash of the id, near copies removed, so that a group of copies can't make its
own words look toxic. Scoring is one pass over the texts without a shuffle; the recursions run
over blocks of tokens, vectorised, with exact chains over texts of any length.

Cases: null, empty and wordless texts get the score of a text without toxic tokens; without
labelled rows of both classes the score is 0 everywhere; a null id is not held out; labels that are null
are ignored and of contradicting labels the larger counts; repeated rows are scored each; empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitio.llm.bagminhash import band_keys, signatures
from transitio.llm.common import stored
from transitio.llm.tokens import PUNCT, Words, bags, pieces, shingles, words

SAMPLE = 1000
FEATURE_BITS = 18
PREFIXES = (3, 4, 5, 6)
SUFFIXES = (3, 4)
ROUNDS = 20
BLOCK = 64
PREDICT_AT = 0.7
LEAST_RATIO = 20.0
LEAST_PRECISION = 0.95
#: Log weight of the toxic state for a word of which no feature was seen in training.
UNSEEN = -10.0
FOLDS = 3
#: Pull of every weight towards its start, against the summed log likelihood: rare features move little.
RIDGE = 0.5
_U = np.uint64


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def features(w: Words) -> np.ndarray:
    """(tokens, features) slots in the weight table: word, prefixes, suffixes (bytes)."""
    out = [w.hashes()]
    for k in PREFIXES:
        out.append(w.hash_of(w.start, np.minimum(w.start + k, w.end)) ^ _U(k * 0x51ED2701))
    for k in SUFFIXES:
        out.append(w.hash_of(np.maximum(w.end - k, w.start), w.end) ^ _U(k * 0x7C3A9E15))
    mask = _U((1 << FEATURE_BITS) - 1)
    return np.stack([((h >> _U(17)) & mask).astype(np.int32) for h in out], axis=1) if len(w.row) else np.zeros((0, len(out)), np.int32)


@dataclass
class Model:
    weights: np.ndarray  # per feature slot, for the toxic state
    trans: np.ndarray    # log transition weights, [from, to]
    start: float         # log weight of starting toxic
    curve: np.ndarray    # logistic curve over (1, log1p(sum), max logit)


class Chains:
    """Forward-backward over the chains of many texts: tokens are laid out in blocks of BLOCK; block
    transfer matrices, then a recursion over blocks, then recursions inside all blocks at once."""

    def __init__(self, row: np.ndarray, rows: int):
        count = np.bincount(row, minlength=rows)
        self.blocks = -(-count // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(self.blocks)])
        begin = np.concatenate([[0], np.cumsum(count)])
        within = np.arange(len(row)) - begin[row]
        self.at = (self.first[row] + within // BLOCK) * BLOCK + within % BLOCK
        self.n = int(self.first[-1])
        self.real = np.zeros(self.n * BLOCK, dtype=bool)
        self.real[self.at] = True
        self.begins = np.zeros(self.n * BLOCK, dtype=bool)
        self.begins[self.first[:-1][count > 0] * BLOCK] = True

    def run(self, unary: np.ndarray, trans: np.ndarray, start: float, moves: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
        """(toxic marginal per token, expected transitions [2, 2], log partition over all texts)."""
        n = self.n
        if not n:
            return np.zeros(0), np.zeros((2, 2)), 0.0
        u = np.zeros(n * BLOCK)
        u[self.at] = np.clip(unary, -30, 30)
        e = np.exp(u).reshape(n, BLOCK)
        real, begins = self.real.reshape(n, BLOCK), self.begins.reshape(n, BLOCK)
        m = np.exp(trans)
        # step matrices: rows "from"; the first token of a text has no transition, padding changes nothing
        t00 = np.where(real, np.where(begins, 1.0, m[0, 0]), 1.0)
        t10 = np.where(real & ~begins, m[1, 0], 0.0)
        t01 = np.where(real & ~begins, m[0, 1], 0.0) * e
        t11 = np.where(real, np.where(begins, 1.0, m[1, 1]), 1.0) * e
        p = np.zeros((n, 2, 2))
        p[:, 0, 0] = p[:, 1, 1] = 1.0
        for k in range(BLOCK):
            a, b = p[:, :, 0].copy(), p[:, :, 1].copy()
            p[:, :, 0] = a * t00[:, k, None] + b * t10[:, k, None]
            p[:, :, 1] = a * t01[:, k, None] + b * t11[:, k, None]
            p /= p.sum(axis=(1, 2))[:, None, None]
        fore, back = np.ones((n, 2)), np.ones((n, 2))
        has = np.flatnonzero(self.blocks)
        begin, last = self.first[has], self.first[has] + self.blocks[has] - 1
        fore[begin] = [1.0, np.exp(start)]
        for k in range(1, int(self.blocks.max())):
            at = begin[begin + k <= last] + k
            v = np.einsum("ni,nij->nj", fore[at - 1], p[at - 1])
            fore[at] = v / v.sum(axis=1)[:, None]
            at = last[last - k >= begin] - k
            v = np.einsum("nij,nj->ni", p[at + 1], back[at + 1])
            back[at] = v / v.sum(axis=1)[:, None]
        al = np.empty((n, BLOCK, 2))
        before = np.empty((n, BLOCK, 2))
        v, log_z = fore / fore.sum(axis=1)[:, None], 0.0
        log_z += np.log1p(np.exp(start)) * len(has)
        for k in range(BLOCK):
            before[:, k] = v
            v = np.stack([v[:, 0] * t00[:, k] + v[:, 1] * t10[:, k], v[:, 0] * t01[:, k] + v[:, 1] * t11[:, k]], axis=1)
            s = v.sum(axis=1)
            log_z += np.log(s).sum()
            v /= s[:, None]
            al[:, k] = v
        be = np.empty((n, BLOCK, 2))
        v = back
        for k in range(BLOCK - 1, -1, -1):
            be[:, k] = v
            v = np.stack([t00[:, k] * v[:, 0] + t01[:, k] * v[:, 1], t10[:, k] * v[:, 0] + t11[:, k] * v[:, 1]], axis=1)
            v /= v.sum(axis=1)[:, None]
        both = al * be
        marg = (both[:, :, 1] / both.sum(axis=2)).ravel()[self.at]
        if not moves:
            return marg, np.zeros((2, 2)), log_z
        x = np.stack([before[:, :, 0] * t00 * be[:, :, 0], before[:, :, 0] * t01 * be[:, :, 1],
                      before[:, :, 1] * t10 * be[:, :, 0], before[:, :, 1] * t11 * be[:, :, 1]], axis=2)
        x /= x.sum(axis=2)[:, :, None]
        return marg, x[real & ~begins].sum(axis=0).reshape(2, 2), log_z


def document_features(marg: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """(1, log1p(sum of marginals), logit of the largest) per text; a text without words has marginal 0."""
    total = np.bincount(row, weights=marg, minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, row, marg)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(rows), np.log1p(total), np.log(top / (1 - top)) / 10.0], axis=1)


def tied_slots(parts: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> np.ndarray:
    """Feature slots that are tied to toxic texts, from (features, row) pieces: whole texts count once."""
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()], dtype=np.float64)
    slots = 1 << FEATURE_BITS
    seen = [np.zeros(slots), np.zeros(slots)]
    for feat, row in parts:
        for f in range(feat.shape[1]):
            pair = np.unique(row.astype(np.int64) << FEATURE_BITS | feat[:, f])
            for y in (0, 1):
                seen[y] += np.bincount(pair[toxic[pair >> FEATURE_BITS] == y] & (slots - 1), minlength=slots)
    share = (seen[0] + seen[1]) / n.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * sum(np.where(c > 0, c * np.log(c / (m * share)), 0.0) +
                        np.where(m - c > 0, (m - c) * np.log((m - c) / (m * (1 - share))), 0.0)
                        for c, m in ((seen[0], n[0]), (seen[1], n[1])))
        rate = seen[1] / n[1] / (seen[1] / n[1] + (seen[0] + 0.5) / n[0])
    return (np.nan_to_num(ratio) >= LEAST_RATIO) & (np.nan_to_num(rate) >= LEAST_PRECISION)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    return w


def distinct_texts(texts: list[str]) -> list[int]:
    """Indices of texts that share no band of a small signature with an earlier one."""
    seen: set[int] = set()
    keep = []
    for lo, hi, data, offs in pieces(pa.array(texts, pa.string())):
        r, e, c = bags(*shingles(words(data, offs, PUNCT), 5))
        keys = band_keys(signatures(hi - lo, r, e, c, 16), 8, 2)
        for i in range(hi - lo):
            mine = set(keys[i].tolist())
            if not mine & seen:
                keep.append(lo + i)
            seen |= mine
    return keep


def _dealt(texts: list[str], labels: list[int]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct texts of the sample, their labels and folds (balanced within each label)."""
    keep = distinct_texts(texts)
    texts, toxic = [texts[i] for i in keep], np.array([labels[i] for i in keep], dtype=np.int64)
    fold = np.zeros(len(texts), dtype=np.int64)
    for c in (0, 1):
        fold[toxic == c] = np.arange((toxic == c).sum()) % FOLDS
    return texts, toxic, fold


def _chain_of(k: int, texts: list[str], toxic: np.ndarray, fold: np.ndarray, rounds: int) -> tuple[Model | None, np.ndarray]:
    """Chain ``k`` and its document features: chain FOLDS is fitted on all texts, a smaller one on the other
    folds, with the features of its own fold's texts (zeros if it can't be fitted)."""
    if k == FOLDS:
        return _fit_chain(texts, toxic, rounds), np.zeros((0, 3))
    mine = [t for t, f in zip(texts, fold) if f == k]
    if not (toxic[fold != k].any() and mine):
        return None, np.zeros((len(mine), 3))
    part = _fit_chain([t for t, f in zip(texts, fold) if f != k], toxic[fold != k], rounds)
    return part, np.concatenate([document_features(marg, w.row, w.rows) for w, marg in _marginals(part, mine)])


def _with_curve(model: Model, x: np.ndarray, y: np.ndarray, share: float) -> Model:
    """The curve's constant is moved from the sample's share of toxic texts to ``share``."""
    model.curve = _logistic(x, y)
    share = min(max(share, 1e-4), 1 - 1e-4)
    model.curve[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return model


def fit(texts: list[str], labels: list[int], share: float, rounds: int = ROUNDS) -> Model | None:
    """The chain and the curve from labelled texts; None without both classes. The curve is fitted on
    texts that their chain has not seen: FOLDS chains, each on the other folds."""
    texts, toxic, fold = _dealt(texts, labels)
    if len(set(toxic.tolist())) < 2:
        return None
    x = np.zeros((len(texts), 3))
    for k in range(FOLDS):
        x[fold == k] = _chain_of(k, texts, toxic, fold, rounds)[1]
    return _with_curve(_chain_of(FOLDS, texts, toxic, fold, rounds)[0], x, toxic.astype(np.float64), share)


def fit_rows(rows: DataFrame, share: float, rounds: int = ROUNDS) -> Model | None:
    """``fit`` on the rows (_id, _y, _text) of a bounded sample: each of the FOLDS + 1 chains is a task of
    its own. The driver gets the last chain's weights and three features per text, never a text."""
    schema = "k int, toxic array<double>, fold array<int>, x array<double>, weights binary, trans array<double>, start double"

    def run(key: tuple, t: pa.Table) -> pa.Table:
        k = key[0].as_py()
        order = sorted(zip(t.column("_id").to_pylist(), t.column("_y").to_pylist(), t.column("_text").to_pylist()))
        texts, toxic, fold = _dealt([r[2] for r in order], [int(r[1]) for r in order])
        model, x = _chain_of(k, texts, toxic, fold, rounds) if len(set(toxic.tolist())) == 2 else (None, np.zeros((0, 3)))
        last = k == FOLDS and model is not None
        cols = [k, toxic.astype(np.float64).tolist() if last else [], fold.tolist() if last else [], x.ravel().tolist(),
                model.weights.tobytes() if last else None, model.trans.ravel().tolist() if last else [], model.start if last else None]
        kinds = [pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.binary(), pa.list_(pa.float64()), pa.float64()]
        return pa.table({n: pa.array([v], kind) for n, v, kind in zip(("k", "toxic", "fold", "x", "weights", "trans", "start"), cols, kinds)})

    each = rows.select("_id", "_y", "_text", F.explode(F.expr(f"sequence(0, {FOLDS})")).alias("k"))
    # a partition per chain: its groups are not put together in one task
    got = {r["k"]: r for r in each.repartitionByRange(FOLDS + 1, "k").groupBy("k").applyInArrow(run, schema).collect()}
    last = got.get(FOLDS)
    if last is None or last["weights"] is None:
        return None
    toxic, fold = np.array(last["toxic"]), np.array(last["fold"])
    x = np.zeros((len(toxic), 3))
    for k in range(FOLDS):
        x[fold == k] = np.array(got[k]["x"]).reshape(-1, 3)
    model = Model(np.frombuffer(last["weights"], dtype=np.float32), np.array(last["trans"]).reshape(2, 2), last["start"], np.zeros(3))
    return _with_curve(model, x, toxic, share)


def _marginals(model: Model, texts: list[str]) -> Iterator[tuple[Words, np.ndarray]]:
    for _, _, data, offs in pieces(pa.array(texts, pa.string())):
        w = words(data, offs, PUNCT)
        yield w, Chains(w.row, w.rows).run(_unary(model.weights, features(w)), model.trans,
                                           model.start, moves=False)[0]


def _unary(weights: np.ndarray, feat: np.ndarray) -> np.ndarray:
    return sum(weights[feat[:, f]] for f in range(feat.shape[1])).astype(np.float64)


def _fit_chain(texts: list[str], toxic: np.ndarray, rounds: int) -> Model:
    """Penalised maximum likelihood by Adam; sums run over pieces of the sample, so memory holds the
    features of the sample and the recursions of one piece."""
    parts = []
    for lo, _, data, offs in pieces(pa.array(texts, pa.string())):
        w = words(data, offs, PUNCT)
        parts.append((features(w), w.row, lo, w.rows))
    tied = tied_slots([(feat, row + lo) for feat, row, lo, _ in parts], toxic)
    slots = 1 << FEATURE_BITS
    seen, starts, observed, work = np.zeros((2, 2)), 0.0, np.zeros(slots), []
    for feat, row, lo, rows in parts:
        y = tied[feat].any(axis=1) & (toxic[row + lo] == 1)  # the token labels
        follows = row[1:] == row[:-1]
        first = np.concatenate([np.ones(min(len(row), 1), dtype=bool), ~follows])
        np.add.at(seen, (y[:-1][follows].astype(int), y[1:][follows].astype(int)), 1)
        starts += y[first].sum()
        for f in range(feat.shape[1]):
            observed += np.bincount(feat[y, f], minlength=slots)
        work.append((feat, first, Chains(row, rows)))
    theta = np.concatenate([np.full(slots, UNSEEN / (1 + len(PREFIXES) + len(SUFFIXES))), np.zeros(5)])  # weights, transitions, start
    centre = theta.copy()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        g = np.concatenate([-observed, -seen.ravel(), [-starts]]) + RIDGE * (theta - centre)
        for feat, first, chains in work:
            marg, moves, _ = chains.run(_unary(theta, feat), theta[slots:slots + 4].reshape(2, 2), theta[-1])
            for f in range(feat.shape[1]):
                g[:slots] += np.bincount(feat[:, f], weights=marg, minlength=slots)
            g[slots:slots + 4] += moves.ravel()
            g[-1] += marg[first].sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.6 * (1 - (k - 1) / rounds) * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-7)
    return Model(theta[:slots].astype(np.float32), theta[slots:slots + 4].reshape(2, 2), float(theta[-1]), np.zeros(3))


def tag(model: Model, text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """(first row, last row, scores, spans) of pieces; spans are [start, end) code points of the
    words whose toxic marginal is at least one half, neighbours joined."""
    for lo, hi, data, offs in pieces(text):
        w = words(data, offs, PUNCT)
        n = hi - lo
        marg, _, _ = Chains(w.row, n).run(_unary(model.weights, features(w)), model.trans, model.start, moves=False)
        x = document_features(marg, w.row, n)
        score = 1 / (1 + np.exp(-np.clip(x @ model.curve, -30, 30)))
        hit = np.flatnonzero(marg >= 0.5)
        char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        start, end, row = w.start[hit], w.end[hit], w.row[hit]
        new = np.ones(len(hit), dtype=bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(hit)) - 1
        base = char[offs[row[begin]]] if len(begin) else np.zeros(0, dtype=np.int64)
        bounds = np.stack([char[start[begin]] - base, char[end[stop]] - base], axis=1) if len(begin) else np.zeros((0, 2), np.int64)
        cut = np.searchsorted(row[begin], np.arange(n + 1)) if len(begin) else np.zeros(n + 1, dtype=np.int64)
        yield lo, hi, score, [bounds[cut[i]:cut[i + 1]] for i in range(n)]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                  sample: int) -> tuple[DataFrame, float]:
    """(rows, share of toxic ones among all labelled rows). At most ``sample`` labelled rows per class that are not held out, in the order of a hash of the
    id; chosen from the labels alone, then fetched by a broadcast of the chosen ids."""
    per = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)) \
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    chosen = [per.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample) for y in (0, 1)]
    totals = {r["_y"]: r["count"] for r in per.groupBy("_y").count().collect()}  # two rows
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    ids = chosen[0].unionByName(chosen[1])  # at most 2 * sample rows
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")) \
        .join(F.broadcast(ids), "_id").dropDuplicates(["_id"])
    return stored(rows, "toxic-sample"), share


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", sample: int = SAMPLE, at: float = PREDICT_AT) -> DataFrame:
    """id, held_out, score, predicted, spans (array of code point [start, end) pairs)."""
    rows, share = training_rows(docs, labels, id_col, text_col, label_col, sample)
    model = fit_rows(rows, share)
    return apply_model(docs, model, id_col, text_col, at)


def apply_model(docs: DataFrame, model: Model | None, id_col: str, text_col: str, at: float) -> DataFrame:
    src = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    plain = None if model is None else (model.weights, model.trans, model.start, model.curve)  # 2^FEATURE_BITS floats
    shared = docs.sparkSession.sparkContext.broadcast(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value) if shared.value is not None else None
        pair = pa.list_(pa.int64())
        for b in batches:
            parts = tag(model, b.column(2)) if model is not None else \
                [(0, b.num_rows, np.zeros(b.num_rows), [np.zeros((0, 2), np.int64)] * b.num_rows)]
            for lo, hi, score, spans in parts:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(score),
                     pa.array((score >= at).astype(np.int32)),
                     pa.array([s.tolist() for s in spans], pa.list_(pair))],
                    names=["id", "held_out", "score", "predicted", "spans"])

    kind = src.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("held_out", T.BooleanType()),
                           T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
                           T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", sample: int = SAMPLE, at: float = PREDICT_AT) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; no shuffle."""
    rows, share = training_rows(docs, labels, id_col, text_col, label_col, sample)
    model = fit_rows(rows, share)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.trans, model.start, model.curve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for b in batches:
            for lo, hi, score, _ in tag(model, b.column(b.schema.get_field_index(text_col))):
                yield b.slice(lo, hi - lo).filter(pa.array(score < at))

    return docs.mapInArrow(run, docs.schema)
