"""Packing into optimal length buckets (operator 4).

Documents are cut into pieces of at most ``max_len`` words. Dynamic programming over the global
histogram of piece lengths chooses at most ``buckets`` boundaries such that padding every piece
to its bucket's boundary adds the fewest words (of equal solutions the one with the smallest
boundaries from the top down). Within a bucket, pieces are put into a hash-seeded order and cut
into batches of at most ``budget`` padded words.

The histogram has at most max_len + 1 rows whatever the corpus, so it and the boundaries pass
through the driver. Positions in a bucket come from a two-level index (hash slots, then prefix
sums over slot sizes), so a bucket with a third of all rows is spread over thousands of windows.

Cases: a null text, or one without a word, is one piece of length 0; repeated rows are packed
each; a null id is ordered by its text's MD5; a bucket longer than the budget has one piece per
batch; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitio.llm.common import stored
from transitio.operators.sampling import dense_index

MAX_LEN = 2048
BUCKETS = 8
BUDGET = 16384
SEED = "pack"
BLANKS = r"[\t\n\f\r ]+"


def pieces(docs: DataFrame, id_col: str, text_col: str, max_len: int, seed: str) -> DataFrame:
    """(id, piece, start, n_tokens, h): the cuts of every document and the hash that orders them."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), rf"^{BLANKS}|{BLANKS}$", "")
    count = F.when(text == "", 0).otherwise(F.size(F.split(text, BLANKS)))
    ident = F.coalesce(F.col(id_col).cast("string"), F.md5(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), ident.alias("key"), count.alias("n"))
    df = df.withColumn("piece", F.explode(F.expr(f"sequence(0, greatest(cast(ceil(n / {max_len}) as int), 1) - 1)")))
    h = F.md5(F.concat(F.lit(f"{seed}:"), "key", F.lit(":"), F.col("piece")))
    return df.select("id", "piece", (F.col("piece") * max_len).alias("start"),
                     F.least(F.lit(max_len), F.col("n") - F.col("piece") * max_len).alias("n_tokens"), h.alias("h"))


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ascending bucket boundaries (members of ``lengths``) with the least padded total."""
    n = len(lengths)
    if not n:
        return []
    before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    cost = lengths.astype(np.int64) * before[1:]
    came = []
    for _ in range(1, min(buckets, n)):
        nxt, prev = np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64)
        for j in range(len(came) + 1, n):
            i = np.arange(len(came), j)
            c = cost[i] + lengths[j] * (before[j + 1] - before[i + 1])
            prev[j] = i[np.argmin(c)]
            nxt[j] = c.min()
        came.append(prev)
        cost = nxt
    j, out = n - 1, []
    for prev in [*came[::-1], None]:
        out.append(int(lengths[j]))
        j = int(prev[j]) if prev is not None else j
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, buckets: int = BUCKETS,
         budget: int = BUDGET, seed: str = SEED) -> DataFrame:
    """id, piece, start, n_tokens, bucket, padded_len, batch, slot: one row per piece."""
    cut = stored(pieces(docs, id_col, text_col, max_len, seed), "pack-pieces")
    hist = sorted(cut.groupBy("n_tokens").count().collect())  # at most max_len + 1 rows
    bounds = boundaries(np.array([r[0] for r in hist], dtype=np.int64), np.array([r[1] for r in hist], dtype=np.int64), buckets)
    ends = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<int>")
    df = cut.withColumn("_ends", ends).withColumn("bucket", F.expr("size(filter(_ends, b -> b < n_tokens))"))
    df = df.withColumn("padded_len", F.expr("try_element_at(_ends, bucket + 1)")).drop("_ends")
    df = dense_index(df, ["bucket"], F.col("h"), "piece", name="pos")
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded_len"), F.lit(1))))
    return df.select(F.col("id").alias(id_col), "piece", "start", "n_tokens", "bucket", "padded_len",
                     F.floor(F.col("pos") / per).alias("batch"), (F.col("pos") % per).alias("slot"))
