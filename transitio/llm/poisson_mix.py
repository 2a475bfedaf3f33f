"""Mixing sources to target weights by Poisson replication (operator 10).

Each source has a mean repetition rate: its target share of the output's characters times the
characters of the whole corpus (times ``epochs``), over its own characters. A document's number
of copies is a Poisson draw with that mean: its hash-seeded uniform number is put through the
inverse distribution function. Documents are exploded by their counts and shuffled globally by
a hash of (seed, id, copy).

Target shares are given per source, or follow a temperature: share ~ characters ** alpha. Rates
above PART are drawn as a sum of independent draws of smaller mean (exact for Poisson), so that
exp(-rate) never underflows. The distribution table of a source holds at most a few hundred
numbers. The rate table is broadcast only if its measured size is below BROADCAST_BYTES;
beyond it the rows meet their rate in a salted join.

Cases: a null source is a source of its own; a null text has no characters; a source without
characters has rate ``epochs``; a null id draws by the MD5 of its text; repeated rows draw the
same count each; a source that is not in a given target has rate 0; empty tables give empty
results. The added columns
(``copy_col``, ``key_col``) replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitio.llm.common import salted_join, stored

SEED = "mix"
ALPHA = 0.5
PART = 32.0
BROADCAST_BYTES = 8 << 20


def rates(docs: DataFrame, source_col: str, text_col: str, targets: dict[str, float] | None, alpha: float,
          epochs: float) -> DataFrame:
    """(_source, rate, parts, cdf): mean copies, number of draws, and the distribution function of one draw."""
    mass = stored(docs.groupBy(F.col(source_col).alias("_source"))
                  .agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).cast("double").alias("mass")), "mix-mass")
    if targets is None:
        want = F.pow("mass", F.lit(alpha))
    else:
        want = F.lit(0.0)
        for name, weight in targets.items():
            want = F.when(F.col("_source") == name, F.lit(float(weight))).otherwise(want)
    mass = mass.withColumn("want", F.when(F.col("mass") > 0, want).otherwise(0.0))
    total = mass.agg(F.sum("mass").alias("m"), F.sum("want").alias("w")).first()
    m, w = total["m"] or 0.0, total["w"] or 0.0
    rate = F.when(F.col("mass") > 0, F.col("want") / F.lit(w or 1.0) * F.lit(m) / F.col("mass") * F.lit(epochs)) \
        .otherwise(F.lit(float(epochs)))
    df = mass.select("_source", rate.alias("rate")) \
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")) \
        .withColumn("mean", F.col("rate") / F.col("parts"))
    # cumulative Poisson probabilities to where the tail is below the resolution of the uniform numbers
    return df.withColumn("cdf", F.expr("""
      aggregate(sequence(1, cast(mean + 12 * sqrt(mean) + 20 as int)),
        named_struct('p', exp(-mean), 'c', exp(-mean), 'out', array(exp(-mean))),
        (a, k) -> named_struct('p', a.p * mean / k, 'c', a.c + a.p * mean / k,
                               'out', concat(a.out, array(a.c + a.p * mean / k))),
        a -> a.out)""")).drop("mean")


def _uniform(digest: str) -> str:
    return f"(cast(conv(substring({digest}, 1, 13), 16, 10) as double) / 4503599627370496D)"


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                targets: dict[str, float] | None = None, alpha: float = ALPHA, epochs: float = 1.0,
                seed: str = SEED, copy_col: str = "copy", key_col: str = "mix_key") -> DataFrame:
    """The rows of ``docs``, each as often as drawn, with their number (from 1) and ``key_col``, dealt to
    partitions by the key and in its order within each."""
    cols = [c for c in docs.columns if c not in (copy_col, key_col)]
    table = stored(rates(docs, source_col, text_col, targets, alpha, epochs), "mix-rates")
    size = table.agg(F.coalesce(F.sum(F.size("cdf") * 8 + F.coalesce(F.octet_length(F.col("_source").cast("string")),
                                                                    F.lit(0)) + 64), F.lit(0)).alias("b")).first()["b"]
    table = table.select(F.coalesce(F.to_json(F.struct("_source")), F.lit("")).alias("_key"), "parts", "cdf")
    key = F.coalesce(F.to_json(F.struct(F.col(source_col).alias("_source"))), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("string"), F.md5(text_col), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), key.alias("_key"), ident.alias("_id"))
    if size <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(table), "_key")
    else:
        rows = salted_join(rows, table, ["_key"], F.col("_id"), "inner")
    rows = rows.withColumn("_n", F.expr(f"""
      aggregate(sequence(0, parts - 1), 0, (n, j) -> n + aggregate(
        array({_uniform(f"md5(concat('{seed}:', _id, ':', j))")}), 0,
        (z, u) -> size(filter(cdf, c -> c <= u))))"""))
    rows = rows.where("_n > 0").withColumn("_copy", F.explode(F.expr("sequence(1, _n)")))
    rows = rows.withColumn("_mix", F.md5(F.concat(F.lit(f"{seed}#"), F.col("_id"), F.lit("#"), F.col("_copy"))))
    rows = rows.select("row", "_copy", "_mix").repartition("_mix").sortWithinPartitions("_mix")
    return rows.select("row.*", F.col("_copy").alias(copy_col), F.col("_mix").alias(key_col))
