"""Corpus pipeline: documents pass through the stages in order, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from transitio.llm import bagminhash, length_buckets, poisson_mix, secret_owners, toxic_crf
from transitio.llm.common import table
from transitio.session import ensure_checkpoint_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the span tagger predicts toxic go (operator 8)."""
    return toxic_crf.reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id (operator 1)."""
    return bagminhash.keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values of live, owner-specific credentials are masked in the texts; all documents stay (operator 7)."""
    return secret_owners.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: documents repeat as often as drawn (operator 10)."""
    extra = [f"_mix_{k}" for k in ("copy", "key")]
    while set(extra) & set(docs.columns):
        extra = [f"_{name}" for name in extra]
    return poisson_mix.mix_sources(docs, copy_col=extra[0], key_col=extra[1]).select(*[f"`{c}`" for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batches: one row per piece with its bucket, batch and slot (operator 4)."""
    return length_buckets.pack(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing),
          ("packing", packing)]

#: The toxicity stage is a trained model, which SQL can't express; tests/llm holds every stage
#: against plain Python on a small fixture.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results of the stages go to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
