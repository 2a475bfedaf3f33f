"""Registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitio.llm import (bagminhash, bloom_langid, conv_trie, cross_entropy, filter_audit, histogram_topk, int8_pairs, length_buckets,
                           link_trust, poisson_mix, secret_owners, token_cache, toxic_crf)
from transitio.llm.common import table

#: Where op12's tokenizer file lies.
TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def op1_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the near-duplicate class), kept."""
    rows = bagminhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op2_int8_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    return int8_pairs.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ce_target, ce_background, score; the target are the texts of good quality."""
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return cross_entropy.score_documents(table(spark, sf_dir, "documents"), good)


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, n_tokens, bucket, padded_len, batch, slot."""
    return length_buckets.pack(table(spark, sf_dir, "documents"))


def op5_bloom_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return bloom_langid.predict(table(spark, sf_dir, "documents"))


def op6_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict; trust and distrust of the host."""
    return link_trust.filter_urls(table(spark, sf_dir, "pages"))


def op7_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest of the contract, all spans, live and example credentials per document."""
    return secret_owners.scan(table(spark, sf_dir, "documents")).drop("tk", "found")


def op8_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted; spans as start:end of the toxic words."""
    rows = toxic_crf.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.withColumn("spans", F.expr("array_join(transform(spans, s -> concat(s[0], ':', s[1])), ',')"))


def op9_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the queries are the rows whose vec_id is divisible by 100."""
    return histogram_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus: all columns of documents, copy, mix_key."""
    return poisson_mix.mix_sources(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_cache(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; the cache is new, so that a run counts all it says."""
    return token_cache.count_tokens(table(spark, sf_dir, "documents"), tokenizer, limit=4096)


def op13_conv_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return conv_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bagminhash": op1_bagminhash,
    "op2_int8_pairs": op2_int8_pairs,
    "op3_cross_entropy": op3_cross_entropy,
    "op4_length_buckets": op4_length_buckets,
    "op5_bloom_langid": op5_bloom_langid,
    "op6_link_trust": op6_link_trust,
    "op7_secret_owners": op7_secret_owners,
    "op8_toxic_crf": op8_toxic_crf,
    "op9_histogram_topk": op9_histogram_topk,
    "op10_poisson_mix": op10_poisson_mix,
    "op11_filter_audit": op11_filter_audit,
    "op12_token_cache": op12_token_cache,
    "op13_conv_trie": op13_conv_trie,
}
