"""Token counts with a digest cache.

A text is known by the SHA-256 of its normalised content, a tokenizer by the SHA-256 of its file,
the library's name and version. Stored counts are joined on both digests; only distinct texts that
the cache lacks are encoded, once each, and appended to it.

Normalised content is content that gives the same ids: a null text is empty; nothing else changes
unless ``normalise`` says so (``sentencepiece_content`` is the one for that library, which writes
the space as U+2581 itself).
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitio.llm.common import stored
from transitio.operators.skew import balanced_join
from transitio.session import ensure_checkpoint_dir

CACHE_SCHEMA = "version string, digest binary, n_tokens long"
#: Largest tokenizer file that is sent to executors.
MAX_MODEL_BYTES = 64 << 20
#: Up to this many missing digests (32 bytes each) are broadcast, so that texts of hits stay where they are.
FEW_MISSES = 100_000


def sentencepiece_content(text: Column) -> Column:
    """Content up to what sentencepiece itself makes equal: U+2581 is its sign for a space."""
    return F.replace(text, F.lit("▁"), F.lit(" "))


def model_version(path: str) -> str:
    """Digest of the tokenizer file, its library and the library's version."""
    library = _library(path)
    body = hashlib.sha256(_model_bytes(path)).hexdigest()
    return hashlib.sha256(f"{library}:{importlib.metadata.version(library)}:{body}".encode()).hexdigest()


def _library(path: str) -> str:
    kind = os.path.splitext(path)[1]
    if kind not in (".model", ".json"):
        raise ValueError(f"no library for tokenizer file {path!r}")
    return "sentencepiece" if kind == ".model" else "tokenizers"


def _model_bytes(path: str) -> bytes:
    if os.path.getsize(path) > MAX_MODEL_BYTES:
        raise ValueError(f"tokenizer file {path!r} is larger than {MAX_MODEL_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def _counter(library: str, body: bytes) -> Callable[[str], int]:
    """Number of ids the library gives a text: no added tokens, no truncation, no padding."""
    if library == "sentencepiece":
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=body)
        return lambda text: len(sp.encode(text, add_bos=False, add_eos=False))
    from tokenizers import Tokenizer
    tok = Tokenizer.from_str(body.decode("utf-8"))
    tok.no_truncation()
    tok.no_padding()
    return lambda text: len(tok.encode(text, add_special_tokens=False).ids)


def _encode(path: str, spark: SparkSession) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    library, body = _library(path), spark.sparkContext.broadcast(_model_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or _counter(library, body.value)
            # one text at a time: the ids of a batch are never held together
            n = [count(batch.column(1)[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])
    return run


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; an absent folder is an empty cache."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def _known(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """One row per digest: runs that missed the same text at the same time both appended its count."""
    return read_cache(spark, cache).where(F.col("version") == version) \
        .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(texts: DataFrame, keys: DataFrame, cache: str, model: str) -> int:
    """Append the counts of all ``texts`` (digest, text) that the cache lacks; returns how many.

    ``keys`` has the distinct digests of ``texts``. A job that breaks off leaves whole rows only,
    which are valid counts: the next run misses less.
    """
    spark = texts.sparkSession
    version = model_version(model)
    missing = stored(keys.select("digest").join(_known(spark, cache, version), "digest", "left_anti"), "token-misses")
    n = missing.count()
    if not n:
        return 0
    if n <= FEW_MISSES:
        # at most FEW_MISSES digests: texts that the cache has are not shuffled
        texts = texts.join(F.broadcast(missing), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    else:
        # copies are combined before the shuffle, so a group of copies is one text per task
        texts = texts.groupBy("digest").agg(F.first("text").alias("text")).join(missing, "digest", "left_semi")
    texts.select("digest", "text").mapInArrow(_encode(model, spark), "digest binary, n_tokens long") \
        .select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    return n


def count_tokens(docs: DataFrame, model: str, cache: str | None = None, limit: int = 4096,
                 normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every row of ``docs`` (doc_id, text).

    ``model`` is a tokenizer file: .model (sentencepiece) or .json (tokenizers). ``cache`` is a
    Parquet folder that all executors reach; by default a new one in the checkpoint folder.
    ``normalise`` maps texts to content of equal ids; by default that of the file's library.

    A null text is empty. Empty texts have 0 bytes and the count the library gives them. Long
    texts are encoded whole, one at a time. Rows are kept as they are: repeated rows and repeated
    ids (also null) give one row each, equal texts are encoded once. Other columns of ``docs``,
    whatever their names, are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    if cache is None:
        cache = f"{ensure_checkpoint_dir(spark)}/token-cache-{uuid.uuid4().hex[:12]}"
    if normalise is None:
        normalise = sentencepiece_content if _library(model) == "sentencepiece" else (lambda text: text)
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), normalise(text).alias("text")) \
        .withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = stored(texts.select("doc_id", "n_bytes", "digest"), "token-rows")
    keys = stored(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "token-keys")
    fill_cache(texts.select("digest", "text"), keys, cache, model)
    counts = _known(spark, cache, model_version(model)).join(keys.select("digest"), "digest", "left_semi")
    return balanced_join(rows, counts, ["digest"], F.struct("doc_id"), "left", counts=keys) \
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
