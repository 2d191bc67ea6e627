"""Token counts through a cache keyed by digests of content and tokenizer version."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import materialize
from .kernel import chunks, strings

#: Digests (32 bytes each) that are broadcast at most.
FEW = 100_000
CACHE_SCHEMA = "digest binary, version string, n_tokens bigint"


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import BatchBPE

        bpe = BatchBPE.get(path)
        for batch in batches:
            _, offsets = strings(batch.column(1))
            for i, j in chunks(offsets):
                part = batch.slice(i, j - i)
                yield pa.record_batch([part.column(0), pa.array(bpe.count(part.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """Stored counts (digest, n_tokens) of one tokenizer version, each digest once however often it was appended; an absent cache
    is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA).select("digest", "n_tokens")
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Count the ids of every whole text, encoding each distinct text that the cache lacks once.

    The content digest is SHA-256 of the text's UTF-8 bytes (null counts as empty; nothing else is normalised, as any
    change could change the count); the version digest covers the tokenizer's file.  New counts are appended to the
    Parquet table at ``cache_path``, so a job that starts anew encodes only what is missing; what two writers, or a retry, append
    twice counts once.

    What is missing is told by digests alone.  Up to ``FEW`` missing ones pick their texts where these lie, so a warm cache
    moves no others; with more, copies are collapsed in the map stage, before texts are shuffled.  Repeated rows and null ids keep their own result
    row each; other columns are ignored; an empty table gives an empty result and leaves the cache alone.

    Returns id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).
    """
    from .bpe import version_digest

    spark = docs.sparkSession
    version = version_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256)))
    narrow = materialize(keyed.select("id", "digest", F.octet_length("body").cast("long").alias("n_bytes")), "token-keys")
    missing = materialize(narrow.select("digest").distinct().join(read_cache(spark, cache_path, version), "digest", "left_anti"), "token-misses")
    n = missing.count()
    if n:
        once = lambda rows: rows.groupBy("digest").agg(F.first("body").alias("body"))
        misses = once(keyed.join(F.broadcast(missing), "digest", "left_semi")) if n <= FEW else once(keyed).join(missing, "digest", "left_semi")
        encoded = misses.select("digest", "body").mapInArrow(_encoder(tokenizer_path), "digest binary, n_tokens bigint")
        encoded.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache_path)
    return narrow.join(read_cache(spark, cache_path, version), "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
