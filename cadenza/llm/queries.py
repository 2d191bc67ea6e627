"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import scratch, table
from . import mixing, periods, phrases

BPE = "byte_bpe_50k.json"
SHARDS = [f"shard-{i:03d}" for i in range(128)]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import predict_languages

    return predict_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hpylm import score_texts

    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call has a cache of its own, so that its figures are those of a cold cache."""
    from .token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(BPE), scratch(spark, "token-cache"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, num=85, den=100)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import stream_dedup

    return stream_dedup(spark, f"{sf_dir}/documents.parquet")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(BPE))


def op8_subword_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four segmentations of each turn of ``conversations``, with a digest of the ids and whether they decode to the text."""
    from .subword import summarise_segmentations

    model = public_tokenizers.path("piece_bpe_32k.model")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return summarise_segmentations(turns, model, 4, key_cols=["conv_id", "turn"])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines dropped, and the digest of the text that stays."""
    from .line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "lines_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .knn import voronoi_top_k

    return voronoi_top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_lm_scoring, op3_token_counts, op4_sharding, op5_minhash_near_dedup, op6_exact_dedup, op7_best_fit_packing, op8_subword_sampling, op9_line_dedup, op10_top_k_search, mixing.op11_source_mixing, periods.op12_periodic_runs, phrases.op13_phrase_mining)}

ORACLES: dict[str, str] = {
    "op11_source_mixing": mixing.SQL,
    "op13_phrase_mining": phrases.SQL,
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op10_top_k_search": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
          FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                 CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
          FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 20""",
}
