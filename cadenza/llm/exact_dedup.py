"""Exact deduplication by a stateful stream, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import materialize, scratch

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Space reserved in advance, for each partition, would outweigh the state of small ones.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def _digest(text_col: str, bits: int):
    whole = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    return whole if bits >= 256 else F.substring(whole, 1, bits // 4)


def update_state(spark: SparkSession, path: str, checkpoint: str, out: str, *, id_col: str = "doc_id", text_col: str = "text", bytes_per_batch: int = 64 << 30, digest_bits: int = 256) -> None:
    """Run the stream over whatever Parquet files at ``path`` it has not read yet, then stop.

    State, kept on disk by key and never expired: digest -> stable identifier of the row that stays (the largest id), its
    content locator (file and row in it) and the number of rows.  A digest's entry is written to ``out`` whenever it
    changes; as identifiers and counts only grow, the last entry of a digest is its maximum, and a batch that is run
    again after a failure rewrites its own folder.
    """
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        # As a pattern, the path may be a file as well as a folder.
        source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")
        # Ids of null sort below all others: -2**63 stands for null in the state.
        entry = F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        state = source.select(_digest(text_col, digest_bits).alias("digest"), entry.alias("entry")).groupBy("digest").agg(F.max("entry").alias("entry"), F.count("*").alias("group_size"))

        def write(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

        query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def stream_dedup(spark: SparkSession, path: str, *, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None, digest_bits: int = 256) -> DataFrame:
    """For each row of the Parquet table at ``path``: which row of its equal texts stays (the largest id).

    The stream (``update_state``) decides by SHA-256 digest; then every hit, a row that is not the one its digest's
    locator names, is compared with that row's full bytes.  Rows of a digest under which texts differ are grouped by
    the text itself.  ``digest_bits`` shortens the digest so that tests meet such cases.

    Null texts count as empty.  Repeated ids are counted as rows of their own; of equal ids the later file and row stays.  A null
    id takes part, stays only if all are null, and is returned as null.  Other columns are ignored; an empty table gives
    an empty result.  Returns id, keep_id, group_size, kept, text_sha256.

    ``state_dir`` keeps the state between calls, so that later calls read new files only; unset, a new state is made.
    """
    home = state_dir or scratch(spark, "dedup-state")
    update_state(spark, path, f"{home}/checkpoint", f"{home}/entries", id_col=id_col, text_col=text_col, digest_bits=digest_bits)
    schema = "digest string, entry struct<id:bigint,file:string,row:bigint>, group_size bigint"
    known = spark.read.schema(f"{schema}, batch int").option("basePath", f"{home}/entries").parquet(f"{home}/entries").groupBy("digest").agg(F.max("entry").alias("keep"), F.max("group_size").alias("group_size"))
    known = materialize(known, "dedup-known")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = spark.read.parquet(path).select(F.col(id_col).cast("long").alias("id"), text.alias("body"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), _digest(text_col, digest_bits).alias("digest"))
    several = known.filter("group_size > 1").select("digest", "keep")
    # Only rows of digests met more than once are compared; their texts move once.
    hits = materialize(rows.join(several, "digest"), "dedup-hits")
    stays = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    kept_text = hits.filter(stays).select("digest", F.col("body").alias("kept_body"))
    wrong = hits.filter(~stays).join(kept_text, "digest").filter(F.col("body") != F.col("kept_body")).select("digest").distinct()
    wrong = materialize(wrong, "dedup-collisions")
    sha = F.sha2(F.col("body"), 256)
    null = F.lit(-(2**63))
    real = lambda c: F.when(c != null, c)
    plain = rows.select("id", "file", "row", "digest", (sha if digest_bits < 256 else F.col("digest")).alias("text_sha256")).join(known, "digest")
    if wrong.isEmpty():
        return plain.select(F.col("id").alias(id_col), real(F.col("keep.id")).alias("keep_id"), "group_size", stays.alias("kept"), "text_sha256")
    mixed = hits.join(wrong, "digest", "left_semi")
    mine = F.struct(F.coalesce(F.col("id"), null).alias("id"), "file", "row")
    by_text = mixed.groupBy("digest", "body").agg(F.max(mine).alias("best"), F.count("*").alias("size"))
    settled = mixed.join(by_text, ["digest", "body"]).select(F.col("id").alias(id_col), real(F.col("best.id")).alias("keep_id"), F.col("size").alias("group_size"), ((F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))).alias("kept"), sha.alias("text_sha256"))
    return plain.join(wrong, "digest", "left_anti").select(F.col("id").alias(id_col), real(F.col("keep.id")).alias("keep_id"), "group_size", stays.alias("kept"), "text_sha256").unionByName(settled)
