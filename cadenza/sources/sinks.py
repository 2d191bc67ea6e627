"""Sinks: refusing and atomic writes, split fan-out, submission documents, ledgers, delivery checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stem
from .documents import listed_digest


def write_once(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Fails if the target exists; files appear when the job commits."""
    df.write.mode("errorifexists").format(fmt).save(path)


def write_splits(df: DataFrame, path: str, split: str, order: list[str], key: str, fmt: str = "json") -> None:
    """One folder for each split, rows sorted by key within files, splits in the given order."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(split))
    df.withColumn("_rank", rank).repartitionByRange("_rank", key).sortWithinPartitions("_rank", key).drop("_rank").write.mode("errorifexists").partitionBy(split).format(fmt).save(path)


def submission(rows: DataFrame, cer: Column, rr: Column, seconds: float) -> DataFrame:
    """One row with the whole document as JSON, results by ord.  Rows: ord, id (null: the audio's stem), audio, content, label,
    cer.  A document is as large as its rows; ``documents.write_submission`` writes one of any size."""
    ident = F.coalesce(F.col("id").cast("string"), stem(F.col("audio")))
    item = F.struct("ord", F.struct(ident.alias("id"), "content", "label", "cer").alias("r"))
    doc = rows.agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"]).alias("results"), cer.alias("avg_cer"), rr.alias("avg_rr"))
    return doc.select(F.to_json(F.struct(F.struct("results", "avg_cer", "avg_rr", F.lit(seconds).alias("duration")).alias("result"))).alias("document"))


def label_free(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.coalesce("content", F.lit("")).alias("content"))


def kaldi_lines(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``utt path`` and ``utt text`` lines."""
    return rows.select(F.concat_ws(" ", "utt", "path").alias("value")), rows.select(F.concat_ws(" ", "utt", "text").alias("value"))


def ledger(files: DataFrame, known: DataFrame | None = None, root: str = "") -> DataFrame:
    """(path, sha256) of a binaryFile frame; digests that ``known`` has are taken over and those files aren't read."""
    name = F.regexp_replace(F.col("path"), f"^{root}/?", "") if root else F.col("path")
    if known is None:
        return files.select(name.alias("path"), F.sha2("content", 256).alias("sha256"))
    fresh = files.withColumn("name", name).join(known.select(F.col("path").alias("name")), "name", "left_anti")
    return known.select("path", "sha256").unionByName(fresh.select(F.col("name").alias("path"), F.sha2("content", 256).alias("sha256")))


def missing_files(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required paths that are absent, or whose digest differs."""
    got = present.select("path", F.col("sha256").alias("_have"))
    return required.join(got, "path", "left").filter(F.col("_have").isNull() | (F.col("sha256") != F.col("_have"))).select("path", F.when(F.col("_have").isNull(), "missing").otherwise("differs").alias("problem"))


def provenance(df: DataFrame, version: str, files: DataFrame) -> DataFrame:
    """(name, value): VERSION, SCHEMA (one line a field) and FROZEN, the digest over a ledger (path, sha256) in path order
    (``documents.listed_digest``, so the ledger may have any length)."""
    line = F.concat_ws("  ", "sha256", "path")
    frozen = listed_digest(files.select("path", line.alias("line")), ["path"], "line").select(F.lit("FROZEN").alias("name"), "value")
    schema = "\n".join(f"{f.name}: {f.dataType.simpleString()}{'' if f.nullable else ' not null'}" for f in df.schema.fields)
    told = [F.struct(F.lit(k).alias("name"), F.lit(v).alias("value")) for k, v in (("VERSION", version), ("SCHEMA", schema))]
    return df.sparkSession.range(1).select(F.explode(F.array(*told)).alias("x")).select("x.*").unionByName(frozen)


def write_provenance(notes: DataFrame, path: str) -> None:
    """One folder of text for each name; fails if the target exists."""
    notes.coalesce(1).write.mode("errorifexists").partitionBy("name").text(path)


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A table from a few collected rows."""
    head = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join([*head, *("| " + " | ".join(str(r.get(c, "")) for c in columns) + " |" for r in rows)])
