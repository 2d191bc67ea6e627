"""Readers: JSON lines, transcripts, phrase banks, file listings, audio and array files, configurations."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.text import normalize, stem
from ..operators.relational import required


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, *, strict: bool = False) -> DataFrame:
    """One object a line; blank lines are skipped.  Strict: a line that is no object fails the job and its text is in the
    error; lenient: such lines are dropped.  A byte order mark is tolerated."""
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "^﻿", "")).filter(F.trim("value") != "")
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = F.from_json("value", StructType([*kind.fields]).add("_bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.withColumn("r", parsed)
    ok = F.col("r").isNotNull() & F.col("r._bad").isNull() & F.ltrim("value").startswith("{")
    if not strict:
        return rows.filter(ok).select("r.*").drop("_bad")
    told = F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 200))
    return rows.filter(required(ok, told)).select("r.*").drop("_bad")


def with_line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no from 1 in each file, value) of text files, for error reports.

    Splits of a file are told by where they begin; a line's number is its place in the split plus the lines of the splits
    before, so files are read twice, and only counts meet."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), "value", F.monotonically_increasing_id().alias("_m"))
    splits = lines.groupBy("path", "_at").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("path", "_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return lines.join(starts, ["path", "_at"]).select("path", (F.col("_before") + F.col("_m") - F.col("_first") + 1).alias("line_no"), "value")


def read_transcripts(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """(utterance, text): ``utt rest of the line`` with white space removed, or ``path.wav,text`` for CSV.

    Strict: two parts, a text that isn't empty, no repeated key; else the last of a key stays."""
    lines = with_line_numbers(spark, path).filter(F.trim("value") != "").select("value", F.struct("path", "line_no").alias("at"))
    if path.endswith(".csv"):
        parts = lines.select(F.split("value", ",", 2).alias("s"), "at").filter(F.trim(F.get("s", F.lit(0))).endswith(".wav"))
        pairs = parts.select(stem(F.trim(F.get("s", F.lit(0)))).alias("utterance"), F.regexp_replace(F.coalesce(F.get("s", F.lit(1)), F.lit("")), r"(?U)\s", "").alias("text"), "at")
    else:
        parts = lines.select(F.split(F.trim("value"), r"\s+", 2).alias("s"), "at")
        pairs = parts.select(F.get("s", F.lit(0)).alias("utterance"), F.regexp_replace(F.coalesce(F.get("s", F.lit(1)), F.lit("")), r"(?U)\s", "").alias("text"), "at")
    out = pairs.groupBy("utterance").agg(F.max_by("text", "at").alias("text"), F.count("*").alias("n"))
    if not strict:
        return out.select("utterance", "text")
    told = F.concat(F.lit("repeated or empty transcript: "), F.col("utterance"))
    return out.filter(required((F.col("n") == 1) & (F.col("text") != ""), told)).select("utterance", "text")


def read_phrases(spark: SparkSession, path: str, field_names: tuple[str, ...] = ("text", "phrase", "command", "label", "content")) -> DataFrame:
    """(ord, phrase): normalised, not empty, in order of first appearance.  JSON lines: the first field that isn't empty;
    JSON: a list, or an object's list under phrases, commands or labels; otherwise a phrase a line."""
    if path.endswith(".jsonl"):
        schema = ", ".join(f"{f} string" for f in field_names)
        raw = read_jsonl(spark, path, schema).select(F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in field_names]).alias("t"))
    elif path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True)
        listed = F.coalesce(F.from_json("value", "array<string>"), *[F.from_json(F.get_json_object("value", f"$.{k}"), "array<string>") for k in ("phrases", "commands", "labels")])
        raw = whole.select(F.explode(listed).alias("t"))
    else:
        raw = spark.read.text(path).select(F.col("value").alias("t"))
    rows = raw.withColumn("ord", F.monotonically_increasing_id()).withColumn("phrase", normalize(F.trim("t")))
    return rows.filter(F.coalesce("phrase", F.lit("")) != "").groupBy("phrase").agg(F.min("ord").alias("ord")).select("ord", "phrase")


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cache of earlier results as Parquet, read by the names and types asked for; columns it lacks are null."""
    return spark.read.schema(schema).parquet(path)


def list_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".wav",), *, speaker: str = r"(S\d{4})", keep: Column | None = None) -> DataFrame:
    """(path, speaker, parent, bytes) of files below ``path``; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    wanted = F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    out = found.filter(wanted if keep is None else wanted & keep)
    return out.select("path", F.regexp_extract("path", speaker, 1).alias("speaker"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("parent"), "bytes")


def resolve_paths(rows: DataFrame, path_col: str, roots: list[str], listing: DataFrame, suffix: str = ".wav") -> DataFrame:
    """Add ``resolved``: the first existing of the path itself, then below each root, with and without the suffix."""
    p = F.col(path_col)
    tries = [p, *(F.concat(F.lit(r.rstrip("/") + "/"), p) for r in roots)]
    options = F.array(*[x for t in tries for x in (t, F.concat(t, F.lit(suffix)))])
    wanted = rows.select(path_col).distinct().select(F.col(path_col).alias("_p"), F.posexplode(options).alias("_rank", "_try"))
    found = wanted.join(listing.select(F.col("path").alias("_try")).distinct(), "_try").groupBy("_p").agg(F.min_by("_try", "_rank").alias("resolved"))
    return rows.join(found, rows[path_col] == found["_p"], "left").drop("_p")


def _decode_audio(content: bytes) -> tuple[int, list[float]]:
    import wave

    import numpy as np

    with wave.open(io.BytesIO(content)) as f:
        width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
        raw = np.frombuffer(f.readframes(f.getnframes()), {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    scaled = (raw - 128) / 128 if width == 1 else raw / float(1 << (8 * width - 1))
    return rate, scaled.reshape(-1, channels).mean(1).astype(np.float32).tolist()


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, samples array<float>) of PCM WAV files, channels averaged; one file a row, decoded where it is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [_decode_audio(x) for x in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "rate": [r for r, _ in got], "samples": [s for _, s in got]})

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, "path string, rate int, samples array<float>")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, values array<float>) of .npy files; pickled ones are refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "values": [np.load(io.BytesIO(x), allow_pickle=False).astype(np.float32).ravel().tolist() for x in pdf["content"]]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, values array<float>")


def parse_settings(text: str) -> dict:
    """Two levels of ``name: number`` (a plain subset of YAML), flattened; comments allowed."""
    out: dict = {}
    for line in text.splitlines():
        body = line.split("#", 1)[0].strip()
        if body and ":" in body:
            name, _, value = body.partition(":")
            if value.strip():
                v = value.strip()
                out[name.strip()] = v == "true" if v in ("true", "false") else float(v) if v.replace(".", "", 1).replace("-", "", 1).isdigit() else v
    return out
