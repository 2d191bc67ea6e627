"""Queries that write what they derive from the tables to the shared folder, and read it by the engine's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import readings
from ..sources import documents, readers, samples, sinks, slices
from ..sources.samples import store
from ..workspace import scratch, table
from . import views
from .catalog import query


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """A part a line, as JSON; every ninth with a broken line and a blank one after it."""
    row = F.to_json(F.struct("p_partkey", "p_name", "p_size"))
    noise = F.when(F.col("p_partkey") % 9 == 0, F.array(row, F.lit('{"p_partkey": '), F.lit("  "))).otherwise(F.array(row))
    return table(spark, sf, "part").select(F.explode(noise).alias("value"))


@query("S1 K2", "SELECT p_partkey, p_name, p_size FROM part")
def lenient_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "lines")
    sinks.write_once(_lines(spark, sf), path, "text")
    return readers.read_jsonl(spark, path, "p_partkey bigint, p_name string, p_size int")


@query("S2 K1 K3", "SELECT p_partkey, p_name, p_size FROM part")
def strict_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "lines")
    sinks.write_once(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), path)
    return readers.read_jsonl(spark, path, "p_partkey bigint, p_name string, p_size int", strict=True)


@query("S3", "SELECT row_number() OVER (ORDER BY p_partkey) AS line_no, p_name AS value FROM part")
def numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "numbered")
    documents.write_ordered(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_partkey"], "p_name", path)
    return readers.with_line_numbers(spark, path).select("line_no", "value")


@query("S4 S5", "SELECT 'u' || p_partkey AS utterance, replace(p_name, ' ', '') AS text FROM part")
def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "transcripts")
    sinks.write_once(table(spark, sf, "part").select(F.concat(F.lit("u"), F.col("p_partkey"), F.lit(" "), F.col("p_name")).alias("value")), path, "text")
    return readers.read_transcripts(spark, path, strict=True)


@query("S6", "SELECT DISTINCT lower(replace(p_type, ' ', '')) AS phrase FROM part")
def phrase_file(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{scratch(spark, 'phrases')}.jsonl"
    sinks.write_once(table(spark, sf, "part").select(F.lit("").alias("text"), F.col("p_type").alias("phrase")), path)
    return readers.read_phrases(spark, path).select("phrase")


@query("S7 S8 K4", "SELECT DISTINCT 'p_size=' || p_size AS parent FROM part")
def split_folders(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "splits")
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    sinks.write_splits(part, path, "p_size", [], "p_partkey")
    return readers.list_files(spark, path, (".json",)).select("parent").distinct()


@query("K6", f"WITH {views.PAIRS} SELECT CAST(id AS VARCHAR) AS id, hyp AS content, 1 AS label, round(CAST(levenshtein(ref, hyp) AS DOUBLE) / length(ref), 4) AS cer FROM pairs")
def submission_file(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "submission")
    cer = F.round(F.levenshtein("ref", "hyp") / F.length("ref"), 4)
    rows = views.pairs(spark, sf).select(F.col("id").alias("ord"), "id", F.lit("").alias("audio"), F.col("hyp").alias("content"), F.lit(1).alias("label"), cer.alias("cer"))
    documents.write_submission(rows, path, F.round(F.avg("cer"), 4), F.lit(0.0), 0.0)
    item = F.from_json(F.rtrim("value", F.lit(",")), "id string, content string, label int, cer double")
    return spark.read.text(path).filter(F.col("value").startswith('{"id"')).select(item.alias("x")).select("x.*")


@query("K5", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type")
def partial_report(spark: SparkSession, sf: str) -> DataFrame:
    """Events in files of a hash each, two files an epoch; the report adds up epochs."""
    home = scratch(spark, "report")
    events = table(spark, sf, "events").select("event_id", "event_type")
    events.repartition(6, F.xxhash64("event_id")).write.parquet(f"{home}/in")
    sums = {"n": F.count("*"), "ids": F.sum("event_id")}
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{home}/in")
    write = documents.partial_reports(stream, ["event_type"], sums, f"{home}/out")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{home}/check").trigger(availableNow=True).start().awaitTermination()
    return documents.report_so_far(spark, f"{home}/out", ["event_type"], sums)


@query("S17", """WITH s AS (SELECT user_id % 8 AS k, CAST(floor(value) AS INTEGER) % 1000 AS x, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS r FROM events),
c AS (SELECT k, r // 25 AS seq, count(*) AS n, sum(x) AS total FROM s GROUP BY k, r // 25) SELECT 's' || k AS session, seq, CAST(total AS BIGINT) AS total FROM c WHERE n = 25""")
def sample_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Event values of eight sessions, as raw samples in files of any length, re-blocked by the streaming source."""
    home = scratch(spark, "captures")

    def save(key, group):
        import pyarrow as pa

        where, root = store(home)
        folder = f"{root}/in/s{key[0].as_py()}"
        where.create_dir(folder, recursive=True)
        rows = group.sort_by("event_id")
        name = f"{rows.column('event_id')[0].as_py():020d}"
        with where.open_output_stream(f"{folder}/_{name}") as f:  # hidden until it is whole
            f.write(rows.column("x").to_numpy().astype("<i2").tobytes())
        where.move(f"{folder}/_{name}", f"{folder}/{name}")
        return pa.table({"done": pa.array([len(rows)], pa.int64())})

    events = table(spark, sf, "events").select((F.col("user_id") % 8).alias("k"), F.floor(F.col("event_id") / 1000).cast("long").alias("file"), "event_id", (F.floor("value").cast("int") % 1000).alias("x"))
    events.groupBy("k", "file").applyInArrow(save, "done long").agg(F.sum("done")).collect()
    samples.register(spark)
    stream = spark.readStream.format("sample_chunks").option("chunk", 25).option("sampleType", "int16").load(f"{home}/in")
    total = F.round(F.aggregate(F.transform("samples", lambda x: x.cast("double") * 32768), F.lit(0.0), lambda a, x: a + x)).cast("long")
    found = stream.select("session", "seq", total.alias("total"))
    found.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{home}/out")


@query("S10 S11", """WITH v AS (SELECT label, vec_id // 64 AS file, vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings), r AS (SELECT label, file, x, row_number() OVER (PARTITION BY label, file ORDER BY vec_id, i) - 1 AS n FROM v)
SELECT label, file, n // 100 * 100 AS first, count(*) AS n, CAST(min(x) AS DOUBLE) AS least, CAST(max(x) AS DOUBLE) AS most FROM r GROUP BY label, file, n // 100""")
def sliced_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors in ``.npy`` files of up to 64 ids of a label, read back in slices of 100 values by tasks of a kilobyte."""
    home = scratch(spark, "arrays")

    def save(key, group):
        import io

        import numpy as np
        import pyarrow as pa

        where, root = store(home)
        where.create_dir(root, recursive=True)
        whole = io.BytesIO()
        np.save(whole, group.sort_by("vec_id").column("embedding").combine_chunks().flatten().to_numpy().astype(np.float32))
        with where.open_output_stream(f"{root}/{key[0].as_py()}-{key[1].as_py()}.npy") as f:
            f.write(whole.getvalue())
        return pa.table({"done": pa.array([len(group)], pa.int64())})

    vectors = table(spark, sf, "embeddings").select("label", F.floor(F.col("vec_id") / 64).cast("long").alias("file"), "vec_id", "embedding")
    vectors.groupBy("label", "file").applyInArrow(save, "done long").agg(F.sum("done")).collect()
    name = F.regexp_extract("path", r"([0-9]+)-([0-9]+)\.npy$", 1).cast("long"), F.regexp_extract("path", r"([0-9]+)-([0-9]+)\.npy$", 2).cast("long")
    found = slices.read_slices(spark, home, bytesPerTask=1024, slice=100)
    # Tasks cut rows at the ends of their ranges; they are put together again by hundreds.
    values = found.select(name[0].alias("label"), name[1].alias("file"), "first", F.posexplode("values").alias("i", "x")).withColumn("first", F.floor((F.col("first") + F.col("i")) / 100) * 100)
    return values.groupBy("label", "file", "first").agg(F.count("*").alias("n"), F.min("x").cast("double").alias("least"), F.max("x").cast("double").alias("most"))


@query("F9", """WITH RECURSIVE w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS phrase FROM part), dict AS (SELECT phrase, upper(phrase[1]) || length(phrase) AS reading FROM w WHERE phrase[1] <> 'm' AND phrase <> ''
  UNION SELECT DISTINCT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 3), 'P' || length(split_part(p_name, ' ', 2)) FROM part WHERE p_partkey % 10 = 0 AND length(split_part(p_name, ' ', 3)) > 0),
known AS (SELECT phrase, min(reading) AS reading FROM dict GROUP BY phrase), t AS (SELECT DISTINCT p_name AS text FROM part),
cand AS (SELECT text, i, arg_max(phrase, length(phrase)) AS phrase FROM (SELECT text, unnest(range(1, length(text) + 1)) AS i FROM t) p JOIN known ON starts_with(substr(text, i), phrase) GROUP BY text, i),
step AS (SELECT p.text, p.i, p.i + coalesce(length(c.phrase), 1) AS next, coalesce(k.reading, p.text[p.i]) AS out FROM (SELECT text, unnest(range(1, length(text) + 1)) AS i FROM t) p LEFT JOIN cand c ON c.text = p.text AND c.i = p.i LEFT JOIN known k ON k.phrase = c.phrase),
walk AS (SELECT text, 1 AS i, CAST('' AS VARCHAR) AS reading FROM t UNION ALL SELECT w.text, s.next, w.reading || s.out FROM walk w JOIN step s ON s.text = w.text AND s.i = w.i)
SELECT text, reading FROM walk WHERE i > length(text)""")
def phrase_readings(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("phrase")).filter("phrase <> '' AND substring(phrase, 1, 1) <> 'm'")
    single = words.select("phrase", F.concat(F.upper(F.substring("phrase", 1, 1)), F.length("phrase")).alias("reading"))
    second, third = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (2, 3))
    double = part.filter((F.col("p_partkey") % 10 == 0) & (F.length(third) > 0)).select(F.concat_ws(" ", second, third).alias("phrase"), F.concat(F.lit("P"), F.length(second)).alias("reading"))
    return readings.read_out(part, "p_name", single.unionByName(double)).select("text", F.array_join("readings", "").alias("reading"))
