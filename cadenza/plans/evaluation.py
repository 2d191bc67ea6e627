"""Queries on paired conditions, buckets and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, paired
from ..sources import sinks
from ..workspace import table
from . import views
from .catalog import query

# Line items as predictions: the return flag is the condition, quantities are reference lengths.
_PRED = """pred AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'B0_MIXTURE' WHEN 'N' THEN 'ORACLE_TARGET' ELSE 'B1_P2_TARGET' END AS condition, CASE WHEN l_linenumber % 3 = 0 THEN 'SINGLE' ELSE 'mix' END AS scene,
  CASE WHEN l_linenumber % 3 = 0 THEN 0.0 WHEN l_linenumber % 3 = 1 THEN 1.0 ELSE 0.5 END AS overlap, CASE WHEN l_suppkey % 2 = 0 THEN -5.0 ELSE 2.5 END AS sir, CAST(l_quantity AS BIGINT) AS n, CAST(floor(l_quantity * l_discount) AS BIGINT) AS err FROM lineitem),
lab AS (SELECT condition, n, err, unnest(list_distinct(list_filter(['OVERALL', 'scene:' || upper(scene), CASE WHEN scene = 'SINGLE' THEN 'SINGLE' ELSE 'OVERLAP' END, CASE WHEN overlap >= 0.999 THEN 'OVERLAP_100' END, CASE WHEN overlap >= 0.999 AND sir = -5 THEN 'OVERLAP_100_SIR_-5DB' END,
  CASE WHEN sir = -5 THEN 'sir_db:-5' ELSE 'sir_db:2.5' END], lambda x: x IS NOT NULL))) AS bucket FROM pred),
sm AS (SELECT bucket, condition, count(*) AS samples, CAST(sum(err) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS reference_chars, CAST(sum(err) AS DOUBLE) / sum(n) AS cer FROM lab GROUP BY bucket, condition),
cp AS (SELECT bucket, max(cer) FILTER (condition = 'B0_MIXTURE') AS b0, max(cer) FILTER (condition = 'B1_P2_TARGET') AS b1 FROM sm GROUP BY bucket)"""


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "B0_MIXTURE").when(F.col("l_returnflag") == "N", "ORACLE_TARGET").otherwise("B1_P2_TARGET")
    third = F.col("l_linenumber") % 3
    return table(spark, sf, "lineitem").select(
        kind.alias("condition"), F.when(third == 0, "SINGLE").otherwise("mix").alias("scene"), F.when(third == 0, 0.0).when(third == 1, 1.0).otherwise(0.5).alias("overlap"), F.when(F.col("l_suppkey") % 2 == 0, -5.0).otherwise(2.5).alias("sir"), F.lit(None).cast("double").alias("snr"),
        F.col("l_quantity").cast("long").alias("n"), F.floor(F.col("l_quantity") * F.col("l_discount")).cast("long").alias("s"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("i"),
    )


@query("A5 D23 F18", f"WITH {_PRED} SELECT bucket, condition, samples, errors, reference_chars, round(cer, 6) AS cer FROM sm")
def paired_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return paired.summarize_scenes(_predictions(spark, sf)).withColumn("cer", F.round("cer", 6))


@query("A6", f"WITH {_PRED} SELECT bucket, round((b1 - b0) * 100, 5) AS absolute_change_pp, round((b0 - b1) * 100, 5) AS absolute_reduction_pp, round(CASE WHEN b0 <> 0 THEN (b0 - b1) / b0 END, 6) AS relative_reduction FROM cp WHERE b0 IS NOT NULL AND b1 IS NOT NULL")
def paired_comparison(spark: SparkSession, sf: str) -> DataFrame:
    c = paired.compare(paired.summarize_scenes(_predictions(spark, sf)), "B0_MIXTURE", "B1_P2_TARGET")
    return c.select("bucket", F.round("absolute_change_pp", 5).alias("absolute_change_pp"), F.round("absolute_reduction_pp", 5).alias("absolute_reduction_pp"), F.round("relative_reduction", 6).alias("relative_reduction"))


@query("D21 A17", f"""WITH {_PRED}, k AS (SELECT max((b0 - b1) * 100) FILTER (bucket = 'OVERLAP_100') AS pp, max((b0 - b1) / b0) FILTER (bucket = 'OVERLAP_100') AS rel, max((b1 - b0) * 100) FILTER (bucket = 'SINGLE') AS single, max((b0 - b1) * 100) FILTER (bucket = 'OVERLAP_100_SIR_-5DB') AS ext FROM cp)
SELECT pp >= 5 OR rel >= 0.15 AS high_overlap_gain, single <= 2 AS single_degradation_le_2pp, ext >= 0 AS extreme_direction_not_reversed,
CASE WHEN pp IS NULL OR single IS NULL OR ext IS NULL THEN 'INCONCLUSIVE_MISSING_REQUIRED_EVIDENCE' WHEN (pp >= 5 OR rel >= 0.15) AND single <= 2 AND ext >= 0 THEN 'PASS_SINGLE_RUN_THRESHOLDS' ELSE 'FAIL_SINGLE_RUN_THRESHOLDS' END AS verdict FROM k""")
def acceptance_verdict(spark: SparkSession, sf: str) -> DataFrame:
    facts = spark.range(1).selectExpr("true AS result_valid", "0 AS asr_errors", "10 AS quality_samples", "0 AS near_silent", "10 AS expected")
    c = paired.compare(paired.summarize_scenes(_predictions(spark, sf)), "B0_MIXTURE", "B1_P2_TARGET")
    return paired.acceptance(c, facts).select("high_overlap_gain", "single_degradation_le_2pp", "extreme_direction_not_reversed", "verdict")


@query("A19", """WITH r AS (SELECT o_orderkey % 3 AS seed, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS share FROM orders GROUP BY o_orderkey % 3)
SELECT count(*) FILTER (share > 0.3) AS passed_runs, coalesce(bool_or(share > 0.3) FILTER (seed = 1), false) AS frozen_passed, CASE WHEN count(*) FILTER (share > 0.3) >= 2 AND coalesce(bool_or(share > 0.3) FILTER (seed = 1), false) THEN 'ACCEPT_B1_CANDIDATE' ELSE 'REJECT_B1_CANDIDATE' END AS verdict FROM r""")
def seed_vote(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 3).alias("seed")).agg((F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)) > 0.3).alias("passed")).withColumn("manifest", F.lit("m"))
    return paired.seed_vote(runs, frozen=1)


_BUCKETS = [("en", 0), ("de", 1), ("fr", 2), ("es", 3), ("other", 4)]


@query("A4 O7", f"""WITH b AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{k}')" for k, i in _BUCKETS)}) t(ord, bucket)), d AS (SELECT lang AS bucket, count(*) AS n, avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END) AS a, avg(CAST(n_chars % 100 AS DOUBLE) / 100) AS c FROM documents GROUP BY lang)
SELECT ord, b.bucket, coalesce(n, 0) AS n, round(coalesce(a, 0), 6) AS accept_rate, round(c, 6) AS mean_cer FROM b LEFT JOIN d ON d.bucket = b.bucket""")
def bucket_report(spark: SparkSession, sf: str) -> DataFrame:
    fixed = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("bucket")) for k, i in _BUCKETS])).alias("b")).select("b.*")
    out = metrics.bucket_report(table(spark, sf, "documents"), fixed, "lang", F.col("n_chars") > 1000, F.col("n_chars") % 100 / 100)
    return out.select("ord", "bucket", "n", F.round("accept_rate", 6).alias("accept_rate"), F.round("mean_cer", 6).alias("mean_cer"))


@query("A11", "SELECT event_type, count(*) AS samples, count(*) FILTER (value < 1) AS near_silent_samples, round(count(*) FILTER (value < 1) / count(*), 6) AS near_silent_rate, min(value) AS rms_ratio_min, round(median(value), 6) AS rms_ratio_median, max(value) AS rms_ratio_max FROM events GROUP BY event_type")
def quality_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.quality_summary(table(spark, sf, "events"), ["event_type"], "value", F.col("value") < 1)
    return out.withColumns({c: F.round(c, 6) for c in ("near_silent_rate", "rms_ratio_median")})


@query("A18", "SELECT event_type, term, count(*) AS n FROM (SELECT event_type, unnest(list_filter([CASE WHEN value > 100 THEN 'high' END, CASE WHEN event_id % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)) AS term FROM events) GROUP BY event_type, term")
def term_counts(spark: SparkSession, sf: str) -> DataFrame:
    terms = F.array_compact(F.array(F.when(F.col("value") > 100, "high"), F.when(F.col("event_id") % 2 == 0, "even")))
    return metrics.terms_counted(table(spark, sf, "events").withColumn("t", terms), ["event_type"], "t")


@query("K6")
def submission_document(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON document; its text is checked by a test, as engines print numbers differently."""
    rows = views.pairs(spark, sf).select(F.col("id").alias("ord"), "id", F.lit("").alias("audio"), F.col("hyp").alias("content"), F.lit(1).alias("label"), F.round(F.levenshtein("ref", "hyp") / F.length("ref"), 4).alias("cer"))
    return sinks.submission(rows, F.round(F.avg("cer"), 4), F.lit(0.0), 0.0)
