"""Paired conditions over one manifest: buckets, comparisons, verdicts, replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import general
from .metrics import verdict
from .relational import required

CONDITIONS = ["B0_MIXTURE", "ORACLE_TARGET", "B1_P2_TARGET"]


def bucket_labels(scene: Column, overlap: Column, sir: Column, snr: Column) -> Column:
    """All labels of a row, in order, without repeats."""
    name = F.upper(F.when(F.coalesce(scene, F.lit("")) == "", "UNSPECIFIED").otherwise(scene))
    single = (name == "SINGLE") | F.coalesce(overlap == 0, F.lit(False))
    full = overlap >= 0.999
    labels = F.array(
        F.concat(F.lit("scene:"), name), F.when(single, "SINGLE").otherwise("OVERLAP"), F.when(full, "OVERLAP_100"), F.when(full & (F.abs(sir + 5.0) < 1e-6), "OVERLAP_100_SIR_-5DB"),
        F.when(sir.isNotNull(), F.concat(F.lit("sir_db:"), general(sir))), F.when(snr.isNotNull(), F.concat(F.lit("snr_db:"), general(snr))),
    )
    return F.array_distinct(F.array_compact(labels))


def summarize(predictions: DataFrame) -> DataFrame:
    """(bucket, condition) sums over rows with columns buckets, condition, s, d, i, n; OVERALL beside the labels; labels
    that start with ``seed:`` do not count."""
    labels = F.filter(F.concat(F.array(F.lit("OVERALL")), "buckets"), lambda b: ~b.startswith("seed:"))
    # What is unfolded are the few sets there are, not the rows.
    sets = _counted(predictions.withColumn("labels", labels), ["labels"])
    return _by_bucket(sets)


def summarize_scenes(predictions: DataFrame) -> DataFrame:
    """The same from the columns that labels are made of: scene, overlap, sir, snr.  Rows are counted by these; labels are made
    for the few combinations there are."""
    sets = _counted(predictions, ["scene", "overlap", "sir", "snr"])
    return _by_bucket(sets.withColumn("labels", F.concat(F.array(F.lit("OVERALL")), bucket_labels(F.col("scene"), F.col("overlap"), F.col("sir"), F.col("snr")))))


def _counted(predictions: DataFrame, by: list[str]) -> DataFrame:
    return predictions.groupBy(*by, "condition").agg(F.count("*").alias("samples"), F.sum(F.col("s") + F.col("d") + F.col("i")).alias("errors"), F.sum("n").alias("reference_chars"))


def _by_bucket(sets: DataFrame) -> DataFrame:
    rows = sets.select(F.explode("labels").alias("bucket"), "condition", "samples", "errors", "reference_chars")
    sums = rows.groupBy("bucket", "condition").agg(*[F.sum(c).alias(c) for c in ("samples", "errors", "reference_chars")])
    return sums.withColumn("cer", F.try_divide("errors", "reference_chars"))


def compare(summary: DataFrame, base: str, other: str) -> DataFrame:
    """Changes of ``other`` against ``base`` by bucket, in percentage points and relative to the base (null if that is 0)."""
    wide = summary.groupBy("bucket").agg(*[F.max(F.when(F.col("condition") == c, F.col("cer"))).alias(k) for k, c in (("base_cer", base), ("other_cer", other))])
    both = wide.filter("base_cer IS NOT NULL AND other_cer IS NOT NULL")
    gain = F.col("base_cer") - F.col("other_cer")
    return both.withColumns({"absolute_change_pp": -gain * 100, "absolute_reduction_pp": gain * 100, "relative_reduction": F.try_divide(gain, F.when(F.col("base_cer") != 0, F.col("base_cer")))})


def acceptance(comparison: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: the checks and the verdict.  ``facts``: one row with result_valid, asr_errors, quality_samples (null: no
    quality report), near_silent, expected."""
    value = lambda bucket, col: F.max(F.when(F.col("bucket") == bucket, F.col(col)))
    picked = comparison.agg(
        F.max(F.col("bucket") == "OVERLAP_100").alias("_full"),
        *[value(b, col).alias(f"_{k}_{short}") for k, b in (("full", "OVERLAP_100"), ("any", "OVERLAP"), ("single", "SINGLE"), ("extreme", "OVERLAP_100_SIR_-5DB")) for short, col in (("pp", "absolute_reduction_pp"), ("rel", "relative_reduction"))],
    )
    c = F.col
    use_full = F.coalesce(c("_full"), F.lit(False))
    pp, rel = (F.when(use_full, c(f"_full_{k}")).otherwise(c(f"_any_{k}")) for k in ("pp", "rel"))
    have = c("quality_samples").isNotNull()
    several = F.raise_error(F.lit("more than one row of facts")).cast("boolean")
    one = facts.agg(*[F.max(x).alias(x) for x in facts.columns], F.count("*").alias("_n")).filter(F.when(c("_n") > 1, several).otherwise(c("_n") == 1)).drop("_n")
    row = picked.crossJoin(F.broadcast(one)).select(
        F.coalesce(c("result_valid"), F.lit(False)).alias("result_valid"), (c("asr_errors") == 0).alias("asr_errors_zero"), have.alias("quality_available"), F.coalesce(have & (c("quality_samples") == c("expected")), F.lit(False)).alias("quality_complete"),
        F.when(have, c("near_silent") == 0).alias("near_silent_zero"), F.when(pp.isNotNull(), (pp >= 5.0) | F.coalesce(rel >= 0.15, F.lit(False))).alias("high_overlap_gain"),
        (c("_single_pp") >= -2.0).alias("single_degradation_le_2pp"), (c("_extreme_pp") >= 0.0).alias("extreme_direction_not_reversed"),
    )
    return row.withColumn("verdict", verdict([c(x) for x in row.columns]))


def incomplete(predictions: DataFrame, conditions: list[str]) -> DataFrame:
    """Samples that do not have each condition exactly once."""
    got = predictions.groupBy("sample_id").agg(F.array_sort(F.collect_list("condition")).alias("conditions"))
    return got.filter(F.col("conditions") != F.array(*map(F.lit, sorted(conditions))))


def seed_vote(runs: DataFrame, frozen: int, needed: int = 2) -> DataFrame:
    """One row over the summaries of exactly three runs (seed, passed, manifest): accept if enough passed and the frozen one did.

    Raises for repeated seeds, another number of runs, or differing manifests."""
    vote = runs.agg(F.count("*").alias("runs"), F.count_distinct("seed").alias("seeds"), F.count_distinct("manifest").alias("manifests"), F.count_if("passed").alias("passed_runs"), F.coalesce(F.bool_or(F.when(F.col("seed") == frozen, F.col("passed"))), F.lit(False)).alias("frozen_passed"))
    sound = (F.col("runs") == 3) & (F.col("seeds") == 3) & (F.col("manifests") == 1)
    decision = F.when((F.col("passed_runs") >= needed) & F.col("frozen_passed"), "ACCEPT_B1_CANDIDATE").otherwise("REJECT_B1_CANDIDATE")
    told = F.lit("three runs of distinct seeds over one manifest are needed")
    return vote.filter(required(sound, told)).select("passed_runs", "frozen_passed", decision.alias("verdict"))
