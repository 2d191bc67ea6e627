"""Aggregates of evaluations: corpus ratios, rates, percentiles, signal and activity scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import unit
from .scans import cut, paired, percentiles, scan, totals


def corpus_cer(s: Column, d: Column, i: Column, n: Column) -> list[Column]:
    """Sums and the ratio of sums; raises for no reference characters at all."""
    total = F.sum(n)
    ratio = F.when(total > 0, F.sum(s + d + i) / total).otherwise(F.raise_error(F.lit("no reference characters")).cast("double"))
    return [F.sum(s).alias("substitutions"), F.sum(d).alias("deletions"), F.sum(i).alias("insertions"), total.alias("reference_chars"), ratio.alias("corpus_cer")]


def sentence_cer(errors: Column, n: Column) -> Column:
    """Mean of ratios, each rounded to four places first."""
    return F.coalesce(F.avg(F.bround(errors / n, 4)), F.lit(0.0)).alias("sentence_cer")


def rate(hit: Column) -> Column:
    """Share of rows for which ``hit`` holds (null does not); 0 for no rows."""
    return F.count_if(hit) / F.greatest(F.count("*"), F.lit(1))


def rejected(accepted: Column, text: Column, rule: str, status: Column | None = None) -> Column:
    """The five meanings of a rejection: blank (final text blank), normalized (not accepted or nothing left after
    normalisation, which the caller has done), stripped (not accepted or blank), accepted (not accepted), status."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    if rule == "blank":
        return blank
    if rule in ("normalized", "stripped"):
        return ~accepted | blank
    if rule == "accepted":
        return ~accepted
    if rule == "status":
        return F.when(status == "NOT_EMITTED", True).when(status == "ERROR", False).when(status == "OK", blank).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.coalesce(status, F.lit("null")))).cast("boolean"))
    raise ValueError(rule)


def bucket_report(rows: DataFrame, buckets: DataFrame, bucket: str, accepted: Column, cer: Column) -> DataFrame:
    """Fixed buckets in fixed order (columns ord, bucket; small), with zeros for those without rows."""
    got = rows.groupBy(F.col(bucket).alias("bucket")).agg(F.count("*").alias("n"), rate(accepted).alias("accept_rate"), F.avg(cer).alias("mean_cer"))
    return F.broadcast(buckets).join(got, "bucket", "left").select("ord", "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("accept_rate", F.lit(0.0)).alias("accept_rate"), "mean_cer")


def profile(x: str) -> list[Column]:
    """For keys of few rows each: medians and quartiles hold a key's distinct values; see ``profiled``."""
    return [F.count(x).alias("n"), F.min(x).alias("least"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.percentile(x, F.lit(0.25)).alias("q1"), F.percentile(x, F.lit(0.75)).alias("q3"), F.max(x).alias("most")]


def profiled(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """The same for keys of any number of rows: exact quartiles by ``scans.percentiles``."""
    plain = df.groupBy(*keys).agg(F.count(x).alias("n"), F.min(x).alias("least"), F.avg(x).alias("mean"), F.max(x).alias("most"))
    return paired(plain, percentiles(df, keys, x, {"median": 0.5, "q1": 0.25, "q3": 0.75}).drop("n"), keys, "left").select(*keys, "n", "least", "mean", "median", "q1", "q3", "most")


def duration_weighted_median(df: DataFrame, keys: list[str], score: str, weight: str) -> DataFrame:
    """The first score at which half of all weight is reached; 0 for a key without any.  Weights are summed by score, then along
    ranges of scores, so a key may have any number of rows."""
    by = df.groupBy(*keys, score).agg(F.sum(weight).alias("_w"))
    run = totals(scan(cut(by, keys, [score]), keys, [score], {"_run": ("sum", F.col("_w"))}), keys, {"_total": F.sum("_w")})
    return run.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_run") >= F.col("_total") / 2, F.col(score))), F.lit(0.0)).alias("weighted_median"))


def quality_summary(df: DataFrame, keys: list[str], ratio: str, silent: Column) -> DataFrame:
    plain = df.groupBy(*keys).agg(F.count("*").alias("samples"), F.count_if(silent).alias("near_silent_samples"), rate(silent).alias("near_silent_rate"), F.min(ratio).alias("rms_ratio_min"), F.max(ratio).alias("rms_ratio_max"))
    return paired(plain, percentiles(df, keys, ratio, {"rms_ratio_median": 0.5}).drop("n"), keys, "left")


def corpus_si_sdr(signal: Column, error: Column, eps: float = 1e-8) -> Column:
    return 10 * F.log10(F.sum(signal) / (F.sum(error) + eps) + eps)


def choice_accuracy(right: Column, wrong: Column, tie: float = 1e-6) -> Column:
    """Share of rows that prefer the right one; ties count half."""
    return F.avg(F.when(F.abs(right - wrong) <= tie, 0.5).when(right > wrong, 1.0).otherwise(0.0))


def verdict(checks: list[Column]) -> Column:
    """Three-valued: an open check leaves the verdict open, even beside a failed one."""
    unknown = F.lit(False)
    passed = F.lit(True)
    for c in checks:
        unknown, passed = unknown | c.isNull(), passed & F.coalesce(c, F.lit(False))
    return F.when(unknown, "INCONCLUSIVE_MISSING_REQUIRED_EVIDENCE").when(passed, "PASS_SINGLE_RUN_THRESHOLDS").otherwise("FAIL_SINGLE_RUN_THRESHOLDS")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weights by which both classes carry half of the total; the class counts (two rows) are joined back.  Rows of a null label go."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    return df.join(counts, label).withColumn("weight", 0.5 / F.col("_n")).drop("_n")


def standardized(df: DataFrame, columns: list[str], tiny: float = 1e-8) -> DataFrame:
    """(x - mean) / population deviation, a tiny deviation counting as 1; statistics are one row."""
    stats = df.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    scale = {c: F.when(F.col(f"_s_{c}") < tiny, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns({f"{c}_z": (F.col(c) - F.col(f"_m_{c}")) / scale[c] for c in columns}).drop(*stats.columns)


def imputed(df: DataFrame, columns: list[str], fitted_on: Column) -> DataFrame:
    """Fill nulls with the median of the rows that ``fitted_on`` picks, and flag them."""
    fitted = df.filter(fitted_on)
    # One number a column; null where there is nothing to fit on.
    medians = {c: (percentiles(fitted, [], c, {"m": 0.5}).first() or {"m": None})["m"] for c in columns}
    flagged = df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns})
    return flagged.withColumns({c: F.coalesce(F.col(c), F.lit(m).cast("double")) for c, m in medians.items()})


def weighted_mean(v: Column, w: Column) -> Column:
    return F.coalesce(F.try_divide(F.sum(v * w), F.sum(w)), F.lit(0.0))


def precision_recall(predicted: Column, actual: Column, eps: float = 1e-8) -> list[Column]:
    hit, said, true = F.count_if(predicted & actual), F.count_if(predicted), F.count_if(actual)
    p, r = hit / (said + eps), hit / (true + eps)
    return [p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + eps)).alias("f1")]


def centroids(df: DataFrame, keys: list[str], vector: str, eps: float = 1e-9) -> DataFrame:
    """Mean vector of each key, scaled to length one: averages by component, pre-aggregated before the shuffle."""
    means = df.select(*keys, F.posexplode(vector).alias("_i", "_v")).groupBy(*keys, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    packed = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_a"))
    return packed.select(*keys, unit(F.transform("_a", lambda x: x["_m"]), eps).alias("centroid"))


def terms_counted(df: DataFrame, keys: list[str], terms: str) -> DataFrame:
    return df.select(*keys, F.explode(terms).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))
