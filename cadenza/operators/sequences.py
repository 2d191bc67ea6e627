"""Segments in ordered series: gaps and islands along each series.

Frames are taken as they are, and windows then hold a series each; or cut into ranges (``scans.cut``), and no task holds a series.
Either way the results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scans import PART, cut, is_cut, paired, scan, totals


def _ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def hysteresis(df: DataFrame, keys: list[str], order: list[str], p: str, on: float, off: float) -> DataFrame:
    """Add ``active``: switched on at p >= on, off at p < off (off < on), off to begin with."""
    if not off < on:
        raise ValueError("off must lie below on")
    switch = F.when(F.col(p) >= on, 1).when(F.col(p) < off, 0)
    return scan(df, keys, order, {"active": ("last", switch)}).withColumn("active", F.coalesce("active", F.lit(0)))


def numbered_runs(df: DataFrame, keys: list[str], order: list[str], value: str = "active") -> DataFrame:
    """Add ``run``: the number of the stretch of equal values that a row belongs to."""
    lagged = scan(df, keys, order, {"_was": ("lag", F.struct(F.col(value).alias("v")))})
    change = F.when(F.col("_was").isNotNull() & F.col("_was.v").eqNullSafe(F.col(value)), 0).otherwise(1)
    return scan(lagged.withColumn("_change", change), keys, order, {"run": ("sum", F.col("_change"))}).drop("_change", "_was")


def runs(df: DataFrame, keys: list[str], order: list[str], at: str, value: str = "active", *aggs: Column) -> DataFrame:
    """One row for each stretch: keys, value, start and end (inclusive, by ``at``), length."""
    grouped = numbered_runs(df, keys, order, value).groupBy(*keys, "run", value)
    return grouped.agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("length"), *aggs)


def active_runs(df: DataFrame, keys: list[str], order: list[str], at: str, *aggs: Column) -> DataFrame:
    return runs(df, keys, order, at, "active", *aggs).filter("active = 1").drop("run", "active")


def merge_gaps(segments: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """Join disjoint segments whose start lies within ``limit`` of the inclusive end before it."""
    return _merged(segments, keys, ["start"], "lag", limit)


def merge_overlaps(segments: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """Join segments, overlapping ones too: a start is held against the largest end so far."""
    return _merged(segments, keys, ["start", "end"], "max_before", limit)


def _merged(segments: DataFrame, keys: list[str], order: list[str], kind: str, limit: float) -> DataFrame:
    reached = scan(segments, keys, order, {"_reach": (kind, F.col("end"))})
    fresh = reached.withColumn("_f", F.when(F.col("start") - F.col("_reach") <= limit, 0).otherwise(1))
    island = scan(fresh, keys, order, {"segment": ("sum", F.col("_f"))})
    return island.groupBy(*keys, "segment").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def pad_and_merge(segments: DataFrame, keys: list[str], pad: float, least: float, limit: float) -> DataFrame:
    """Widen by ``pad`` (not below 0), drop what is then shorter than ``least``, merge."""
    wide = segments.withColumns({"start": F.greatest(F.col("start") - pad, F.lit(0)), "end": F.col("end") + pad})
    return merge_overlaps(wide.filter(F.col("end") - F.col("start") >= least), keys, limit)


def drop_short(segments: DataFrame, least_frames: int) -> DataFrame:
    return segments.filter(F.col("end") - F.col("start") + 1 >= least_frames)


def add_guard(segments: DataFrame, before: int, after: int, last: Column | int) -> DataFrame:
    """Widen within [0, last]; guards may overlap and are not merged again."""
    last = last if isinstance(last, Column) else F.lit(last)
    return segments.withColumns({"guarded_start": F.greatest(F.col("start") - before, F.lit(0)), "guarded_end": F.least(F.col("end") + after, last)})


def segment_features(segments: DataFrame, series: DataFrame, keys: list[str], at: str, p: str) -> DataFrame:
    """Mean of p over each core (start to end).  Cores are disjoint: along the series, a row belongs to the last core that
    has begun, if that hasn't ended."""
    rows = series.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.col(p).alias("_p"), F.lit(None).cast(_core(segments)).alias("_core"))
    begun = segments.select(*keys, F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(series.schema[p].dataType).alias("_p"), F.struct("segment", "start", "end").alias("_core"))
    both = rows.unionByName(begun)
    both = cut(both, keys, ["_at", "_kind"]) if is_cut(series) else both
    inside = scan(both, keys, ["_at", "_kind"], {"_core": ("last", F.col("_core"))}).filter((F.col("_kind") == 1) & (F.col("_at") <= F.col("_core.end")))
    return inside.select(*keys, "_core.*", "_p").groupBy(*keys, "segment", "start", "end").agg(F.avg("_p").alias("mean_p"), F.count("*").alias("frames"))


def _core(segments: DataFrame) -> str:
    return "struct<" + ", ".join(f"{c}: {segments.schema[c].dataType.simpleString()}" for c in ("segment", "start", "end")) + ">"


def clean_runs(df: DataFrame, keys: list[str], order: list[str], least_active: int = 3, most_gap: int = 2) -> DataFrame:
    """Switch off active runs shorter than ``least_active``, then fill inactive runs of up to ``most_gap`` that lie between
    active ones."""
    size = {"_n": F.count("*")}
    one = totals(numbered_runs(df, keys, order), [*keys, "run"], size)
    one = one.withColumn("active", F.when((F.col("active") == 1) & (F.col("_n") < least_active), 0).otherwise(F.col("active"))).drop("run", "_n")
    two = totals(totals(numbered_runs(one, keys, order), [*keys, "run"], size), keys, {"_last": F.max("run")})
    inner = (F.col("run") > 1) & (F.col("run") < F.col("_last"))
    return two.withColumn("active", F.when((F.col("active") == 0) & inner & (F.col("_n") <= most_gap), 1).otherwise(F.col("active"))).drop("run", "_n", "_last")


def pooled_activity(df: DataFrame, keys: list[str], order: list[str], mask: str, width: int, stride: int, ratio: float) -> DataFrame:
    """Frames of a mask: the average over ``width`` rows around every ``stride``-th row (zeros beyond the ends), held
    against ``ratio``."""
    before, after = width // 2, width - width // 2 - 1
    if is_cut(df):
        # Sums so far, at the last row of a frame and before its first: two joins by row number, in place of a window across ranges.
        so_far = scan(df.withColumn("_m", F.col(mask).cast("double")), keys, order, {"_row": ("sum", F.lit(1)), "_sum": ("sum", F.col("_m"))})
        so_far = totals(so_far.withColumn("_row", F.col("_row") - 1).select(*keys, PART, "_row", "_sum"), keys, {"_last": F.max("_row")})
        frames = so_far.filter(F.col("_row") % stride == 0).select(*keys, "_row", F.least(F.col("_row") + after, "_last").alias("_to"), (F.col("_row") - before - 1).alias("_from"))
        upto = so_far.select(*keys, F.col("_row").alias("_to"), F.col("_sum").alias("_s1"))
        prior = so_far.select(*keys, F.col("_row").alias("_from"), F.col("_sum").alias("_s0"))
        framed = paired(paired(frames, upto, [*keys, "_to"]), prior, [*keys, "_from"], "left").withColumn("_mean", (F.col("_s1") - F.coalesce("_s0", F.lit(0.0))) / width)
    else:
        w = _ordered(keys, order)
        framed = df.withColumn("_row", F.row_number().over(w) - 1).withColumn("_mean", F.sum(F.col(mask).cast("double")).over(w.rowsBetween(-before, after)) / width)
    return framed.filter(F.col("_row") % stride == 0).select(*keys, (F.col("_row") / stride).cast("long").alias("frame"), (F.col("_mean") > ratio).cast("int").alias("active"))


def round_robin(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """n rows, taken from the groups in turn."""
    ranked = df.withColumn("_turn", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return ranked.filter(F.col("_turn") <= n).orderBy("_turn", group).limit(n).drop("_turn")


def last_record(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def ends_compared(df: DataFrame, keys: list[str], step: str, value: str, n: int) -> DataFrame:
    """Means of the first and the last n steps, and whether the latter is lower."""
    up, down = Window.partitionBy(*keys).orderBy(step), Window.partitionBy(*keys).orderBy(F.desc(step))
    marked = df.withColumns({"_up": F.row_number().over(up), "_down": F.row_number().over(down)}).filter((F.col("_up") <= n) | (F.col("_down") <= n))
    first, last = (F.avg(F.when(F.col(c) <= n, F.col(value))) for c in ("_up", "_down"))
    return marked.groupBy(*keys).agg(first.alias("first_mean"), last.alias("last_mean"), (last < first).alias("decreased"))


def counted_steps(df: DataFrame, keys: list[str], order: list[str], every: dict[str, int], sums: dict[str, str] | None = None) -> DataFrame:
    """``step`` from 1 on, running sums (name: column), and a flag for each trigger (name: period) at its multiples."""
    running = {"step": ("sum", F.lit(1).cast("long")), **{name: ("sum", F.col(c)) for name, c in (sums or {}).items()}}
    return scan(df, keys, order, running).withColumns({name: F.col("step") % n == 0 for name, n in every.items()})
