"""Running values along ordered series of any length.

A series that no task should hold is cut into ranges of its order (``cut``).  What a range passes on is one row: its sum, its
largest or its last value.  These rows are composed along the series, and each range is then finished by itself, with what
came before it.  On frames that aren't cut, the same functions are plain windows by key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import materialize

#: The column that numbers the ranges, in order; frames that have it are cut.
PART = "_part"


def cut(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows in ranges of (keys, order), numbered; written to the shared folder, as each later pass needs the same ranges.

    Rows equal in both lie in one range."""
    return materialize(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(PART, F.spark_partition_id()), "cut")


def is_cut(df: DataFrame) -> bool:
    return PART in df.columns


def _along(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def paired(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys, null ones included; keys come from the left."""
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    met = F.lit(True)
    for k, name in names.items():
        met = met & left[k].eqNullSafe(F.col(name))
    return left.join(right.withColumnsRenamed(names), met, how).drop(*names.values())


_RUNNING = {
    "sum": lambda x, w: F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    "max": lambda x, w: F.max(x).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    "last": lambda x, w: F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    "lag": lambda x, w: F.lag(x).over(w),
    "max_before": lambda x, w: F.max(x).over(w.rowsBetween(Window.unboundedPreceding, -1)),
}


def scan(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add columns (name: (kind, value)) along the order of each key.

    Kinds: ``sum`` and ``max`` so far, ``last`` value so far that isn't null, ``lag``, the value of the row before (null for
    the first), ``max_before``, the largest of all rows before."""
    if not is_cut(df):
        return df.withColumns({name: _RUNNING[kind](x, _along(keys, order)) for name, (kind, x) in values.items()})
    at = F.struct(*order)
    total = {
        "sum": F.sum,
        "max": F.max,
        "max_before": F.max,
        "last": lambda x: F.max_by(x, F.when(x.isNotNull(), at)),
        "lag": lambda x: F.max_by(F.struct(x.alias("v")), at)["v"],
    }
    ranges = df.groupBy(*keys, PART).agg(*[total[kind](x).alias(name) for name, (kind, x) in values.items()])
    ahead = Window.partitionBy(*keys).orderBy(PART)
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    carried = {
        "sum": lambda c: F.sum(c).over(before),
        "max": lambda c: F.max(c).over(before),
        "max_before": lambda c: F.max(c).over(before),
        "last": lambda c: F.last(c, ignorenulls=True).over(before),
        "lag": lambda c: F.lag(c).over(ahead),
    }
    passed = materialize(ranges.select(*keys, PART, *[carried[kind](F.col(name)).alias(f"_c_{name}") for name, (kind, _) in values.items()]), "carried")
    w = _along([*keys, PART], order)
    out = df.withColumns({f"_l_{name}": _RUNNING[kind](x, w) for name, (kind, x) in values.items()})
    if any(kind == "lag" for kind, _ in values.values()):
        out = out.withColumn("_first", F.row_number().over(w) == 1)
    out = paired(out, passed, [*keys, PART])
    done = {}
    for name, (kind, _) in values.items():
        here, prior = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        done[name] = {
            "sum": F.when(here.isNull(), prior).otherwise(here + F.coalesce(prior, F.lit(0))),
            "max": F.greatest(here, prior),
            "max_before": F.greatest(here, prior),
            "last": F.coalesce(here, prior),
            "lag": F.when(F.col("_first"), prior).otherwise(here) if kind == "lag" else here,
        }[kind]
    return out.withColumns(done).drop("_first", *[f"_{x}_{name}" for x in "lc" for name in values])


def totals(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Add aggregates of each key: by windows, or on frames that are cut by a join with the pre-aggregated keys."""
    if not is_cut(df):
        return df.withColumns({name: x.over(Window.partitionBy(*keys)) for name, x in values.items()})
    return paired(df, materialize(df.groupBy(*keys).agg(*[x.alias(name) for name, x in values.items()]), "totals"), keys)


#: By how much (in shares) a percentile's first bracket is wider than the share on either side, and the size of the sketch
#: that it is read from, whose error is about a third of that.
MARGIN, SKETCH = 0.01, 1024


def percentiles(df: DataFrame, keys: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """(keys, n, a column for each share): exact percentiles of the values that aren't null, with linear interpolation.

    A sketch brackets each share; values below its bracket are only counted, those in it are counted by value, and the
    ranks are found along ranges of values (``scan``), so that no task holds a group.  Where a rank lies outside its bracket
    (a sketch may err), the bracket is opened to all values: results are exact whatever the sketch says.  NaN is larger than
    any number.  A group without values has no row.
    """
    base = df.select(*keys, F.col(x).cast("double").alias("_x")).filter("_x IS NOT NULL")
    number = F.when(~F.isnan("_x"), F.col("_x"))
    sketched = base.groupBy(*keys).agg(F.count("*").alias("n"), F.count(number).alias("_m"), F.kll_sketch_agg_double(number, SKETCH).alias("_sketch")).filter("n > 0")

    def edge(share: float, beyond: float) -> Column:
        inside = F.lit(0 < share < 1) & (F.col("_m") == F.col("n"))
        return F.when(inside, F.kll_sketch_get_quantile_double("_sketch", F.lit(min(max(share, 0.0), 1.0)))).otherwise(F.lit(beyond))

    asked = F.array(*[F.struct(F.lit(name).alias("_share"), F.lit(float(p)).alias("_p"), edge(p - MARGIN, -math.inf).alias("_a"), edge(p + MARGIN, math.nan).alias("_b")) for name, p in shares.items()])
    targets = materialize(sketched.select(*keys, "n", F.explode(asked).alias("t")).select(*keys, "n", "t.*").withColumn("_rank", F.col("_p") * (F.col("n") - 1)), "brackets")
    found = _ranked(base, targets, keys)
    wrong = found.filter("_missed").select(*keys, "_share")
    if not wrong.isEmpty():
        again = paired(targets, wrong, [*keys, "_share"], "left_semi").withColumns({"_a": F.lit(-math.inf), "_b": F.lit(math.nan)})
        found = found.filter("NOT _missed").unionByName(_ranked(base, materialize(again, "brackets"), keys))
    up, down = F.ceil("_rank") - F.col("_rank"), F.col("_rank") - F.floor("_rank")
    value = F.when(F.col("_lo").eqNullSafe(F.col("_hi")), F.col("_lo")).otherwise(up * F.col("_lo") + down * F.col("_hi"))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("_share") == name, value)).alias(name) for name in shares]).filter("n IS NOT NULL")


def _ranked(base: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _share, n, _rank, _lo, _hi, _missed): the values at either side of each rank, if they lie in its bracket."""
    met = (paired(base, targets, keys) if keys else base.crossJoin(F.broadcast(targets))).filter(F.col("_x") <= F.col("_b"))
    group = [*keys, "_share"]
    counted = met.groupBy(*group, "n", "_rank", F.when(F.col("_x") >= F.col("_a"), F.col("_x")).alias("_v")).agg(F.count("*").alias("_c"))
    ranked = scan(cut(counted, group, ["_v"]), group, ["_v"], {"_until": ("sum", F.col("_c"))})
    lo, hi = F.floor("_rank"), F.ceil("_rank")
    at = lambda r: F.min(F.when(F.col("_until") > r, F.col("_v")))
    below, seen = F.max(F.when(F.col("_v").isNull(), F.col("_c"))), F.max("_until")
    out = ranked.groupBy(*group, "n", "_rank").agg(at(lo).alias("_lo"), at(hi).alias("_hi"), F.coalesce(below, F.lit(0)).alias("_below"), seen.alias("_seen"))
    return materialize(out.withColumn("_missed", (F.col("_below") > lo) | (F.col("_seen") <= hi)).drop("_below", "_seen"), "ranked")
