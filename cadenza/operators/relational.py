"""Checked joins, validation and set comparisons over manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def present(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c.cast("string"), F.lit("")) != ""


def aliased(*names: str, empty_counts: bool = False) -> Column:
    """The first of several fields that is there; by default an empty one is skipped as well."""
    return F.coalesce(*[F.col(n) if empty_counts else F.when(present(F.col(n)), F.col(n)) for n in names])


def violations(df: DataFrame, key: str, required: list[str]) -> DataFrame:
    """(rule, key, detail): missing fields and repeated keys.  Empty means valid."""
    lacks = F.array_compact(F.array(*[F.when(~present(F.col(c)), c) for c in required]))
    missing = df.select(F.col(key).cast("string").alias("key"), F.explode(lacks).alias("detail")).select(F.lit("missing").alias("rule"), "key", "detail")
    repeated = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("repeated").alias("rule"), F.col(key).cast("string").alias("key"), F.col("n").cast("string").alias("detail"))
    return missing.unionByName(repeated)


def required(ok: Column, message: Column) -> Column:
    """A condition for ``filter`` that raises for a row where ``ok`` doesn't hold.  Filters, unlike projected columns, are never
    pruned, so the check runs whatever is asked of the result."""
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def validated(df: DataFrame, key: str, required: list[str]) -> DataFrame:
    bad = violations(df, key, required).limit(5).collect()
    if bad:
        raise ValueError(f"invalid manifest: {[tuple(r) for r in bad]}")
    return df


def referenced(rows: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """Inner join that raises for a key the dictionary lacks."""
    joined = rows.join(dictionary.withColumn("_hit", F.lit(True)), key, "left")
    told = F.concat(F.lit("no entry for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return joined.filter(required(F.coalesce("_hit", F.lit(False)), told)).drop("_hit")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def with_pair(rows: DataFrame, table: DataFrame, left: str, right: str, key: str, value: str) -> DataFrame:
    """Rows whose two keys both occur in ``table``, with both values (left_value, right_value)."""
    a, b = (table.select(F.col(key).alias(k), F.col(value).alias(f"{k}_value")) for k in (left, right))
    return rows.join(a, left).join(b, right)


def combined(frames: list[DataFrame], key: str) -> DataFrame:
    """All rows of several manifests; raises for a key that occurs twice, within one or across them."""
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    rest = [c for c in every.columns if c != key]
    once = every.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    told = F.concat(F.lit("repeated key "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return once.filter(required(F.col("_n") == 1, told)).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def scored(rows: DataFrame, items: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """Rows with their item (the last one of a key by ``order``); those without an item or without its score are left out."""
    return rows.join(latest(items, keys, order).filter(F.col(score).isNotNull()), keys)


def unscored(rows: DataFrame, items: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """What ``scored`` leaves out."""
    return rows.join(latest(items, keys, order).filter(F.col(score).isNotNull()), keys, "left_anti")


def wrong_partner(df: DataFrame, group: str, key: str, who: str, usable: Column) -> DataFrame:
    """For each row the first other row (by key) of its group with another ``who``: by one window, not a self-join.

    The first and the first of another ``who`` are all that any row of a group can need."""
    w = Window.partitionBy(group)
    ok = df.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    firsts = ok.filter("_ok").groupBy(group, who).agg(F.min(key).alias("_k"))
    ranked = firsts.withColumn("_r", F.row_number().over(w.orderBy("_k"))).filter("_r <= 2").groupBy(group).agg(F.min_by(F.struct(who, "_k"), "_r").alias("_a"), F.max(F.when(F.col("_r") == 2, F.col("_k"))).alias("_b"))
    partner = F.when(F.col(f"_a.{who}") != F.col(who), F.col("_a._k")).otherwise(F.col("_b"))
    return df.join(ranked, group, "left").withColumn("partner", partner).drop("_a", "_b")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def agree(df: DataFrame, fields: list[str]) -> Column:
    return F.count_distinct(F.to_json(F.struct(*fields))) <= 1


def readiness(rows: DataFrame, path_cols: list[str], listing: DataFrame, examples: int = 20) -> DataFrame:
    """For each path column: present, missing, and the first examples that are missing."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("path")) for c in path_cols])).alias("x")).select("x.*")
    joined = long.join(listing.select("path", F.lit(True).alias("_there")).distinct(), "path", "left")
    counts = joined.groupBy("field").agg(F.count_if("_there").alias("present"), F.count_if(F.col("_there").isNull()).alias("missing"))
    ranked = joined.filter(F.col("_there").isNull() & F.col("path").isNotNull()).select("field", "path").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("field").orderBy("path"))).filter(F.col("_r") <= examples)
    shown = ranked.groupBy("field").agg(F.array_sort(F.collect_list("path")).alias("examples"))
    return counts.join(shown, "field", "left")


def page(df: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """Offset first, then limit, in an explicit order."""
    return df.orderBy(order).offset(offset).limit(limit)
