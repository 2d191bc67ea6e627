"""Deterministic corpus building: partitions, seeds, scenarios, leakage and acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import PART, cut, scan, totals


def hash_percent(x: Column) -> Column:
    """The first 32 bits of SHA-256, modulo 100."""
    return (F.conv(F.substring(F.sha2(x, 256), 1, 8), 16, 10).cast("long") % 100).cast("int")


def hash_partition(x: Column, train: int = 80, dev: int = 10) -> Column:
    p = hash_percent(x)
    return F.when(p < train, "train").when(p < train + dev, "dev").otherwise("test")


def derived_seed(sample_id: Column, salt: str) -> Column:
    """64 unsigned bits as decimal(20,0)."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit("sample:"), sample_id.cast("string"), F.lit(f":{salt}")), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def uniform(x: Column, purpose: str) -> Column:
    """A number in [0, 1) that a key and a purpose fix, on any cluster."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{purpose}:"), x.cast("string")), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


def bucketed_draw(x: Column, purpose: str, buckets: list[tuple[float, float]]) -> Column:
    """A bucket at even odds, then a value within it."""
    which = F.floor(uniform(x, purpose + "/bucket") * len(buckets)).cast("int")
    lo, hi = F.array(*[F.lit(float(a)) for a, _ in buckets]), F.array(*[F.lit(float(b)) for _, b in buckets])
    return F.get(lo, which) + uniform(x, purpose + "/value") * (F.get(hi, which) - F.get(lo, which))


def scenario_by_position(index: Column, cycle: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, cycle)), (index % len(cycle)).cast("int"))


def overlap_label(overlap: Column, sir: Column) -> Column:
    """``overlap_{percent}_sir_{minus}{db}`` with half-even rounding."""
    db = F.bround(F.abs(sir)).cast("long").cast("string")
    return F.concat(F.lit("overlap_"), F.bround(overlap * 100).cast("long").cast("string"), F.lit("_sir_"), F.when(sir < 0, "minus").otherwise(""), db)


def disjoint_split(keys: DataFrame, key: str, shares: tuple[float, float] = (0.75, 0.125)) -> DataFrame:
    """Split distinct keys by their rank in hash order, range by range; at least two go to either smaller side."""
    order = ["_h", key]
    hashed = keys.select(key).distinct().withColumn("_h", F.sha2(F.col(key).cast("string"), 256))
    ranked = scan(cut(hashed, [], order), [], order, {"_r": ("sum", F.lit(1).cast("long"))}).withColumn("_r", F.col("_r") - 1)
    n = hashed.count()
    side = max(2, int(n * shares[1]))
    return ranked.select(key, F.when(F.col("_r") < n - 2 * side, "train").when(F.col("_r") < n - side, "dev").otherwise("test").alias("split"))


def shuffled_split(df: DataFrame, label: str, key: str, share: float, seed: int) -> DataFrame:
    """Add ``train``: of each class the first share in a shuffled order that seed and key fix, rounded half to even; either
    side has a row at least where a class has two.  Ranks are counted along ranges, so a class may have any size; null is a
    class, and rows that repeat a key follow each other."""
    order = ["_h", key]
    hashed = df.withColumn("_h", F.sha2(F.concat(F.lit(f"split:{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256))
    ranked = totals(scan(cut(hashed, [label], order), [label], order, {"_r": ("sum", F.lit(1).cast("long"))}), [label], {"_n": F.count("*")})
    most = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.bround(F.col("_n") * share, 0).cast("long")))
    return ranked.withColumn("train", F.col("_r") <= most).drop("_h", "_r", "_n", PART)


def usable(df: DataFrame, key: str, least: int) -> DataFrame:
    """Keys of at least ``least`` rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def leakage(df: DataFrame, split: str, role: str) -> DataFrame:
    """For each pair of splits the number of role values that both hold: one pass over (value, split), no join of splits."""
    held = df.groupBy(role).agg(F.array_sort(F.collect_set(split)).alias("s")).filter(F.size("s") > 1)
    a = held.select(role, "s", F.posexplode("s").alias("i", "left_split"))
    pairs = a.select(role, "left_split", F.explode(F.slice(F.col("s"), F.col("i") + 2, F.size("s"))).alias("right_split"))
    return pairs.groupBy("left_split", "right_split").agg(F.count("*").alias("shared"))


def acceptance(df: DataFrame, split: str, key: str, roles: list[str], wrong: Column) -> DataFrame:
    """One row: rows, repeated keys, shared role values, rows out of tolerance, and PASS or FAIL."""
    repeats = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"))
    out = df.agg(F.count("*").alias("rows"), F.count_if(wrong).alias("tolerance_failures")).crossJoin(repeats)
    for role in roles:
        out = out.crossJoin(leakage(df, split, role).agg(F.coalesce(F.sum("shared"), F.lit(0)).alias(f"shared_{role}")))
    clean = (F.col("duplicate_ids") == 0) & (F.col("tolerance_failures") == 0)
    for role in roles:
        clean = clean & (F.col(f"shared_{role}") == 0)
    return out.withColumn("verdict", F.when(clean, "PASS").otherwise("FAIL"))


def to_do(tasks: DataFrame, journal: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks that the journal does not list."""
    return tasks.join(journal, keys, "left_anti")


def kind_of_entry(explicit: Column, scenario: Column, legacy: Column, active: Column) -> Column:
    """Whether the target is absent: an explicit flag, then the scenario, then the old flag, then whether anything is active."""
    absent = ["absent", "enroll_swap_absent"]
    return F.coalesce(~explicit, F.when(scenario.isNotNull(), scenario.isin(absent)), legacy, active == 0, F.lit(False))


def scene_filter(mode: str, present: Column, scenario: Column) -> Column:
    """Rows that a training mode takes; a missing scenario passes, a missing flag counts as present."""
    if mode == "b1":
        return F.coalesce(present, F.lit(True))
    names = {"b2": ["absent", "enroll_swap_absent"], "b3": ["enroll_swap_target_1", "enroll_swap_target_2", "enroll_swap_absent"]}[mode]
    return scenario.isNull() | scenario.isin(names)


def flagged(c: Column) -> Column:
    """A flag written as true, True or 1; anything else, null too, is no flag."""
    return F.coalesce(c.cast("string").isin("true", "True", "1"), F.lit(False))


def is_swap(scenario: Column, flag: Column, *enrolments: Column) -> Column:
    """Whether another enrolment was put in place: by the scenario's name, by a flag, or by a field that names it."""
    named = [F.coalesce(e.cast("string"), F.lit("")) != "" for e in enrolments]
    out = F.coalesce(scenario.contains("enroll_swap"), F.lit(False)) | flagged(flag)
    for n in named:
        out = out | n
    return out


def force_zero(present: Column, absent: Column, swap: Column) -> Column:
    """Whether the target must come out as silence: where the speaker is known not to be there; where nothing is known, for
    absent and swapped entries."""
    return F.when(present.isNotNull(), ~present).otherwise(absent | swap)
