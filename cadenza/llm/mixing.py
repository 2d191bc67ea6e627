"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import materialize, table

#: Entries that a task sums up one by one (of one source and turn) on the average.
RUN = 4096
#: What tells entries of the queue apart, in the order in which ties of finish time are served.
ORDER = ["finish", "rank", "turn", "key", "base", "copy"]
_WORD = r"[^\x20\x09-\x0D]+"


def _sources(rows: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """One row a source: its rank by code point (null last), size, documents, and target (words).

    Targets are min(cap, weight * level); in the order of cap / weight the first sources are capped, and the level follows
    from what is left for the others.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1))
    by = by.withColumn("cap", F.col("source_size") * most).withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("reach", F.col("cap") / F.col("weight"))
    order = Window.orderBy("reach", "rank")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    by = by.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "rank", "level"))).over(everything)
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * first["level"], F.col("cap").cast("double")))
    return by.select("source", "rank", "source_size", "n", "budget", target.alias("target"))


def fair_queue(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The queue of all documents, each in ``most`` turns: (id, source, rank, size, source_size, target, turn, finish, before,
    taken, part, ...).

    Each turn of a source is shuffled by a digest of id, text and ``seed``; an entry's virtual finish time is the source's
    words up to its end, over the source's target.  The queue is range-sorted by it, and whole entries are taken as long
    as the words so far stay within the budget, ``share`` times all words.  ``before`` counts the words ahead of an entry.

    A null text has no words and is never taken, a null source is one of its own, a null id is returned as such; rows that
    repeat are shuffled each by itself; reruns give the same queue.  Columns other than the three named are ignored, whatever
    their names.  The list of sources (a row each) is ranked in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"), F.col(text_col)))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"), base.alias("base"))
    # Equal rows meet as one count, and part again, each with a place of its own.
    alike = sized.groupBy("id", "source", "size", "base").agg(F.count("*").alias("m"))
    rows = materialize(alike.select("id", "source", "size", "base", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("copy")), "mix-rows")
    sources = materialize(_sources(rows, weights, share, most), "mix-sources")

    turns = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("turn")
    entries = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"]).select("*", turns)
    digest = F.md5(F.concat_ws(":", "base", F.col("copy").cast("string"), F.col("turn").cast("string")))
    entries = entries.withColumn("key", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    # Runs: ranges of keys, as many for a source as it has documents for, so that a large source is summed by many tasks.
    entries = entries.withColumn("run", F.expr(f"shiftright(key, 60 - CAST(least(40, greatest(0, ceil(log2(n / {RUN})))) AS INT))"))
    run = ["rank", "turn", "run"]
    ahead = Window.partitionBy("rank").orderBy("turn", "run").rowsBetween(Window.unboundedPreceding, -1)
    sums = entries.groupBy(*run).agg(F.sum("size").alias("words")).select(*run, F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy(*run).orderBy("key", "base", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = F.col("ahead") + F.sum("size").over(within)
    entries = entries.join(sums, run).withColumn("finish", F.when(F.col("target") > 0, done / F.col("target")).otherwise(F.lit(0.0)))

    # The global order: ranges of finish time, summed range by range.
    queue = entries.select("id", "source", "size", "source_size", "target", "budget", *ORDER).repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id())
    queue = materialize(queue, "mix-queue")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = queue.groupBy("part").agg(F.sum("size").alias("words")).select("part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("ahead"))
    local = Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = queue.join(materialize(parts, "mix-parts"), "part").withColumn("until", F.col("ahead") + F.sum("size").over(local))
    taken = F.when(F.col("until") <= F.col("budget"), F.col("size")).otherwise(F.lit(0)).cast("long")
    return queue.withColumn("before", F.col("until") - F.col("size")).withColumn("taken", taken).drop("ahead", "until").withColumnRenamed("id", id_col)


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in order: one row for each time a document is taken (id, source, size, turn, finish, before)."""
    queue = fair_queue(docs, **options)
    return queue.filter("taken > 0").orderBy(*ORDER).select(options.get("id_col", "doc_id"), "source", "size", "turn", "finish", "before")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """One row per document: id, size, source_size, target (its source's) and taken, the words that the mix takes of it over
    all its turns.  Options and odd rows as in ``fair_queue``; an empty table gives an empty result."""
    queue, i = fair_queue(docs, **options), options.get("id_col", "doc_id")
    mixed = queue.groupBy(i, "rank", "base", "copy", "size", "source_size", "target").agg(F.sum("taken").alias("taken"))
    return mixed.select(i, "size", "source_size", "target", "taken")


def op11_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


SQL = r"""
    WITH sized AS (
      SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR), text)) AS base
      FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, base) AS copy FROM sized),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM r GROUP BY source),
    t AS (SELECT *, CAST([5, 2, 1][CAST((rank - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight, source_size * 2 AS cap,
                 CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS budget FROM s),
    u AS (SELECT *, cap / weight AS reach FROM t),
    v AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY reach, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (ORDER BY reach, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM u),
    l AS (SELECT arg_min(level, {'reach': reach, 'rank': rank}) FILTER (level <= reach) AS level FROM v),
    w AS (SELECT v.*, least(CAST(cap AS DOUBLE), coalesce(weight * l.level, CAST(cap AS DOUBLE))) AS target FROM v, l),
    e AS (
      SELECT r.doc_id, r.size, r.base, r.copy, w.rank, w.source_size, w.target, w.budget, turn,
             CAST('0x' || md5(concat_ws(':', r.base, CAST(r.copy AS VARCHAR), CAST(turn AS VARCHAR)))[1:15] AS BIGINT) AS key
      FROM r JOIN w ON r.source IS NOT DISTINCT FROM w.source, range(2) AS turns(turn)),
    f AS (SELECT *, CASE WHEN target > 0 THEN sum(size) OVER (PARTITION BY rank ORDER BY turn, key, base, copy ROWS UNBOUNDED PRECEDING) / target ELSE 0 END AS finish FROM e),
    q AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, turn, key, base, copy ROWS UNBOUNDED PRECEDING) AS until FROM f)
    SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN until <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
    FROM q GROUP BY doc_id, rank, base, copy, size, source_size, target"""
