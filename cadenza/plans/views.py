"""Views of the test tables as the engine's own data: text pairs, speaker trials, activity series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import cosine_or_zero
from ..operators.metrics import centroids
from ..workspace import table

PAIRS = """pairs AS (SELECT a.p_partkey AS id, a.p_name AS ref, b.p_name AS hyp, a.p_brand AS brand, a.p_size AS size, a.p_retailprice AS price,
  CASE WHEN a.p_size % 2 = 0 THEN 'pos' ELSE 'neg' END AS split FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"""

ALIGNED = f"""RECURSIVE {PAIRS}, u AS (SELECT DISTINCT ref, hyp FROM pairs),
d AS (SELECT ref, hyp, 0 AS k, list_transform(range(0, length(hyp) + 1), lambda j: j * 1048577) AS r FROM u
  UNION ALL
  SELECT ref, hyp, k + 1, list_transform(range(0, length(hyp) + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda q: b[q + 1] + (j - q) * 1048577)))
  FROM (SELECT ref, hyp, k, list_transform(range(0, length(hyp) + 1), lambda j: CASE WHEN j = 0 THEN (k + 1) * 1048577
          ELSE least(r[j] + CASE WHEN hyp[j] = ref[k + 1] THEN 0 ELSE 1048576 END, r[j + 1] + 1048577) END) AS b FROM d WHERE k < length(ref)) x),
al AS (SELECT ref, hyp, r[-1] // 1048576 AS errors, r[-1] % 1048576 AS gaps, CAST(length(ref) AS BIGINT) AS n, length(hyp) AS m FROM d WHERE k = length(ref)),
sdi AS (SELECT ref, hyp, CAST(errors - gaps AS BIGINT) AS s, CAST((gaps + n - m) // 2 AS BIGINT) AS d, CAST((gaps - n + m) // 2 AS BIGINT) AS i, n, CAST(errors AS BIGINT) AS errors FROM al)"""

TRIALS = """ranked AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
dims AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM ranked WHERE rn <= 3) GROUP BY label, i),
cent AS (SELECT label, list(m ORDER BY i) AS c FROM dims GROUP BY label),
trials AS (SELECT r.vec_id, r.label, 'pos' AS split, list_cosine_similarity(CAST(r.embedding AS DOUBLE[]), c.c) AS sim FROM ranked r JOIN cent c ON c.label = r.label WHERE r.rn > 3
  UNION ALL SELECT r.vec_id, r.label, 'neg', list_cosine_similarity(CAST(r.embedding AS DOUBLE[]), c.c) FROM ranked r JOIN cent c ON c.label = (r.label + 1) % 10 WHERE r.rn > 3)"""

ACTIVITY = """act AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, event_type, value, least(value / 200, 1) AS p FROM events)"""

ON, OFF = 0.35, 0.15
HYSTERESIS = f"""{ACTIVITY}, sw AS (SELECT *, coalesce(last_value(CASE WHEN p >= {ON} THEN 1 WHEN p < {OFF} THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), 0) AS active FROM act),
chg AS (SELECT *, CASE WHEN active = lag(active) OVER (PARTITION BY user_id ORDER BY t) THEN 0 ELSE 1 END AS c FROM sw),
num AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM chg),
runs AS (SELECT user_id, min(t) AS "start", max(t) AS "end", count(*) AS length FROM num WHERE active = 1 GROUP BY user_id, run)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each part's name as reference, the next one's as hypothesis."""
    part = table(spark, sf, "part")
    a = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("ref"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.when(F.col("p_size") % 2 == 0, "pos").otherwise("neg").alias("split"))
    b = part.select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("hyp"))
    return a.join(b, "id")


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with s, d, i, n, errors; each distinct pair is aligned once."""
    from ..functions.text import alignment

    rows = pairs(spark, sf)
    distinct = rows.select("ref", "hyp").distinct().withColumn("a", alignment(F.col("ref"), F.col("hyp"))).select("ref", "hyp", "a.*")
    return rows.join(distinct, ["ref", "hyp"])


def trials(spark: SparkSession, sf: str) -> DataFrame:
    """Labels are speakers: the three first vectors enrol, the others are scored against their own and another speaker."""
    vectors = table(spark, sf, "embeddings")
    ranked = vectors.select("vec_id", "label").withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    first = ranked.filter("rn <= 3").select("vec_id")  # ids only: a limit by group, before any vector moves
    enrolled = centroids(vectors.join(first, "vec_id", "left_semi"), ["label"], "embedding")
    rest = vectors.join(first, "vec_id", "left_anti")
    faced = rest.select("*", F.explode(F.array(F.struct(F.lit("pos").alias("split"), F.col("label").alias("against")), F.struct(F.lit("neg").alias("split"), ((F.col("label") + 1) % 10).alias("against")))).alias("f")).select("vec_id", "label", "embedding", "f.*")
    joined = faced.join(enrolled.select(F.col("label").alias("against"), "centroid"), "against")
    return joined.select("vec_id", "label", "split", cosine_or_zero(F.col("embedding"), F.col("centroid")).alias("sim"))


def activity(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user, numbered in time, with a value scaled to [0, 1]."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("t"), "event_type", "value", F.least(F.col("value") / 200, F.lit(1.0)).alias("p"))
