"""Queries on ordered series and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import metrics, scans, sequences
from ..workspace import table
from . import views
from .catalog import query


def _switched(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.hysteresis(views.activity(spark, sf), ["user_id"], ["t"], "p", views.ON, views.OFF)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.active_runs(_switched(spark, sf), ["user_id"], ["t"], "t")


@query("W1 W2", f'WITH {views.HYSTERESIS} SELECT user_id, "start", "end", length FROM runs')
def hysteresis_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf)


_MERGED = f"""{views.HYSTERESIS}, g AS (SELECT *, CASE WHEN "start" - lag("end") OVER (PARTITION BY user_id ORDER BY "start") <= 3 THEN 0 ELSE 1 END AS f FROM runs),
g2 AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS segment FROM g),
seg AS (SELECT user_id, CAST(segment AS BIGINT) AS segment, min("start") AS "start", max("end") AS "end" FROM g2 GROUP BY user_id, segment)"""


@query("W3 W6 W7", f"""WITH {_MERGED}, core AS (SELECT * FROM seg WHERE "end" - "start" + 1 >= 2)
SELECT c.user_id, segment, "start", "end", greatest("start" - 2, 0) AS guarded_start, "end" + 2 AS guarded_end, round(avg(p) + 1e-9, 6) AS mean_p, count(*) AS frames FROM core c JOIN act a ON a.user_id = c.user_id AND a.t BETWEEN "start" AND "end" GROUP BY ALL""")
def gap_merge_segments(spark: SparkSession, sf: str) -> DataFrame:
    core = sequences.drop_short(sequences.merge_gaps(_runs(spark, sf), ["user_id"], 3), 2)
    told = sequences.segment_features(core, views.activity(spark, sf), ["user_id"], "t", "p")
    return sequences.add_guard(told, 2, 2, 1 << 40).select("user_id", "segment", "start", "end", "guarded_start", "guarded_end", F.round(F.col("mean_p") + 1e-9, 6).alias("mean_p"), "frames")


@query("W4 W5", f"""WITH {views.HYSTERESIS}, w AS (SELECT user_id, greatest("start" - 1, 0) AS "start", "end" + 1 AS "end" FROM runs), k AS (SELECT * FROM w WHERE "end" - "start" >= 3),
m AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k),
f AS (SELECT *, sum(CASE WHEN "start" - reach <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS segment FROM m)
SELECT user_id, CAST(segment AS BIGINT) AS segment, min("start") AS "start", max("end") AS "end" FROM f GROUP BY user_id, segment""")
def interval_merge_pad(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.pad_and_merge(_runs(spark, sf).select("user_id", "start", "end"), ["user_id"], 1, 3, 1)


_CLEAN = f"""{views.HYSTERESIS}, n1 AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS n FROM num), a1 AS (SELECT user_id, t, CASE WHEN active = 1 AND n < 2 THEN 0 ELSE active END AS active FROM n1),
c2 AS (SELECT *, CASE WHEN active = lag(active) OVER (PARTITION BY user_id ORDER BY t) THEN 0 ELSE 1 END AS c FROM a1), r2 AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM c2),
n2 AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS n, max(run) OVER (PARTITION BY user_id) AS lastrun FROM r2),
a2 AS (SELECT user_id, t, CASE WHEN active = 0 AND run > 1 AND run < lastrun AND n <= 4 THEN 1 ELSE active END AS active FROM n2)"""


@query("W8", f"WITH {_CLEAN} SELECT user_id, CAST(sum(active) AS BIGINT) AS active_rows, count(*) AS rows FROM a2 GROUP BY user_id")
def run_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = sequences.clean_runs(_switched(spark, sf), ["user_id"], ["t"], 2, 4)
    return cleaned.groupBy("user_id").agg(F.sum("active").cast("long").alias("active_rows"), F.count("*").alias("rows"))


@query("V8", f"""WITH {views.ACTIVITY}, e AS (SELECT user_id, p, least(greatest(p, 1e-8), 1 - 1e-8) AS q FROM act)
SELECT user_id, round(avg(-(q * ln(q) + (1 - q) * ln(1 - q))), 6) AS entropy, round(median(p) + 1e-9, 6) AS median, round(quantile_cont(p, 0.75) - quantile_cont(p, 0.25) + 1e-9, 6) AS iqr, round(min(p), 6) AS least, round(max(p), 6) AS most FROM e GROUP BY user_id""")
def activity_entropy_profile(spark: SparkSession, sf: str) -> DataFrame:
    q1, q3 = F.percentile("p", F.lit(0.25)), F.percentile("p", F.lit(0.75))
    return views.activity(spark, sf).groupBy("user_id").agg(F.round(F.avg(V.entropy(F.col("p"))), 6).alias("entropy"), F.round(F.median("p") + 1e-9, 6).alias("median"), F.round(q3 - q1 + 1e-9, 6).alias("iqr"), F.round(F.min("p"), 6).alias("least"), F.round(F.max("p"), 6).alias("most"))


@query("A9", """WITH r AS (SELECT l_suppkey, l_extendedprice AS x, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice RANGE UNBOUNDED PRECEDING) AS run, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS total FROM lineitem)
SELECT l_suppkey, coalesce(min(CASE WHEN run >= total / 2 THEN x END), 0) AS weighted_median FROM r GROUP BY l_suppkey""")
def duration_weighted_median(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.duration_weighted_median(table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity"), ["l_suppkey"], "l_extendedprice", "l_quantity")


@query("A7", "SELECT event_type, round(quantile_cont(value, 0.5) + 1e-9, 6) AS p50, round(quantile_cont(value, 0.95) + 1e-9, 6) AS p95, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    got = metrics.percentiles(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return got.select("event_type", F.round(F.col("p50") + 1e-9, 6).alias("p50"), F.round(F.col("p95") + 1e-9, 6).alias("p95"), "n")


@query("A8 A10", """SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS least, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice) + 1e-9, 4) AS median, round(quantile_cont(o_totalprice, 0.25) + 1e-9, 4) AS q1, round(quantile_cont(o_totalprice, 0.75) + 1e-9, 4) AS q3, max(o_totalprice) AS most FROM orders GROUP BY o_orderstatus""")
def large_group_profiles(spark: SparkSession, sf: str) -> DataFrame:
    got = metrics.profiled(table(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("double")), ["o_orderstatus"], "o_totalprice")
    return got.select("o_orderstatus", "n", "least", F.round("mean", 4).alias("mean"), *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("median", "q1", "q3")], "most")


# All events as one series, cut into ranges: what has windows by user above, without a window that holds the series.
_ONE = f"""act AS (SELECT event_id AS t, least(value / 200, 1) AS p FROM events),
sw AS (SELECT *, coalesce(last_value(CASE WHEN p >= {views.ON} THEN 1 WHEN p < {views.OFF} THEN 0 END IGNORE NULLS) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING), 0) AS active FROM act),
chg AS (SELECT *, CASE WHEN active = lag(active) OVER (ORDER BY t) THEN 0 ELSE 1 END AS c FROM sw), num AS (SELECT *, sum(c) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM chg)"""


def _one_series(spark: SparkSession, sf: str) -> DataFrame:
    return scans.cut(table(spark, sf, "events").select(F.col("event_id").alias("t"), F.least(F.col("value") / 200, F.lit(1.0)).alias("p")), [], ["t"])


@query("W1 W2 W3 W6 W7", f"""WITH {_ONE}, runs AS (SELECT min(t) AS "start", max(t) AS "end" FROM num WHERE active = 1 GROUP BY run),
g AS (SELECT *, CASE WHEN "start" - lag("end") OVER (ORDER BY "start") <= 3 THEN 0 ELSE 1 END AS f FROM runs), g2 AS (SELECT *, sum(f) OVER (ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS segment FROM g),
seg AS (SELECT CAST(segment AS BIGINT) AS segment, min("start") AS "start", max("end") AS "end" FROM g2 GROUP BY segment)
SELECT segment, "start", "end", greatest("start" - 2, 0) AS guarded_start, "end" + 2 AS guarded_end, round(avg(p) + 1e-9, 6) AS mean_p, count(*) AS frames FROM seg JOIN act ON t BETWEEN "start" AND "end" WHERE "end" - "start" >= 1 GROUP BY ALL""")
def long_series_segments(spark: SparkSession, sf: str) -> DataFrame:
    series = _one_series(spark, sf)
    switched = sequences.hysteresis(series, [], ["t"], "p", views.ON, views.OFF)
    runs = sequences.active_runs(switched, [], ["t"], "t").select("start", "end")
    core = sequences.drop_short(sequences.merge_gaps(scans.cut(runs, [], ["start"]), [], 3), 2)
    told = sequences.add_guard(sequences.segment_features(core, series, [], "t", "p"), 2, 2, 1 << 40)
    return told.select("segment", "start", "end", "guarded_start", "guarded_end", F.round(F.col("mean_p") + 1e-9, 6).alias("mean_p"), "frames")


@query("W8 W13", f"""WITH {_ONE}, n1 AS (SELECT *, count(*) OVER (PARTITION BY run) AS n FROM num), a1 AS (SELECT t, CASE WHEN active = 1 AND n < 2 THEN 0 ELSE active END AS active FROM n1),
c2 AS (SELECT *, CASE WHEN active = lag(active) OVER (ORDER BY t) THEN 0 ELSE 1 END AS c FROM a1), r2 AS (SELECT *, sum(c) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM c2),
n2 AS (SELECT *, count(*) OVER (PARTITION BY run) AS n, max(run) OVER () AS lastrun FROM r2), a2 AS (SELECT t, CASE WHEN active = 0 AND run > 1 AND run < lastrun AND n <= 4 THEN 1 ELSE active END AS active FROM n2),
f AS (SELECT row_number() OVER (ORDER BY t) - 1 AS r, sum(CAST(active AS DOUBLE)) OVER (ORDER BY t ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) / 8 AS m FROM a2)
SELECT r // 4 AS frame, CASE WHEN m > 0.5 THEN 1 ELSE 0 END AS active FROM f WHERE r % 4 = 0""")
def long_series_frames(spark: SparkSession, sf: str) -> DataFrame:
    switched = sequences.hysteresis(_one_series(spark, sf), [], ["t"], "p", views.ON, views.OFF)
    return sequences.pooled_activity(sequences.clean_runs(switched, [], ["t"], 2, 4), [], ["t"], "active", 8, 4, 0.5)


@query("W13", f"""WITH {views.ACTIVITY}, f AS (SELECT user_id, t, sum(CASE WHEN p > 0.25 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4 AS m FROM act)
SELECT user_id, t // 2 AS frame, CASE WHEN m > 0.5 THEN 1 ELSE 0 END AS active FROM f WHERE t % 2 = 0""")
def frame_activity(spark: SparkSession, sf: str) -> DataFrame:
    marked = views.activity(spark, sf).withColumn("mask", (F.col("p") > 0.25).cast("int"))
    return sequences.pooled_activity(marked, ["user_id"], ["t"], "mask", 4, 2, 0.5)


@query("A24", f"""WITH {views.ACTIVITY} SELECT user_id, round(tp / (said + 1e-8), 6) AS precision, round(tp / (true_ + 1e-8), 6) AS recall FROM (
  SELECT user_id, count(*) FILTER (p > 0.2 AND value % 2 < 1) AS tp, count(*) FILTER (p > 0.2) AS said, count(*) FILTER (value % 2 < 1) AS true_ FROM act GROUP BY user_id)""")
def activity_prf(spark: SparkSession, sf: str) -> DataFrame:
    p, r, _ = metrics.precision_recall(F.col("p") > 0.2, F.col("value") % 2 < 1)
    return views.activity(spark, sf).groupBy("user_id").agg(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"))


_NEIGHBOURS = "nb AS (SELECT a.vec_id, a.label, CAST(a.embedding AS DOUBLE[]) AS e, CAST(b.embedding AS DOUBLE[]) AS r FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("e"))
    return a.join(table(spark, sf, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("r")), "vec_id")


@query("V14 A12 A13", f"""WITH {_NEIGHBOURS}, z AS (SELECT label, list_transform(e, lambda x: x - list_avg(e)) AS e, list_transform(r, lambda x: x - list_avg(r)) AS r FROM nb),
k AS (SELECT label, e, r, list_inner_product(e, r) / (list_inner_product(r, r) + 1e-8) AS a FROM z),
s AS (SELECT label, a * a * list_inner_product(r, r) AS signal, list_sum(list_transform(range(1, len(e) + 1), lambda i: (e[i] - a * r[i]) * (e[i] - a * r[i]))) AS error FROM k)
SELECT label, round(10 * log10(sum(signal) / (sum(error) + 1e-8) + 1e-8), 4) AS corpus_db, round(avg(10 * log10(signal / (error + 1e-8) + 1e-8)), 4) AS utterance_db FROM s GROUP BY label""")
def sisdr_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    parts = _neighbours(spark, sf).select("label", V.si_sdr_parts(F.col("e"), F.col("r")).alias("x")).select("label", "x.*")
    return parts.groupBy("label").agg(F.round(metrics.corpus_si_sdr(F.col("signal"), F.col("error")), 4).alias("corpus_db"), F.round(F.avg(V.decibel(F.col("signal"), F.col("error"))), 4).alias("utterance_db"))


@query("V9 V16 V30", f"""WITH {_NEIGHBOURS} SELECT vec_id, round(list_inner_product(e, e) / (list_inner_product(r, r) + 1e-8), 6) AS energy_ratio, round(sqrt(list_inner_product(e, e) / len(e) + 1e-10), 6) AS rms,
  CASE WHEN label % 2 = 0 THEN round(e[1] - r[1], 6) END AS delta FROM nb""")
def energy_ratio_delta(spark: SparkSession, sf: str) -> DataFrame:
    e, r = F.col("e"), F.col("r")
    delta = V.delta_score(F.get(e, F.lit(0)).cast("double"), F.get(r, F.lit(0)).cast("double"), F.col("label") % 2 == 0, F.lit(True))
    return _neighbours(spark, sf).select("vec_id", F.round(V.energy_ratio(e, r), 6).alias("energy_ratio"), F.round(V.rms(e), 6).alias("rms"), F.round(delta, 6).alias("delta"))


@query("V2", f"WITH {views.TRIALS} SELECT vec_id, split, round(sim, 6) AS sim FROM trials")
def cosine_trials(spark: SparkSession, sf: str) -> DataFrame:
    return views.trials(spark, sf).select("vec_id", "split", F.round("sim", 6).alias("sim"))


@query("A25", "WITH d AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i), n AS (SELECT label, sqrt(sum(m * m)) + 1e-9 AS s FROM d GROUP BY label) SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(m / s, 6) AS value FROM d JOIN n USING (label)")
def enroll_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.centroids(table(spark, sf, "embeddings"), ["label"], "embedding").select("label", F.posexplode("centroid").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("J15 W11", """WITH p AS (SELECT vec_id, unnest([1, 2, 3]) AS i, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT a.vec_id, list_cosine_similarity(a.e[(a.i - 1) * 16 + 1 : a.i * 16], a.e[(j - 1) * 16 + 1 : j * 16]) AS c FROM p a, (SELECT unnest([2, 3, 4]) AS j) WHERE a.i < j)
SELECT vec_id, round(median(c), 6) AS consistency, count(*) AS pairs FROM q GROUP BY vec_id""")
def pairwise_consistency(spark: SparkSession, sf: str) -> DataFrame:
    cut = table(spark, sf, "embeddings").select("vec_id", V.equal_parts(F.col("embedding"), 4).alias("w"))
    i, j = F.posexplode("w").alias("i", "a"), F.explode("later").alias("b")
    pairs = cut.select("vec_id", "w", i).select("vec_id", "a", F.slice("w", F.col("i") + 2, 4).alias("later")).select("vec_id", "a", j)
    return pairs.groupBy("vec_id").agg(F.round(F.median(V.cosine_or_zero(F.col("a"), F.col("b"))), 6).alias("consistency"), F.count("*").alias("pairs"))


@query("V31", """SELECT s AS step, round(CASE WHEN s < 50 THEN 0.001 * (s + 1) / 50.0 ELSE 0.001 * 0.5 * (1 + cos(least(greatest((s - 50) / 450.0, 0), 1) * pi())) END, 9) AS rate FROM range(0, 600) t(s)""")
def lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(600).select(F.col("id").alias("step"), F.round(V.learning_rate(F.col("id"), 0.001, 50, 500), 9).alias("rate"))


@query("W15 W17", """WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS d FROM events)
SELECT user_id, round(avg(CASE WHEN u <= 5 THEN value END), 6) AS first_mean, round(avg(CASE WHEN d <= 5 THEN value END), 6) AS last_mean, avg(CASE WHEN d <= 5 THEN value END) < avg(CASE WHEN u <= 5 THEN value END) AS decreased FROM r GROUP BY user_id""")
def loss_trend(spark: SparkSession, sf: str) -> DataFrame:
    ends = sequences.ends_compared(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 5)
    return ends.select("user_id", F.round("first_mean", 6).alias("first_mean"), F.round("last_mean", 6).alias("last_mean"), "decreased")


@query("A14", f"WITH {_NEIGHBOURS} SELECT label, round(avg(CASE WHEN abs(e[1] - r[1]) <= 1e-6 THEN 0.5 WHEN e[1] > r[1] THEN 1.0 ELSE 0.0 END), 6) AS choice_accuracy FROM nb GROUP BY label")
def swap_choice_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.get("e", F.lit(0)).cast("double"), F.get("r", F.lit(0)).cast("double")
    return _neighbours(spark, sf).groupBy("label").agg(F.round(metrics.choice_accuracy(a, b), 6).alias("choice_accuracy"))


@query("W16", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) ORDER BY r, source LIMIT 50")
def round_robin_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.round_robin(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 50)


@query("W17", "SELECT user_id, arg_max(event_type, event_id) AS last_type, max(event_id) AS last_id FROM events GROUP BY user_id")
def final_record(spark: SparkSession, sf: str) -> DataFrame:
    last = sequences.last_record(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], F.col("event_id"))
    return last.select("user_id", F.col("event_type").alias("last_type"), F.col("event_id").alias("last_id"))


