"""Queries on thresholds, policies and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import calibrate, metrics, policy
from ..workspace import table
from . import views
from .catalog import query

THRESHOLDS = [round(0.05 * i, 2) for i in range(-4, 20)]
_TH = f"th AS (SELECT unnest({THRESHOLDS}) AS threshold)"
_SWEEP = f"""{views.TRIALS}, {_TH}, sw AS (SELECT threshold, count(*) FILTER (split = 'pos') AS positives, count(*) FILTER (split = 'neg') AS negatives, count(*) FILTER (split = 'pos' AND sim >= threshold) AS true_accepts, count(*) FILTER (split = 'neg' AND sim >= threshold) AS false_accepts FROM trials, th GROUP BY threshold),
rates AS (SELECT *, 1 - true_accepts / greatest(positives, 1) AS frr, false_accepts / greatest(negatives, 1) AS far FROM sw)"""


def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    return policy.sweep(views.trials(spark, sf), policy.grid(spark, "threshold", THRESHOLDS), "sim", F.col("split") == "pos")


@query("D2 A3", f"WITH {_SWEEP} SELECT threshold, true_accepts, false_accepts, round(frr, 6) AS frr, round(far, 6) AS far FROM rates")
def frr_far_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _sweep(spark, sf).select("threshold", "true_accepts", "false_accepts", F.round("frr", 6).alias("frr"), F.round("far", 6).alias("far"))


@query("D1 V32", f"""WITH {views.TRIALS}, r AS (SELECT round(sim, 4) AS sim, split FROM trials), f AS (SELECT min(sim) AS lo, max(sim) AS hi FROM r), c AS (SELECT i, lo + i * 0.01 AS threshold FROM f, range(0, 400) t(i) WHERE i <= floor((hi - lo) / 0.01 + 1 + 1e-9)),
e AS (SELECT i, threshold, count(*) FILTER ((split = 'pos' AND sim < threshold) OR (split = 'neg' AND sim >= threshold)) AS errors FROM r, c GROUP BY i, threshold)
SELECT round(threshold, 3) AS threshold, errors FROM e ORDER BY errors, i LIMIT 1""")
def eer_threshold_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.trials(spark, sf).withColumn("sim", F.round("sim", 4))
    return policy.equal_error_threshold(rows, "sim", F.col("split") == "pos")


@query("O2 D11 D12", f"WITH {_SWEEP} SELECT threshold, round(frr, 6) AS frr, round(1 - far, 6) AS rr, round(40 * (1 - frr) + 40 * (1 - far), 4) AS score_80 FROM rates WHERE 1 - far >= 0.9 ORDER BY 40 * (1 - frr) + 40 * (1 - far) DESC, 1 - far DESC, threshold LIMIT 1")
def search_best_threshold_constrained(spark: SparkSession, sf: str) -> DataFrame:
    swept = _sweep(spark, sf).withColumn("rr", 1 - F.col("far")).withColumn("score", policy.objective_80(F.col("frr"), F.col("rr")))
    best = policy.best_feasible(swept, "score", F.col("rr") >= 0.9, [F.col("score"), F.col("rr")], "threshold_ord")
    return best.select("threshold", F.round("frr", 6).alias("frr"), F.round("rr", 6).alias("rr"), F.round("score", 4).alias("score_80"))


# Trials beside the text pairs of the same number: a recognised command for each trial.
_ITEMS = f"""{views.TRIALS}, {views.PAIRS}, items AS (SELECT t.vec_id, t.split, round(t.sim, 4) AS sim, p.ref, p.hyp, CAST(length(p.ref) AS BIGINT) AS n, CAST(levenshtein(p.ref, p.hyp) AS BIGINT) AS raw_err,
  CAST(levenshtein(p.ref, p.hyp) // 2 AS BIGINT) AS fixed_err, round(CAST(levenshtein(p.ref, p.hyp) AS DOUBLE) / greatest(length(p.ref), length(p.hyp)), 4) AS intent_dist FROM trials t JOIN pairs p ON p.id = t.vec_id)"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.trials(spark, sf).join(views.pairs(spark, sf).select(F.col("id").alias("vec_id"), "ref", "hyp"), "vec_id")
    d, longer = F.levenshtein("ref", "hyp"), F.greatest(F.length("ref"), F.length("hyp"))
    return rows.select("vec_id", "split", F.round("sim", 4).alias("sim"), "ref", "hyp", F.length("ref").cast("long").alias("n"), d.cast("long").alias("raw_err"), F.floor(d / 2).cast("long").alias("fixed_err"), F.round(d / longer, 4).alias("intent_dist"))


_RATES = "round(CAST(sum(CASE WHEN split = 'pos' THEN CASE WHEN ok THEN raw_err ELSE n END ELSE 0 END) AS DOUBLE) / sum(CASE WHEN split = 'pos' THEN n ELSE 0 END), 6) AS cer, round(count(*) FILTER (split = 'neg' AND NOT ok) / greatest(count(*) FILTER (split = 'neg'), 1), 6) AS rr"


@query("D3", f"WITH {_ITEMS}, {_TH}, x AS (SELECT *, sim - 0.7 * intent_dist >= threshold AS ok FROM items, th) SELECT threshold, {_RATES} FROM x GROUP BY threshold")
def fusion_sweep(spark: SparkSession, sf: str) -> DataFrame:
    place = policy.reached(policy.fusion(F.col("sim"), F.col("intent_dist")), F.array(*map(F.lit, THRESHOLDS)))
    rows = _items(spark, sf).groupBy(place.alias("place"), "split").agg(F.sum("n").alias("n"), F.sum("raw_err").alias("e"), F.count("*").alias("k"))
    met = rows.crossJoin(F.broadcast(policy.grid(spark, "threshold", THRESHOLDS)))
    return _rates(met, F.col("place") > F.col("threshold_ord"), ["threshold"])


def _rates(met: DataFrame, ok, keys: list[str]) -> DataFrame:
    pos, neg = F.col("split") == "pos", F.col("split") == "neg"
    tally = lambda cond, what: F.sum(F.when(cond, what).otherwise(0))
    cer = tally(pos, F.when(ok, F.col("e")).otherwise(F.col("n"))) / tally(pos, F.col("n"))
    return met.groupBy(*keys).agg(F.round(cer, 6).alias("cer"), F.round(tally(neg & ~ok, F.col("k")) / F.greatest(tally(neg, F.col("k")), F.lit(1)), 6).alias("rr"))


@query("D4", f"WITH {_ITEMS}, x AS (SELECT *, sim >= sv AND intent_dist <= it AS ok FROM items, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]) AS sv), (SELECT unnest([0.3, 0.5, 0.7, 0.9]) AS it)) SELECT sv, it AS intent, {_RATES} FROM x GROUP BY sv, it")
def policy_simulation(spark: SparkSession, sf: str) -> DataFrame:
    sv, intent = [i / 10 for i in range(1, 9)], [0.3, 0.5, 0.7, 0.9]
    places = policy.reached(F.col("sim"), F.array(*map(F.lit, sv))).alias("s"), policy.exceeded(F.col("intent_dist"), F.array(*map(F.lit, intent))).alias("i")
    facts = _items(spark, sf).groupBy("split", *places).agg(F.sum("n").alias("n"), F.sum("raw_err").alias("e"), F.count("*").alias("k"))
    combos = policy.grid(spark, "sv", sv).crossJoin(policy.grid(spark, "intent", intent))
    return _rates(facts.crossJoin(F.broadcast(combos)), (F.col("s") > F.col("sv_ord")) & (F.col("i") <= F.col("intent_ord")), ["sv", "intent"])


SV, PHRASE, INTENT = [round(0.05 * i, 2) for i in range(2, 12)], [0.2, 0.3, 0.4, 0.5, 0.6, 0.7], [0.5, 0.8]
_GRID = f"""{_ITEMS}, c AS (SELECT (si * 7 + pi_) * 3 + ii AS combo, sv, phrase, intent FROM (SELECT unnest(range(0, 10)) AS si, unnest({SV}) AS sv), (SELECT unnest(range(0, 7)) AS pi_, unnest([NULL, {str(PHRASE)[1:-1]}]) AS phrase), (SELECT unnest(range(0, 3)) AS ii, unnest([NULL, {str(INTENT)[1:-1]}]) AS intent)),
x AS (SELECT *, sim >= sv AND (intent IS NULL OR intent_dist <= intent) AS ok FROM items, c),
g AS (SELECT combo, sv, phrase, intent, CAST(sum(CASE WHEN split <> 'pos' THEN 0 WHEN NOT ok THEN n WHEN phrase IS NOT NULL AND intent_dist <= phrase THEN fixed_err ELSE raw_err END) AS DOUBLE) / sum(CASE WHEN split = 'pos' THEN n ELSE 0 END) AS cer,
  count(*) FILTER (split = 'pos' AND ok) / greatest(count(*) FILTER (split = 'pos'), 1) AS acc, count(*) FILTER (split = 'neg' AND NOT ok) / greatest(count(*) FILTER (split = 'neg'), 1) AS rr FROM x GROUP BY combo, sv, phrase, intent)"""


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    return policy.evaluate_grid(_items(spark, sf), policy.policy_grid(spark, SV, PHRASE, INTENT))


@query("U7 D5", f"WITH {_GRID} SELECT CAST(combo AS BIGINT) AS combo, CAST(sv AS DOUBLE) AS sv, CAST(phrase AS DOUBLE) AS phrase, CAST(intent AS DOUBLE) AS intent, round(cer, 6) AS pos_corpus_cer, round(acc, 6) AS pos_accept_rate, round(rr, 6) AS neg_rr, round((1 - cer) * rr, 6) AS balanced_score FROM g")
def policy_grid(spark: SparkSession, sf: str) -> DataFrame:
    out = _grid(spark, sf)
    return out.select(F.col("combo").cast("long").alias("combo"), "sv", "phrase", "intent", *[F.round(c, 6).alias(c) for c in ("pos_corpus_cer", "pos_accept_rate", "neg_rr", "balanced_score")])


@query("O1", f"""WITH {_GRID}, r AS (SELECT 'balanced' AS ranking, combo, row_number() OVER (ORDER BY round((1 - cer) * rr, 9) DESC, combo) AS place FROM g UNION ALL SELECT 'cer', combo, row_number() OVER (ORDER BY round(cer, 9), combo) FROM g
UNION ALL SELECT 'constrained', combo, row_number() OVER (ORDER BY round(cer, 9), combo) FROM g WHERE rr >= 0.85) SELECT ranking, place, CAST(combo AS BIGINT) AS combo FROM r WHERE place <= 5""")
def grid_rankings(spark: SparkSession, sf: str) -> DataFrame:
    rounded = _grid(spark, sf).withColumns({c: F.round(c, 9) for c in ("pos_corpus_cer", "balanced_score")})
    return policy.rankings(rounded).select("ranking", F.col("place").cast("long").alias("place"), F.col("combo").cast("long").alias("combo"))


@query("trap2 D22", f"""WITH {views.TRIALS}, x AS (SELECT vec_id, split, sim >= 0.5 AS ok, CASE WHEN vec_id % 4 = 0 THEN ' ' WHEN vec_id % 4 = 1 THEN '' ELSE 'go' END AS text, CASE WHEN sim < 0.5 THEN 'NOT_EMITTED' WHEN vec_id % 5 = 0 THEN 'ERROR' ELSE 'OK' END AS status FROM trials)
SELECT split, count(*) FILTER (trim(text) = '') AS blank, count(*) FILTER (NOT ok OR trim(text) = '') AS stripped, count(*) FILTER (NOT ok) AS accepted, count(*) FILTER (status = 'NOT_EMITTED' OR (status = 'OK' AND trim(text) = '')) AS by_status FROM x GROUP BY split""")
def rejection_variants(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("vec_id") % 4 == 0, " ").when(F.col("vec_id") % 4 == 1, "").otherwise("go")
    status = F.when(F.col("sim") < 0.5, "NOT_EMITTED").when(F.col("vec_id") % 5 == 0, "ERROR").otherwise("OK")
    ok = F.col("sim") >= 0.5
    rules = {"blank": "blank", "stripped": "stripped", "accepted": "accepted", "by_status": "status"}
    return views.trials(spark, sf).groupBy("split").agg(*[F.count_if(metrics.rejected(ok, text, r, status)).alias(k) for k, r in rules.items()])


_FEATURES = f"""{_ITEMS}, ft AS (SELECT vec_id, split, sim, intent_dist AS it, sim - 0.7 * intent_dist AS fusion_score, least(length(replace(hyp, ' ', '')) / 20.0, 2.0) AS hyp_len_norm, CASE WHEN intent_dist <= 0.5 THEN 1.0 ELSE 0.0 END AS known_phrase,
  (1 - intent_dist) * sim AS sim_x_intent, CASE WHEN sim < 0.15 THEN 1.0 ELSE 0.0 END AS low_sim_flag, CASE WHEN sim >= 0.5 THEN 1.0 ELSE 0.0 END AS high_sim_flag FROM items)"""


@query("D7", f"WITH {_FEATURES} SELECT vec_id, split, round(fusion_score, 6) AS fusion_score, round(hyp_len_norm, 6) AS hyp_len_norm, known_phrase, round(sim_x_intent, 6) AS sim_x_intent, low_sim_flag, high_sim_flag FROM ft")
def gate_features(spark: SparkSession, sf: str) -> DataFrame:
    f = policy.gate_features(F.col("sim"), F.col("hyp"), F.col("intent_dist"))
    return _items(spark, sf).select("vec_id", "split", *[F.round(f[k], 6).alias(k) for k in ("fusion_score", "hyp_len_norm", "known_phrase", "sim_x_intent", "low_sim_flag", "high_sim_flag")])


MODEL = {"feature_names": ["speaker_similarity", "intent_distance", "hyp_len_norm"], "feature_mean": [0.4, 0.6, 0.5], "feature_scale": [0.3, 0.0, 0.2], "weights": [2.0, -1.0, 0.5], "bias": 0.1, "threshold": 0.5}


@query("D8 V5", f"WITH {_FEATURES}, z AS (SELECT vec_id, split, 0.1 + (sim - 0.4) / 0.3 * 2.0 + (it - 0.6) * -1.0 + (hyp_len_norm - 0.5) / 0.2 * 0.5 AS z FROM ft) SELECT vec_id, split, round(1 / (1 + exp(-z)), 6) AS probability, 1 / (1 + exp(-z)) >= 0.5 AS accepted FROM z")
def gate_score(spark: SparkSession, sf: str) -> DataFrame:
    p = policy.gate_probability(policy.gate_features(F.col("sim"), F.col("hyp"), F.col("intent_dist")), MODEL)
    return _items(spark, sf).select("vec_id", "split", F.round(p, 6).alias("probability"), (p >= MODEL["threshold"]).alias("accepted"))


@query("D9 D10")
def gate_training(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on the rows that a hash puts into the training side, evaluated on both; gradient descent has no SQL."""
    rows = _items(spark, sf)
    f = policy.gate_features(F.col("sim"), F.col("hyp"), F.col("intent_dist"))
    names = ["speaker_similarity", "intent_distance", "hyp_len_norm"]
    data = rows.select("split", (F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0).alias("dev"), *[F.round(f[n], 6).alias(n) for n in names], (F.col("split") == "pos").cast("int").alias("y"))
    model = calibrate.fit_gate(data.filter("NOT dev"), names, "y", epochs=400)
    p = policy.gate_probability({n: F.col(n) for n in names}, model)
    return data.groupBy("dev", "split").agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("mean_probability"), F.round(metrics.rate(p >= 0.5), 6).alias("accept_rate"))


@query("A21", """WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem) SELECT l_returnflag, round(sum((l_quantity - m) / d), 4) AS z_sum, round(sum(((l_quantity - m) / d) * ((l_quantity - m) / d)), 4) AS z_square FROM lineitem, s GROUP BY l_returnflag""")
def standardize_popstd(spark: SparkSession, sf: str) -> DataFrame:
    z = metrics.standardized(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity"), ["l_quantity"])
    return z.groupBy("l_returnflag").agg(F.round(F.sum("l_quantity_z"), 4).alias("z_sum"), F.round(F.sum(F.col("l_quantity_z") * F.col("l_quantity_z")), 4).alias("z_square"))


@query("A22", """WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events), m AS (SELECT median(v) AS m FROM e WHERE event_id % 5 <> 0)
SELECT event_type, round(avg(coalesce(v, m)), 6) AS mean, count(*) FILTER (v IS NULL) AS missing FROM e, m GROUP BY event_type""")
def impute_missing_median(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    filled = metrics.imputed(rows, ["v"], F.col("event_id") % 5 != 0)
    return filled.groupBy("event_type").agg(F.round(F.avg("v"), 6).alias("mean"), F.sum("v_missing").cast("long").alias("missing"))


@query("A20 A23", """WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality) SELECT l.quality, round(sum(0.5 / n), 6) AS total_weight, round(sum(toxic * (0.5 / n)) / sum(0.5 / n), 6) AS toxic_share FROM labels l JOIN n ON n.quality = l.quality GROUP BY l.quality""")
def class_balanced_weights(spark: SparkSession, sf: str) -> DataFrame:
    weighed = metrics.class_weights(table(spark, sf, "labels"), "quality")
    return weighed.groupBy("quality").agg(F.round(F.sum("weight"), 6).alias("total_weight"), F.round(metrics.weighted_mean(F.col("toxic"), F.col("weight")), 6).alias("toxic_share"))


@query("D13 V6", f"WITH {views.TRIALS} SELECT vec_id, split, round(ln(least(greatest(1 / (1 + exp(-(4 * sim - 2))), 1e-6), 1 - 1e-6) / (1 - least(greatest(1 / (1 + exp(-(4 * sim - 2))), 1e-6), 1 - 1e-6))), 5) AS llr FROM trials")
def calibrated_llr(spark: SparkSession, sf: str) -> DataFrame:
    p = calibrate.probability({"intercept": -2.0, "features": ["sim"], "weights": [4.0]})
    return views.trials(spark, sf).select("vec_id", "split", F.round(calibrate.log_likelihood_ratio(p), 5).alias("llr"))


@query("D13")
def calibrator_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Newton's method over distributed sums; an iteration has no SQL."""
    rows = views.trials(spark, sf).select(F.round("sim", 6).alias("sim"), (F.col("split") == "pos").cast("int").alias("y"))
    model = calibrate.fit_irls(rows, ["sim"], "y")
    return rows.groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg(calibrate.probability(model)), 5).alias("mean_probability"))


@query("V7", "SELECT event_id, round(least(greatest(value * 0.1, 0.3), 3.0), 6) AS duration FROM events")
def adaptive_duration(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(V.adaptive_duration(F.col("value")), 6).alias("duration"))
