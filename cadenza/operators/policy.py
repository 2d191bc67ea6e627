"""Thresholds, sweeps, grids and accept/reject gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize
from ..functions.vectors import sigmoid

# The names of features in published models.
BASIC_FEATURES = ["speaker_similarity", "intent_distance", "fusion_score", "hyp_len_norm", "has_hyp", "known_phrase", "very_short_hyp"]
EXTENDED_FEATURES = [*BASIC_FEATURES, "intent_perfect", "intent_near", "sim_x_intent", "low_sim_flag", "high_sim_flag", "perfect_x_sim"]


def grid(spark: SparkSession, name: str, values: list[float]) -> DataFrame:
    """A literal table (ord, value); its size is that of the argument."""
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, values))).alias(f"{name}_ord", name))


def reached(value: Column, marks: Column) -> Column:
    """How many of the marks (an array) a value reaches; 0 for null.  Ascending marks up to that place accept it."""
    return F.size(F.filter(marks, lambda m: m <= value))


def exceeded(value: Column, marks: Column) -> Column:
    """How many of the marks a value lies above; all and one more for null.  Ascending marks after that place admit it."""
    return F.when(value.isNull(), F.size(marks) + 1).otherwise(F.size(F.filter(marks, lambda m: m < value)))


def _marks(table: DataFrame, *names: str) -> DataFrame:
    """One row: the distinct values of each column of a literal table, ascending, as ``_{name}s``."""
    return table.agg(*[F.array_sort(F.collect_set(n)).alias(f"_{n}s") for n in names])


def _place(name: str) -> Column:
    return F.array_position(f"_{name}s", F.col(name))


def sweep(rows: DataFrame, thresholds: DataFrame, score: str, positive: Column) -> DataFrame:
    """For each threshold (bounded literal table) FRR, FAR and their parts; accepted is score >= threshold.

    Rows are first counted by the thresholds that they reach, so that what meets the table is no larger than the table."""
    marks = F.broadcast(_marks(thresholds, "threshold"))
    slots = rows.crossJoin(marks).groupBy(reached(F.col(score), F.col("_thresholds")).alias("_slot")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    hit = F.col("_slot") >= F.col("_place")
    places = thresholds.crossJoin(marks).withColumn("_place", _place("threshold")).drop("_thresholds")
    got = slots.crossJoin(F.broadcast(places)).groupBy("threshold_ord", "threshold").agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("true_accepts"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("false_accepts")
    )
    return got.withColumns({"frr": 1 - F.col("true_accepts") / F.greatest("positives", F.lit(1)), "far": F.col("false_accepts") / F.greatest("negatives", F.lit(1))})


def equal_error_threshold(rows: DataFrame, score: str, positive: Column, step: float = 0.01) -> DataFrame:
    """The first threshold, from the least score in steps, at which false rejects plus false accepts are fewest.

    Rows are counted by their step.  Errors change only after a step that has rows, so candidates are those: no more than
    there are steps between the least and the largest score, whatever the number of rows.  A null score is never accepted."""
    facts = rows.agg(F.min(score).alias("_lo"))
    at = lambda i: F.col("_lo") + i * step
    near = F.floor((F.col(score) - F.col("_lo")) / step)
    slot = F.when(at(near + 1) <= F.col(score), near + 1).when(at(near) > F.col(score), near - 1).otherwise(near)
    slots = rows.crossJoin(F.broadcast(facts)).groupBy("_lo", F.coalesce(slot, F.lit(-1)).alias("_slot")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    start = rows.agg(F.min(score).alias("_lo"), F.lit(-1).cast("bigint").alias("_slot"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg"))
    upto = Window.orderBy("_slot").rangeBetween(Window.unboundedPreceding, 0)
    later = Window.orderBy("_slot").rangeBetween(1, Window.unboundedFollowing)
    errors = slots.unionByName(start).withColumn("errors", F.sum("pos").over(upto) + F.coalesce(F.sum("neg").over(later), F.lit(0))).withColumn("ord", F.col("_slot") + 1)
    return errors.agg(F.min_by(F.struct(at(F.col("ord")).alias("threshold"), "errors"), F.struct("errors", "ord")).alias("b")).select(F.round("b.threshold", 3).alias("threshold"), F.col("b.errors").alias("errors"))


def best_feasible(table: DataFrame, score: str, feasible: Column, keys: list[Column], order: str) -> DataFrame:
    """The row of largest (keys...), first in ``order`` among equals, of the feasible rows; of all if none is."""
    ranked = table.withColumn("_ok", F.coalesce(feasible, F.lit(False)).cast("int")).withColumn("_any", F.max("_ok").over(Window.partitionBy(F.lit(1))))
    pool = ranked.filter((F.col("_ok") == 1) | (F.col("_any") == 0))
    return pool.orderBy(*[k.desc() for k in keys], order).limit(1).drop("_ok", "_any")


def objective_80(cer: Column, rr: Column) -> Column:
    return 40 * (1 - cer) + 40 * rr


def objective_80_clamped(cer: Column, rr: Column) -> Column:
    return 80 * (0.6 * F.greatest(F.lit(0.0), 1 - cer) + 0.4 * rr)


def policy_grid(spark: SparkSession, sv: list[float], phrase: list[float], intent: list[float]) -> DataFrame:
    """sv x (no correction or a phrase threshold) x (no filter or an intent threshold), in that order of nesting."""
    sv_, ph, it = grid(spark, "sv", sv), grid(spark, "phrase", [None, *phrase] if phrase else [None]), grid(spark, "intent", [None, *intent] if intent else [None])
    out = sv_.crossJoin(ph).crossJoin(it).withColumn("combo", (F.col("sv_ord") * F.lit(len(phrase) + 1) + F.col("phrase_ord")) * F.lit(len(intent) + 1) + F.col("intent_ord"))
    return out.select("combo", "sv", F.col("phrase").cast("double").alias("phrase"), F.col("intent").cast("double").alias("intent"))


def evaluate_grid(rows: DataFrame, combos: DataFrame) -> DataFrame:
    """Corpus CER of positives, accept rate, RR and balanced score of every combination.

    ``rows``: split (pos/neg), sim, intent_dist, n, and errors of three texts fixed beforehand: raw_err, fixed_err (after
    phrase correction) and n itself for an empty text.  A combination sees of a row only which marks it reaches, so rows are
    summed by these places first: as many sums as the grid has cells, whatever the number of rows.  Null scores and
    distances reach nothing."""
    marks = F.broadcast(_marks(combos, "sv", "phrase", "intent"))
    places = {"_s": reached(F.col("sim"), F.col("_svs")), "_f": exceeded(F.col("intent_dist"), F.col("_phrases")), "_i": exceeded(F.col("intent_dist"), F.col("_intents"))}
    facts = rows.crossJoin(marks).groupBy("split", *[c.alias(k) for k, c in places.items()]).agg(F.count("*").alias("k"), *[F.sum(c).alias(c) for c in ("n", "raw_err", "fixed_err")])
    placed = combos.crossJoin(marks).select(*combos.columns, *[_place(c).alias(f"_{c}") for c in ("sv", "phrase", "intent")])
    accepted = (F.col("_s") >= F.col("_sv")) & (F.col("intent").isNull() | (F.col("_i") < F.col("_intent")))
    fixed = F.col("phrase").isNotNull() & (F.col("_f") < F.col("_phrase"))
    err = F.when(~accepted, F.col("n")).when(fixed, F.col("fixed_err")).otherwise(F.col("raw_err"))
    pos, neg = F.col("split") == "pos", F.col("split") == "neg"
    tally = lambda cond, what: F.sum(F.when(cond, what).otherwise(0))
    got = facts.crossJoin(F.broadcast(placed)).groupBy("combo", "sv", "phrase", "intent").agg(
        tally(pos, err).alias("_e"), tally(pos, F.col("n")).alias("_n"), tally(pos & accepted, F.col("k")).alias("_a"), tally(pos, F.col("k")).alias("_p"), tally(neg & ~accepted, F.col("k")).alias("_r"), tally(neg, F.col("k")).alias("_g")
    )
    cer, rr = F.try_divide(F.col("_e"), F.col("_n")), F.col("_r") / F.greatest("_g", F.lit(1))
    return got.select("combo", "sv", "phrase", "intent", cer.alias("pos_corpus_cer"), (F.col("_a") / F.greatest("_p", F.lit(1))).alias("pos_accept_rate"), rr.alias("neg_rr"), ((1 - cer) * rr).alias("balanced_score"))


def rankings(table: DataFrame, k: int = 5, least_rr: float = 0.85) -> DataFrame:
    """Top k by balanced score, by CER, and by CER among those of enough RR; ties stay in grid order."""
    def top(name: str, frame: DataFrame, *order: Column) -> DataFrame:
        ranked = frame.orderBy(*order, "combo").limit(k)
        return ranked.select(F.lit(name).alias("ranking"), F.row_number().over(Window.orderBy(*order, "combo")).alias("place"), *table.columns)

    cer = F.col("pos_corpus_cer").asc()
    return top("balanced", table, F.desc("balanced_score")).unionByName(top("cer", table, cer)).unionByName(top("constrained", table.filter(F.col("neg_rr") >= least_rr), cer))


def threshold_table(measures: DataFrame, k: int = 10) -> DataFrame:
    """The k best of a sweep (threshold, score_80, rr), by score and then by rejection rate; equals by threshold."""
    return measures.orderBy(F.desc("score_80"), F.desc("rr"), "threshold").limit(k)


def top_policies(table: DataFrame, score: str, order: list[str], k: int = 12) -> DataFrame:
    """The k policies of the largest score; equals stay in the order of the grid."""
    return table.orderBy(F.desc(score), *order).limit(k)


def by_tuple(table: DataFrame, columns: list[str]) -> DataFrame:
    """Sorted by all columns, the largest first; nulls last."""
    return table.orderBy(*[F.desc_nulls_last(c) for c in columns])


def fusion(sim: Column, intent: Column, weight: float = 0.7) -> Column:
    return sim - weight * intent


def decision(sim: Column, intent: Column, *, threshold: float, fusion_weight: float | None = None, intent_limit: float | None = None, gate_probability: Column | None = None, gate_threshold: float = 0.5) -> Column:
    """One rule, in this order of priority: a trained gate, fusion (needs an intent filter), the intent filter, none."""
    if gate_probability is not None:
        return gate_probability >= gate_threshold
    if fusion_weight is not None and intent_limit is not None:
        return fusion(sim, intent, fusion_weight) >= threshold
    if intent_limit is not None:
        return (sim >= threshold) & (intent <= intent_limit)
    return sim >= threshold


def should_purify(sim: Column, trigger: float) -> Column:
    return sim <= trigger


def gate_features(sim: Column, hyp: Column, intent: Column, weight: float = 0.70) -> dict[str, Column]:
    s, t = F.coalesce(sim.cast("double"), F.lit(-1.0)), F.coalesce(intent.cast("double"), F.lit(1.0))
    n = F.length(normalize(F.coalesce(hyp, F.lit(""))))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    perfect = flag(t <= 0.10)
    return {
        "speaker_similarity": s, "intent_distance": t, "fusion_score": s - weight * t, "hyp_len_norm": F.least(n / 20.0, F.lit(2.0)), "has_hyp": flag(n > 0), "known_phrase": flag(t <= 0.50), "very_short_hyp": flag((n > 0) & (n <= 2)),
        "intent_perfect": perfect, "intent_near": flag(t <= 0.25), "sim_x_intent": (1 - t) * s, "low_sim_flag": flag(s < 0.15), "high_sim_flag": flag(s >= 0.50), "perfect_x_sim": perfect * s,
    }


def gate_probability(features: dict[str, Column], model: dict) -> Column:
    """Standardise (a scale of 0 counts as 1), weigh, squash.  A name the row lacks is 0."""
    names = model.get("feature_names", BASIC_FEATURES)
    means, scales = model.get("feature_mean", [0.0] * len(names)), model.get("feature_scale", [1.0] * len(names))
    z = F.lit(float(model.get("bias", 0.0)))
    for name, mean, scale, weight in zip(names, means, scales, model["weights"], strict=True):
        z = z + (features.get(name, F.lit(0.0)) - mean) / (scale or 1.0) * weight
    return sigmoid(z)
