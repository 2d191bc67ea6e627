"""Queries on rule engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..workspace import table
from . import views
from .catalog import query

# Evidence columns derived from events: every rule is met by some rows.
_EVIDENCE = """ev AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE (event_id % 10) / 10.0 END AS q_enroll, least(value / 100, 1) AS activity_mean, (event_id % 13) / 13.0 * 1.2 - 0.1 AS s_tgt, CASE WHEN event_id % 3 = 0 THEN 0.002 ELSE (event_id % 11) / 50.0 END AS energy_ratio,
  (event_id % 7) / 7.0 AS s_res, (event_id % 13) / 13.0 * 1.2 - 0.1 - (event_id % 7) / 7.0 AS delta_s, event_id % 17 <> 0 AS valid_tgt_sv, event_id % 5 <> 0 AS valid_res_sv, event_id % 17 <> 0 AND event_id % 5 <> 0 AS valid_delta, event_id % 6 <> 0 AS window_consistent, event_id % 4 + 1 AS window_count, event_id % 3 AS valid_window_count FROM events)"""
_AUDIT = f"""{_EVIDENCE}, f AS (SELECT *, activity_mean >= 0.7 AS hi, activity_mean < 0.3 AS lo, energy_ratio >= 0.05 AS loud, energy_ratio < 0.01 AS quiet, coalesce(q_enroll >= 0.3, false) AS good,
  valid_tgt_sv AND window_consistent AND s_tgt >= 0.5 AND (NOT valid_res_sv OR (s_res <= 0.2 AND valid_delta AND delta_s >= 0.3)) AS ident, valid_delta AND s_tgt <= 0.2 AND s_res >= 0.4 AND delta_s <= -0.1 AS mis FROM ev),
g AS (SELECT *, list_filter([CASE WHEN quiet AND s_tgt >= 0.5 THEN 'LOW_ENERGY_HIGH_COSINE' END, CASE WHEN (hi AND quiet) OR (lo AND loud) THEN 'EVIDENCE_CONFLICT' END, CASE WHEN NOT good THEN 'ENROLLMENT_LOW_QUALITY' END, CASE WHEN s_tgt >= 0.5 AND s_res >= 0.4 THEN 'TGT_RES_BOTH_HIGH' END,
  CASE WHEN valid_tgt_sv AND window_count >= 2 AND NOT window_consistent THEN 'MULTIWINDOW_INCONSISTENT' END, CASE WHEN valid_window_count = 1 AND window_count > 1 AND s_tgt >= 0.5 THEN 'SINGLE_SHORT_HIGH_WINDOW' END, CASE WHEN NOT valid_res_sv AND valid_tgt_sv AND NOT ident THEN 'INSUFFICIENT_RESIDUAL_EVIDENCE' END,
  CASE WHEN NOT valid_tgt_sv AND NOT lo THEN 'TGT_SV_INVALID_ACTIVITY_PRESENT' END], lambda x: x IS NOT NULL) AS doubts FROM f),
a AS (SELECT *, CASE WHEN q_enroll IS NULL THEN 'ERROR' WHEN len(doubts) = 0 AND ((lo AND quiet) OR (hi AND loud AND good AND mis)) THEN 'EMPTY' WHEN len(doubts) = 0 AND hi AND loud AND good AND ident THEN 'PRESENT' ELSE 'GRAY' END AS audit_state,
  CASE WHEN q_enroll IS NOT NULL AND valid_tgt_sv THEN greatest(0, least(1, q_enroll * (s_tgt + 1) / 2)) END AS identity_score FROM g)"""


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    s_tgt, s_res = i % 13 / 13.0 * 1.2 - 0.1, i % 7 / 7.0
    return table(spark, sf, "events").select(
        "event_id", F.when(i % 97 != 0, (i % 10) / 10.0).alias("q_enroll"), F.least(F.col("value") / 100, F.lit(1.0)).alias("activity_mean"), s_tgt.alias("s_tgt"), F.when(i % 3 == 0, 0.002).otherwise(i % 11 / 50.0).alias("energy_ratio"),
        s_res.alias("s_res"), (s_tgt - s_res).alias("delta_s"), (i % 17 != 0).alias("valid_tgt_sv"), (i % 5 != 0).alias("valid_res_sv"), ((i % 17 != 0) & (i % 5 != 0)).alias("valid_delta"), (i % 6 != 0).alias("window_consistent"), (i % 4 + 1).alias("window_count"), (i % 3).alias("valid_window_count"),
    )


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf).withColumn("a", audit.three_state()).select("*", "a.*")


@query("D14 D15", f"""WITH {_AUDIT} SELECT event_id, audit_state, CASE audit_state WHEN 'PRESENT' THEN 'EMIT' WHEN 'GRAY' THEN 'GRAY' ELSE 'EMPTY' END AS final_action, round(identity_score, 6) AS identity_score,
CASE WHEN audit_state = 'GRAY' THEN array_to_string(doubts, ',') ELSE '' END AS doubts FROM a""")
def three_state_audit(spark: SparkSession, sf: str) -> DataFrame:
    codes = F.col("reason_codes")
    doubts = F.when(F.col("audit_state") == "GRAY", F.array_join(F.slice(codes, 1, F.greatest(F.size(codes) - 5, F.lit(0))), ",")).otherwise("")
    return _audited(spark, sf).select("event_id", "audit_state", "final_action", F.round("identity_score", 6).alias("identity_score"), doubts.alias("doubts"))


_TEXT = "CASE WHEN event_id % 9 = 0 THEN ' ' WHEN event_id % 10 = 0 THEN NULL ELSE event_type END"


@query("D17", f"""WITH {_AUDIT}, r AS (SELECT event_id, CASE WHEN audit_state <> 'GRAY' THEN 'NOT_GRAY_STATE' WHEN trim(coalesce({_TEXT.replace('event_type', "'x'")}, '')) = '' THEN 'ASR_EMPTY' WHEN identity_score IS NULL THEN 'IDENTITY_SCORE_MISSING' WHEN identity_score < 0.5 THEN 'IDENTITY_BELOW_FLOOR' WHEN identity_score = 0.5 THEN 'IDENTITY_AT_FLOOR_EQUALITY' ELSE 'IDENTITY_ABOVE_FLOOR' END AS reason FROM a)
SELECT event_id, CASE WHEN reason = 'IDENTITY_ABOVE_FLOOR' THEN 'EMIT' ELSE 'EMPTY' END AS action, reason FROM r""")
def gray_decision(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("event_id") % 9 == 0, " ").when(F.col("event_id") % 10 == 0, None).otherwise("x")
    return _audited(spark, sf).withColumn("asr_text", text).withColumn("c", audit.open_case()).select("event_id", "c.*")


@query("D18", f"""WITH {_AUDIT}, b AS (SELECT *, CASE WHEN event_id % 19 <> 0 THEN event_id % 8 END AS d_hat, event_id % 30 AS l_hat FROM a), c AS (SELECT *, greatest(0, least(l_hat - d_hat, 100.0)) AS benefit FROM b),
r AS (SELECT event_id, CASE WHEN audit_state <> 'GRAY' THEN 'NOT_GRAY_STATE' WHEN identity_score IS NULL THEN 'IDENTITY_SCORE_MISSING' WHEN identity_score < 0.5 THEN 'IDENTITY_BELOW_FLOOR' WHEN d_hat IS NULL THEN 'CHARACTER_MODEL_UNAVAILABLE' WHEN benefit <= 0 THEN 'CHARACTER_BENEFIT_NONPOSITIVE'
  WHEN identity_score > greatest(0.5, 5.0 / benefit) THEN 'IDENTITY_ABOVE_CHAR_COST_THRESHOLD' ELSE 'IDENTITY_BELOW_CHAR_COST_THRESHOLD' END AS reason FROM c)
SELECT event_id, CASE WHEN reason = 'IDENTITY_ABOVE_CHAR_COST_THRESHOLD' THEN 'EMIT' ELSE 'EMPTY' END AS action, reason FROM r""")
def gray_char_cost(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    rows = _audited(spark, sf).withColumns({"asr_text": F.lit("x"), "d_hat": F.when(i % 19 != 0, (i % 8).cast("double")), "l_hat": (i % 30).cast("double")})
    return rows.withColumn("c", audit.open_case_with_cost()).select("event_id", "c.*")


@query("D20", f"""WITH {views.TRIALS}, x AS (SELECT vec_id, split, sim, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE (vec_id % 10) / 12.0 END AS res, (vec_id % 7) / 20.0 AS spread FROM trials),
r AS (SELECT vec_id, split, CASE WHEN sim >= 0.35 AND coalesce(res >= 0.4, false) THEN 'GRAY_EVIDENCE_CONFLICT' WHEN sim >= 0.35 AND spread > 0.25 THEN 'GRAY_LOW_SNR_AMBIGUOUS' WHEN sim >= 0.35 THEN 'TARGET_PRESENT_HIGH_CONF' WHEN sim < 0.18 THEN 'TARGET_ABSENT_LOW_SIM' WHEN coalesce(res > sim + 0.15, false) THEN 'TARGET_LEAKED_TO_RESIDUAL' ELSE 'GRAY_LOW_SNR_AMBIGUOUS' END AS reason FROM x)
SELECT vec_id, split, CASE WHEN reason = 'TARGET_PRESENT_HIGH_CONF' THEN 'PRESENT' WHEN reason IN ('TARGET_ABSENT_LOW_SIM', 'TARGET_LEAKED_TO_RESIDUAL') THEN 'EMPTY' ELSE 'GRAY' END AS state, reason FROM r""")
def legacy_audit(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("vec_id")
    state = audit.legacy_state(F.col("sim"), F.when(i % 3 != 0, i % 10 / 12.0), i % 7 / 20.0)
    return views.trials(spark, sf).withColumn("s", state).select("vec_id", "split", "s.*")


@query("D27", """SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 'EMPTY' WHEN length(text) / 1000.0 < 0.5 THEN 'TOO_SHORT' WHEN length(text) / 1000.0 > 30 THEN 'TOO_LONG' ELSE 'OK' END AS status, CASE WHEN source = 'src0' THEN 'DOWNMIX' ELSE '' END AS notes FROM documents""")
def input_validity_cascade(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    state = audit.input_state(n, F.lit(True), F.when(F.col("source") == "src0", 2).otherwise(1), F.lit(16_000), n / 1000.0, F.lit(1.0))
    return table(spark, sf, "documents").withColumn("s", state).select("doc_id", "s.status", F.array_join("s.notes", ",").alias("notes"))
