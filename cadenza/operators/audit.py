"""Rule engines over evidence columns: three-state audit, decisions on open cases, input checks.

Rules are expressions built from a table of thresholds; a rule whose evidence is null does not hold."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import clip, logit


@dataclass(frozen=True)
class AuditThresholds:
    # Fixed values of the published rule table.
    activity_high: float = 0.7
    activity_low: float = 0.3
    energy_high: float = 0.05
    energy_low: float = 0.01
    target_high: float = 0.5
    target_low: float = 0.2
    residual_high: float = 0.4
    residual_low: float = 0.2
    delta_high: float = 0.3
    delta_low: float = -0.1
    least_quality: float = 0.3
    least_windows: int = 2

    @classmethod
    def of(cls, values: dict) -> AuditThresholds:
        """From a mapping; every name must be there, none may be unknown."""
        names = {f.name for f in fields(cls)}
        if set(values) != names:
            raise ValueError(f"thresholds: missing {sorted(names - set(values))}, unknown {sorted(set(values) - names)}")
        return cls(**values)


@dataclass(frozen=True)
class OpenCasePolicy:
    # Fixed values of the published policy.
    floor: float = 0.5
    most_benefit: float = 100.0
    kappa: float = 5.0


def _holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def identity_score(quality: Column, target: Column, target_ok: Column) -> Column:
    """Quality times the target score mapped to [0, 1]; null if there is no valid score."""
    return F.when(_holds(target_ok), clip(quality * (target + 1) / 2, 0.0, 1.0))


def three_state(t: AuditThresholds = AuditThresholds()) -> Column:  # noqa: B008
    """Struct of the audit over columns q_enroll, activity_mean, s_tgt, energy_ratio, s_res, delta_s, valid_tgt_sv,
    valid_res_sv, valid_delta, window_consistent, window_count, valid_window_count.

    Any reason for doubt stops both a rejection and an acceptance.  Order: absent, misrouted, present, open."""
    c = F.col
    high, low = c("activity_mean") >= t.activity_high, _holds(c("activity_mean") < t.activity_low)
    loud, quiet = c("energy_ratio") >= t.energy_high, _holds(c("energy_ratio") < t.energy_low)
    high, loud = _holds(high), _holds(loud)
    good = _holds(c("q_enroll") >= t.least_quality)
    tgt_ok, res_ok, delta_ok, steady = (_holds(c(x)) for x in ("valid_tgt_sv", "valid_res_sv", "valid_delta", "window_consistent"))
    tgt_high, res_high = _holds(c("s_tgt") >= t.target_high), _holds(c("s_res") >= t.residual_high)
    clean = _holds(c("s_res") <= t.residual_low) & delta_ok & _holds(c("delta_s") >= t.delta_high)
    identity = tgt_ok & steady & tgt_high & (~res_ok | clean)
    elsewhere = delta_ok & _holds(c("s_tgt") <= t.target_low) & res_high & _holds(c("delta_s") <= t.delta_low)
    doubts = {
        "LOW_ENERGY_HIGH_COSINE": quiet & tgt_high,
        "EVIDENCE_CONFLICT": (high & quiet) | (low & loud),
        "ENROLLMENT_LOW_QUALITY": ~good,
        "TGT_RES_BOTH_HIGH": tgt_high & res_high,
        "MULTIWINDOW_INCONSISTENT": tgt_ok & _holds(c("window_count") >= t.least_windows) & ~steady,
        "SINGLE_SHORT_HIGH_WINDOW": _holds(c("valid_window_count") == 1) & _holds(c("window_count") > 1) & tgt_high,
        "INSUFFICIENT_RESIDUAL_EVIDENCE": ~res_ok & tgt_ok & ~identity,
        "TGT_SV_INVALID_ACTIVITY_PRESENT": ~tgt_ok & ~low,
    }
    reasons = F.array_compact(F.array(*[F.when(cond, name) for name, cond in doubts.items()]))
    sure = F.size(reasons) == 0
    absent, misrouted = low & quiet & sure, high & loud & good & elsewhere & sure
    present = high & loud & good & identity & sure
    broken = c("q_enroll").isNull()
    state = F.when(broken, "ERROR").when(absent | misrouted, "EMPTY").when(present, "PRESENT").otherwise("GRAY")
    hard = ~broken & (absent | misrouted)
    lead = F.when(absent, F.array(F.lit("TARGET_ABSENT_ACTIVITY_ENERGY"))).when(misrouted, F.array(F.lit("TARGET_MISROUTED_TO_RESIDUAL"))).when(present, F.array(F.lit("TARGET_PRESENT_STRONG"))).otherwise(reasons)
    pick = lambda cond, yes, no: F.when(cond, yes).otherwise(no)
    detail = F.array(
        F.when(high, "ACTIVITY_HIGH").when(low, "ACTIVITY_LOW").otherwise("ACTIVITY_UNCERTAIN"), F.when(loud, "ENERGY_VALID").when(quiet, "ENERGY_LOW").otherwise("ENERGY_UNCERTAIN"),
        pick(tgt_ok, "TGT_SV_VALID", "TGT_SV_INVALID"), pick(res_ok, "RES_SV_VALID", "RES_SV_INVALID"), pick(steady, "MULTIWINDOW_CONSISTENT", "MULTIWINDOW_INCONSISTENT"), F.when(hard, "HARD_REJECT"),
    )
    codes = F.when(broken, F.array(F.lit("INVALID_ENROLLMENT"))).otherwise(F.array_compact(F.concat(lead, detail)))
    score = F.when(~broken, identity_score(c("q_enroll"), c("s_tgt"), tgt_ok))
    action = F.when(state == "PRESENT", "EMIT").when(state == "GRAY", "GRAY").otherwise("EMPTY")
    return F.struct(state.alias("audit_state"), action.alias("final_action"), hard.alias("hard_reject"), score.alias("identity_score"), logit(score).alias("identity_log_lr"), codes.alias("reason_codes"))


def open_case(policy: OpenCasePolicy = OpenCasePolicy()) -> Column:  # noqa: B008
    """Struct (action, reason) over audit_state, hard_reject, asr_text, identity_score: emit above the floor only; equality
    is empty."""
    c, score = F.col, F.col("identity_score")
    blank = F.trim(F.coalesce(c("asr_text"), F.lit(""))) == ""
    reason = (
        F.when(c("audit_state") != "GRAY", "NOT_GRAY_STATE").when(_holds(c("hard_reject")), "HARD_REJECT").when(blank, "ASR_EMPTY").when(score.isNull(), "IDENTITY_SCORE_MISSING")
        .when(score < policy.floor, "IDENTITY_BELOW_FLOOR").when(score == policy.floor, "IDENTITY_AT_FLOOR_EQUALITY").otherwise("IDENTITY_ABOVE_FLOOR")
    )
    return F.struct(F.when(reason == "IDENTITY_ABOVE_FLOOR", "EMIT").otherwise("EMPTY").alias("action"), reason.alias("reason"))


def open_case_with_cost(policy: OpenCasePolicy = OpenCasePolicy()) -> Column:  # noqa: B008
    """As ``open_case``, with the characters at stake: columns identity_log_lr, d_hat (expected errors), l_hat (length)."""
    c, score = F.col, F.col("identity_score")
    blank = F.trim(F.coalesce(c("asr_text"), F.lit(""))) == ""
    benefit = clip(c("l_hat") - c("d_hat"), 0.0, policy.most_benefit)
    bar = F.greatest(F.lit(policy.floor), F.try_divide(F.lit(policy.kappa), benefit))
    reason = (
        F.when(c("audit_state") != "GRAY", "NOT_GRAY_STATE").when(_holds(c("hard_reject")), "HARD_REJECT").when(blank, "ASR_EMPTY").when(score.isNull() | c("identity_log_lr").isNull(), "IDENTITY_SCORE_MISSING")
        .when(score < policy.floor, "IDENTITY_BELOW_FLOOR").when(c("d_hat").isNull() | c("l_hat").isNull(), "CHARACTER_MODEL_UNAVAILABLE").when(benefit <= 0, "CHARACTER_BENEFIT_NONPOSITIVE")
        .when(score > bar, "IDENTITY_ABOVE_CHAR_COST_THRESHOLD").otherwise("IDENTITY_BELOW_CHAR_COST_THRESHOLD")
    )
    return F.struct(F.when(reason == "IDENTITY_ABOVE_CHAR_COST_THRESHOLD", "EMIT").otherwise("EMPTY").alias("action"), reason.alias("reason"))


def audit_and_decide(df: DataFrame, thresholds: AuditThresholds = AuditThresholds(), policy: OpenCasePolicy = OpenCasePolicy()) -> DataFrame:  # noqa: B008
    """Audit, then decide open cases with the recognised text; window counts are those of the array column
    ``windows`` (structs of score, valid), whatever the caller put beside it."""
    counted = df.withColumns({"window_count": F.size("windows"), "valid_window_count": F.size(F.filter("windows", lambda w: w["valid"]))})
    audited = counted.withColumn("_a", three_state(thresholds)).select("*", "_a.*").drop("_a")
    choice = open_case(policy)
    return audited.withColumn("_c", choice).withColumn("decided_action", F.when(F.col("final_action") == "GRAY", F.col("_c.action")).otherwise(F.col("final_action"))).withColumn("decided_reason", F.when(F.col("final_action") == "GRAY", F.col("_c.reason"))).drop("_c")


def identity_vector() -> Column:
    """Struct of the frozen identity features over columns q_enroll, activity_mean, activity_seconds, s_tgt, energy_ratio,
    valid_tgt_sv, with a flag where the score is missing."""
    c = F.col
    return F.struct("q_enroll", "activity_mean", c("activity_seconds").alias("target_activity_duration"), "s_tgt", c("s_tgt").isNull().alias("s_tgt_missing"), c("energy_ratio").alias("target_energy_ratio"), "valid_tgt_sv")


def legacy_state(target: Column, residual: Column, spread: Column, present: float = 0.35, empty: float = 0.18, leak: float = 0.40) -> Column:
    """Struct (state, reason) by one score: high (unless the residual is high or windows spread over .25), low, leaked, open."""
    leaked = residual > target + 0.15
    high = target >= present
    reason = (
        F.when(high & _holds(residual >= leak), "GRAY_EVIDENCE_CONFLICT").when(high & _holds(spread > 0.25), "GRAY_LOW_SNR_AMBIGUOUS").when(high, "TARGET_PRESENT_HIGH_CONF")
        .when(target < empty, "TARGET_ABSENT_LOW_SIM").when(_holds(leaked), "TARGET_LEAKED_TO_RESIDUAL").otherwise("GRAY_LOW_SNR_AMBIGUOUS")
    )
    state = F.when(reason == "TARGET_PRESENT_HIGH_CONF", "PRESENT").when(reason.isin("TARGET_ABSENT_LOW_SIM", "TARGET_LEAKED_TO_RESIDUAL"), "EMPTY").otherwise("GRAY")
    return F.struct(state.alias("state"), reason.alias("reason"))


def quality_score(parts: list[Column]) -> Column:
    """Geometric mean of components clamped to [0.01, 1]."""
    total = F.lit(0.0)
    for p in parts:
        total = total + F.ln(clip(p, 0.01, 1.0))
    return F.exp(total / len(parts))


def input_state(n: Column, finite: Column, channels: Column, rate: Column, seconds: Column, level: Column, *, least: float = 0.5, most: float = 30.0, silence: float = 1e-4, wanted: int = 16_000) -> Column:
    """Struct (status, notes): the first failing check decides; channel and rate conversions are noted on the way."""
    status = F.when(F.coalesce(n, F.lit(0)) == 0, "EMPTY").when(~_holds(finite), "NONFINITE").when(seconds < least, "TOO_SHORT").when(seconds > most, "TOO_LONG").when(level < silence, "SILENT").otherwise("OK")
    notes = F.array_compact(F.array(F.when(channels > 1, "DOWNMIX"), F.when(rate != wanted, "RESAMPLE")))
    return F.struct(status.alias("status"), notes.alias("notes"))
