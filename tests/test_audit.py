import pytest
from cadenza.operators import audit as A
from pyspark.sql import functions as F

COLUMNS = "name string, q_enroll double, activity_mean double, s_tgt double, energy_ratio double, s_res double, delta_s double, valid_tgt_sv boolean, valid_res_sv boolean, valid_delta boolean, window_consistent boolean, window_count int, valid_window_count int"
T, N = True, False
CASES = [
    (("1", 0.85, 0.9, 0.78, 0.35, 0.12, 0.66, T, T, T, T, 3, 3), "PRESENT", None),
    (("2", 0.8, 0.02, None, 0.001, 0.05, None, N, T, N, N, 0, 0), "EMPTY", "TARGET_ABSENT_ACTIVITY_ENERGY"),
    (("3", 0.8, 0.85, 0.12, 0.25, 0.65, -0.53, T, T, T, T, 3, 3), "EMPTY", "TARGET_MISROUTED_TO_RESIDUAL"),
    (("4", 0.8, 0.8, 0.55, 0.005, 0.15, 0.40, T, T, T, T, 3, 3), "GRAY", "EVIDENCE_CONFLICT"),
    (("5", 0.85, 0.85, 0.72, 0.30, 0.55, 0.17, T, T, T, T, 3, 3), "GRAY", "TGT_RES_BOTH_HIGH"),
    (("6", 0.8, 0.9, 0.70, 0.40, 0.10, 0.60, T, T, T, N, 4, 3), "GRAY", "MULTIWINDOW_INCONSISTENT"),
    (("7", 0.12, 0.85, 0.78, 0.35, 0.10, 0.68, T, T, T, T, 3, 3), "GRAY", "ENROLLMENT_LOW_QUALITY"),
    (("8", 0.8, 0.05, 0.45, 0.40, 0.15, 0.30, T, T, T, T, 2, 2), "GRAY", "EVIDENCE_CONFLICT"),
    (("residual null but strong", 0.8, 0.9, 0.8, 0.3, None, None, T, N, N, T, 3, 3), "PRESENT", None),
    (("quality at the edge", 0.3, 0.9, 0.8, 0.3, 0.1, 0.7, T, T, T, T, 3, 3), "PRESENT", None),
    (("one valid window of five", 0.8, 0.9, 0.8, 0.3, 0.1, 0.7, T, T, T, T, 5, 1), "GRAY", "SINGLE_SHORT_HIGH_WINDOW"),
    (("no quality", None, 0.9, 0.8, 0.3, 0.1, 0.7, T, T, T, T, 3, 3), "ERROR", "INVALID_ENROLLMENT"),
]


def test_rule_table(spark):
    got = {r.name: r for r in spark.createDataFrame([c[0] for c in CASES], COLUMNS).select("name", A.three_state().alias("a")).select("name", "a.*").collect()}
    for (name, *_), state, code in CASES:
        assert got[name].audit_state == state, name
        assert code is None or code in got[name].reason_codes, name
        assert got[name].hard_reject == (state == "EMPTY")


def test_legacy(spark):
    df = spark.createDataFrame([(0.45, None), (0.12, None), (0.22, 0.42), (0.28, None)], "t double, r double").select(A.legacy_state(F.col("t"), F.col("r"), F.lit(None).cast("double")).alias("s"))
    assert [r.s.state for r in df.collect()] == ["PRESENT", "EMPTY", "EMPTY", "GRAY"]


def test_open_cases(spark):
    rows = [("GRAY", N, "x", 0.6), ("GRAY", N, "x", 0.5), ("GRAY", N, " ", 0.6), ("PRESENT", N, "x", 0.6), ("GRAY", N, "x", None)]
    df = spark.createDataFrame(rows, "audit_state string, hard_reject boolean, asr_text string, identity_score double").withColumns({"identity_log_lr": F.lit(1.0), "d_hat": F.lit(1.0), "l_hat": F.lit(21.0)})
    got = df.select(A.open_case().alias("a"), A.open_case_with_cost().alias("b")).collect()
    assert [r.a.action for r in got] == ["EMIT", "EMPTY", "EMPTY", "EMPTY", "EMPTY"]
    assert [r.b.reason for r in got][:2] == ["IDENTITY_ABOVE_CHAR_COST_THRESHOLD", "IDENTITY_BELOW_CHAR_COST_THRESHOLD"]


def test_decision_counts_windows_itself(spark):
    df = spark.createDataFrame([CASES[0][0]], COLUMNS).withColumn("windows", F.array(*[F.struct(F.lit(0.8).alias("score"), F.lit(i == 0).alias("valid")) for i in range(3)])).withColumn("asr_text", F.lit("x"))
    row = A.audit_and_decide(df).first()
    assert row.valid_window_count == 1 and row.audit_state == "GRAY" and row.decided_action == "EMIT"


def test_thresholds_must_be_complete():
    with pytest.raises(ValueError):
        A.AuditThresholds.of({"activity_high": 0.7})
