import random

import pytest
from cadenza.operators import calibrate, corpus, metrics, paired, policy, relational
from pyspark.sql import functions as F


def test_corpus_is_no_mean_of_sentences(spark):
    rows = spark.createDataFrame([(1, 0, 0, 1), (0, 0, 0, 9)], "s long, d long, i long, n long")
    assert rows.agg(metrics.corpus_cer(*map(F.col, "sdin"))[-1]).first()[0] == pytest.approx(0.1)
    with pytest.raises(Exception, match="no reference"):
        rows.filter("n > 99").agg(metrics.corpus_cer(*map(F.col, "sdin"))[-1]).collect()


def test_buckets(spark):
    label = spark.range(1).select(paired.bucket_labels(F.lit("overlap"), F.lit(1.0), F.lit(-5.0), F.lit(None).cast("double")).alias("b")).first().b
    assert label == ["scene:OVERLAP", "OVERLAP", "OVERLAP_100", "OVERLAP_100_SIR_-5DB", "sir_db:-5"]


def comparison(spark, full=10.0, single=-1.0, extreme=10.0):
    rows = [("OVERLAP_100", full, 0.1), ("SINGLE", single, 0.0), ("OVERLAP_100_SIR_-5DB", extreme, 0.1)]
    return spark.createDataFrame([r for r in rows if r[1] is not None], "bucket string, absolute_reduction_pp double, relative_reduction double")


@pytest.mark.parametrize(("change", "silent", "quality", "verdict"), [({}, 0, 6000, "PASS"), ({}, 1, 6000, "FAIL"), ({"extreme": None}, 0, 6000, "INCONCLUSIVE"), ({}, 0, None, "INCONCLUSIVE"), ({"single": -3.0}, 0, 6000, "FAIL")])
def test_verdict(spark, change, silent, quality, verdict):
    facts = spark.createDataFrame([(True, 0, quality, silent, 6000)], "result_valid boolean, asr_errors int, quality_samples int, near_silent int, expected int")
    assert paired.acceptance(comparison(spark, **change), facts).first().verdict.startswith(verdict)


def runs(spark, passed, seeds=(1, 2, 3)):
    return spark.createDataFrame([(s, p, "m") for s, p in zip(seeds, passed, strict=True)], "seed int, passed boolean, manifest string")


def test_vote(spark):
    verdict = lambda *p: paired.seed_vote(runs(spark, p), 1).first().verdict.split("_")[0]
    assert [verdict(True, True, False), verdict(True, False, False), verdict(False, True, True)] == ["ACCEPT", "REJECT", "REJECT"]
    with pytest.raises(Exception, match="distinct seeds"):
        paired.seed_vote(runs(spark, (True, True, True), (1, 1, 2)), 1).collect()


def test_grid_has_210(spark):
    assert policy.policy_grid(spark, list(range(10)), [0.1] * 6, [0.1, 0.2]).count() == 210
    assert policy.policy_grid(spark, list(range(10)), [], []).count() == 10


def test_calibration_separates(spark):
    rows = spark.createDataFrame([(i / 10, int(i > 5)) for i in range(10)] * 3, "x double, y int")
    model = calibrate.fit_irls(rows, ["x"], "y", l2=0.01)
    p = {r.x: r.p for r in rows.select("x", calibrate.probability(model).alias("p")).collect()}
    assert p[0.0] < 0.5 < p[0.9] and model["rounds"] < 100
    gate = calibrate.fit_gate(rows, ["x"], "y", epochs=300)
    assert gate["weights"][0] > 0


def test_leakage_and_acceptance(spark):
    df = spark.createDataFrame([(1, "a", "train"), (2, "a", "dev"), (3, "b", "train"), (3, "b", "train")], "id int, spk string, split string")
    assert [tuple(r) for r in corpus.leakage(df, "split", "spk").collect()] == [("dev", "train", 1)]
    row = corpus.acceptance(df, "split", "id", ["spk"], F.lit(False)).first()
    assert (row.duplicate_ids, row.shared_spk, row.verdict) == (1, 1, "FAIL")


def test_validation(spark):
    df = spark.createDataFrame([("a", "x"), ("a", ""), (None, "y")], "id string, text string")
    assert {(r.rule, r.key, r.detail) for r in relational.violations(df, "id", ["id", "text"]).collect()} == {("missing", "a", "text"), ("missing", None, "id"), ("repeated", "a", "2")}
    with pytest.raises(ValueError):
        relational.validated(df, "id", ["text"])
    with pytest.raises(Exception, match="no entry for"):
        relational.referenced(df.filter("id IS NOT NULL"), spark.createDataFrame([("b", 1)], "id string, v int"), "id").collect()


def test_class_weights_keep_every_label(spark):
    from cadenza.operators import metrics

    rows = [(i % 100, i) for i in range(300)]
    got = metrics.class_weights(spark.createDataFrame(rows, "label int, i int"), "label").collect()
    assert len(got) == 300 and all(r.weight == pytest.approx(0.5 / 3) for r in got)


def test_sweeps_by_place(spark):
    """Against plain counting, with ties on thresholds, nulls and an empty table."""
    scores = [(None, True), (0.1, True), (0.2, False), (0.2, True), (0.3, True), (0.3, False), (0.9, False), (0.05, False)]
    rows = spark.createDataFrame(scores, "s double, pos boolean")
    marks = [0.3, 0.1, 0.2, 2.0]
    got = {r.threshold: (r.true_accepts, r.false_accepts) for r in policy.sweep(rows, policy.grid(spark, "threshold", marks), "s", F.col("pos")).collect()}
    assert got == {m: tuple(sum(s is not None and s >= m and p is want for s, p in scores) for want in (True, False)) for m in marks}
    assert policy.sweep(rows.filter("s > 5"), policy.grid(spark, "threshold", marks), "s", F.col("pos")).count() == 0
    for step in (0.01, 0.1, 0.3):
        tries = [0.05 + i * step for i in range(int(0.85 / step) + 2)]
        errors = [sum((p and (s is None or s < t)) or (not p and s is not None and s >= t) for s, p in scores) for t in tries]
        best = policy.equal_error_threshold(rows, "s", F.col("pos"), step).first()
        assert (best.threshold, best.errors) == (round(tries[errors.index(min(errors))], 3), min(errors))


def test_grid_by_place(spark):
    items = [("pos", 0.2, 0.3, 10, 4, 1), ("pos", 0.1, 0.5, 10, 6, 2), ("neg", 0.3, 0.5, 5, 5, 5), ("neg", 0.1, 0.9, 5, 5, 5), ("pos", None, None, 4, 1, 1)]
    rows = spark.createDataFrame(items, "split string, sim double, intent_dist double, n long, raw_err long, fixed_err long")
    for r in policy.evaluate_grid(rows, policy.policy_grid(spark, [0.1, 0.2], [0.3, 0.4], [0.5])).collect():
        ok = [i[1] is not None and i[1] >= r.sv and (r.intent is None or i[2] <= r.intent) for i in items]
        err = sum((i[3] if not a else i[5] if r.phrase is not None and i[2] <= r.phrase else i[4]) for i, a in zip(items, ok) if i[0] == "pos")
        assert r.pos_corpus_cer == err / 24 and r.neg_rr == sum(not a for i, a in zip(items, ok) if i[0] == "neg") / 2


def test_gate_descends_alike_on_the_driver_and_in_tasks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(round(rng.random(), 2), rng.choice([0.0, 0.5, 1.0]), 7.0, int(rng.random() < 0.3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "x double, z double, same double, y int").repartition(3)
    here = calibrate.fit_gate(df, ["x", "z", "same"], "y", epochs=25)
    monkeypatch.setattr(calibrate, "MOST_VECTORS", 10)
    monkeypatch.setattr(calibrate, "BLOCK", 16)
    there = calibrate.fit_gate(df, ["x", "z", "same"], "y", epochs=10)
    there = calibrate.fit_gate(df, ["x", "z", "same"], "y", epochs=15, start=there)
    assert there["weights"] == pytest.approx(here["weights"], abs=1e-9) and there["bias"] == pytest.approx(here["bias"], abs=1e-9)
