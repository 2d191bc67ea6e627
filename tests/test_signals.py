import math

import pytest
from cadenza.functions import levels as L
from cadenza.functions import losses as X
from cadenza.functions import mixing as M
from cadenza.functions import signal as G
from cadenza.operators import corpus, relational, sequences
from cadenza.sources import sinks
from pyspark.sql import functions as F


def _state_machine(x, size, hop, share, least, gap):
    """Activity of a series, frame by frame."""
    level = [math.sqrt(sum(v * v for v in x[s : s + size]) / len(x[s : s + size])) for s in range(0, len(x), hop)]
    on = [max(level) > 1e-10 and v >= share * max(level) for v in level]

    def runs(flags):
        start = 0
        for i in range(1, len(flags) + 1):
            if i == len(flags) or flags[i] != flags[start]:
                yield start, i
                start = i

    for a, b in list(runs(on)):
        if on[a] and b - a < least:
            on[a:b] = [False] * (b - a)
    for a, b in list(runs(on)):
        if not on[a] and a > 0 and b < len(on) and b - a <= gap:
            on[a:b] = [True] * (b - a)
    return [int(any(on[f] for f in range(len(on)) if f * hop <= t < f * hop + size)) for t in range(len(x))]


@pytest.mark.parametrize("pattern", ["1110011111", "0110111000", "1001110111", "1111000111", "0000000000", "1"])
def test_level_activity(spark, pattern):
    x = [float(c) for c in pattern for _ in range(4)]
    row = spark.createDataFrame([(x,)], "x array<double>").select(L.level_activity(F.col("x"), 4, 4, 0.5).alias("m")).first()
    assert row.m == _state_machine(x, 4, 4, 0.5, 3, 2)


def test_levels_of_odd_audio(spark):
    rows = spark.createDataFrame([(0, None), (1, []), (2, [0.0] * 40), (3, [0.1] * 5)], "id int, x array<double>")
    got = {r.id: r for r in rows.select("id", L.signal_to_noise(F.col("x"), 8).alias("snr"), L.speech_ratio(F.col("x"), 8).alias("speech"), L.level_activity(F.col("x"), 8, 4).alias("m")).collect()}
    assert (got[0].snr, got[0].speech, got[0].m) == (None, None, None)
    assert (got[1].snr, got[1].speech, got[1].m) == (L.UNKNOWN_DB, 0.0, [])
    assert got[2].snr == pytest.approx(0.0) and got[2].speech == 1.0 and got[2].m == [0] * 40
    assert got[3].snr == L.UNKNOWN_DB and got[3].m == [0] * 5


def test_losses(spark):
    rows = spark.createDataFrame([([0.0, 1.0], [0.0, 0.0], [500.0, -500.0])], "e array<double>, z array<double>, big array<double>")
    one = rows.select(X.scale_sensitive_l1(F.col("e"), F.col("z"), 0.1).alias("l"), X.activity_cross_entropy(F.col("big"), F.array(F.lit(0)), logits=True).alias("b"), X.activity_cross_entropy(F.col("e"), F.array(F.lit(0), F.lit(1))).alias("p")).first()
    assert one.l == 0.5 and one.b == pytest.approx(250.0) and one.p == pytest.approx(0.0, abs=1e-6)
    none = spark.createDataFrame([(True, 5.0, 1.0, 1.0, 1.0, 2.0, 0.0, 0.0)], "absent boolean, si_sdr_db double, wav_l1 double, mrstft double, act_bce double, res_l1 double, gap double, whole double")
    told = X.weighted_losses(none, {"si_sdr_db": 1.0, "wav_l1": 1.0, "res_l1": 1.0}, absent_scale=0.0).first()
    assert (told.si_sdr_db, told.wav_l1, told.total) == (0.0, 0.0, 2.0)
    with pytest.raises(ValueError, match="absent_scale"):
        X.weighted_losses(none, {}, absent_scale=2.0)


def test_mixtures(spark):
    row = spark.createDataFrame([([1.0, -1.0, 1.0, -1.0], [2.0], [0.0, 0.0])], "t array<double>, o array<double>, z array<double>").select(
        M.mixed(F.col("t"), F.col("o"), F.lit(0.0)).alias("m"),
        M.mixed_to_peak(F.col("t"), F.col("o"), F.lit(0.0)).alias("p"), M.scaled_by_activity(F.col("t"), F.col("z"), F.lit(0.0)).alias("a"),
        M.scaled_jointly(F.col("t"), F.col("o"), F.array(F.lit(1)), F.array(F.lit(0)), F.lit(0.0)).alias("j"), M.overlap_ratio(F.array(F.lit(0)), F.array(F.lit(1))).alias("r"),
    ).first()
    assert row.m == pytest.approx([2.0, 0.0, 2.0, 0.0]) and row.p == pytest.approx([0.9, 0.0, 0.9, 0.0])
    assert row.a == [0.0, 0.0] and row.j is None and row.r is None


def test_lags_and_rooms(spark):
    rows = spark.createDataFrame([(0, [0, 0, 1, 1], [1, 1, 0, 0]), (1, [1, 1, 1, 1], [0, 0, 0, 0]), (2, [1, 1, 1], [1])], "id int, t array<int>, o array<int>")
    assert {r.id: r.lag for r in rows.select("id", G.best_lag("t", "o", F.lit(1.0)).alias("lag")).collect()} == {0: 2, 1: None, 2: None}
    room = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, 2.0], [0.0]), ([1.0], [], [0.0])], "x array<double>, h array<double>, z array<double>")
    got = room.select(G.convolve_room("x", "h").alias("d"), G.convolve_room_aligned(4)("x", "h").alias("a"), G.convolve_room_aligned(4)("x", "z").alias("n")).collect()
    assert got[0].d == pytest.approx([1.0, 2.0, 3.0]) and got[0].a == pytest.approx([1.0, 2.0, 3.0, 0.0], abs=1e-6) and got[0].n is None
    assert got[1].d == [1.0] and got[1].a is None


def test_rules_on_nulls(spark):
    rows = spark.createDataFrame([(None, None, None, None), ("enroll_swap_target_1", None, None, True), (None, "1", "", None), (None, "no", "x", False)], "s string, f string, w string, p boolean")
    swap = corpus.is_swap(F.col("s"), F.col("f"), F.col("w"))
    assert [tuple(r) for r in rows.select(swap, corpus.force_zero(F.col("p"), F.lit(False), swap)).collect()] == [(False, False), (True, False), (True, True), (True, True)]


def test_combined_and_counted(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x"), (2, "x")], "k int, v string"), spark.createDataFrame([(2, "y")], "k int, v string")
    with pytest.raises(Exception, match="repeated key 2"):
        relational.combined([a, b], "k").collect()
    assert relational.combined([a, b.filter("k > 2")], "k").count() == 2
    steps = sequences.counted_steps(a.withColumn("g", F.lit(1)), ["g"], ["k"], {"save": 2}, {"seen": "k"}).orderBy("k").collect()
    assert [(r.step, r.seen, r.save) for r in steps] == [(1, 1, False), (2, 3, True)]
    files = spark.createDataFrame([("b", "2"), ("a", "1")], "path string, sha256 string")
    notes = sinks.provenance(a, "v1", files)
    sinks.write_provenance(notes, str(tmp_path / "notes"))
    assert spark.read.text(str(tmp_path / "notes" / "name=VERSION")).first().value == "v1"
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_provenance(notes, str(tmp_path / "notes"))


def test_windows_that_are_kept(spark):
    """Where windows of equal verdicts lie alone the gain is 1 or the floor; where they overlap it is between."""
    n = int(1.6 * 16000)
    x = [1.0] * (2 * n)  # windows begin at 0, n / 2 and n
    rows = spark.createDataFrame([(0, x, [0.9, 0.9, 0.9]), (1, x, [0.1, 0.1, 0.1]), (2, x, [0.9, 0.1, 0.1]), (3, [1.0] * 10, [0.9]), (4, [1.0] * 10, [])], "id int, x array<double>, s array<double>")
    got = {r.id: r.y for r in rows.select("id", G.keep_windows("x", "s", F.lit(0.5), F.lit(0.2)).alias("y")).collect()}
    assert got[0] == pytest.approx(x) and got[1] == pytest.approx([0.2] * len(x)) and got[3] == pytest.approx([1.0] * 10) and got[4] == pytest.approx([0.2] * 10)
    assert got[2][: n // 2] == pytest.approx([1.0] * (n // 2)) and got[2][n:] == pytest.approx([0.2] * n)
    assert all(0.2 < v < 1.0 for v in got[2][n // 2 + 10 : n - 10])


def test_tables_and_arrays(spark, tmp_path):
    import numpy as np
    from cadenza.operators import policy
    from cadenza.sources import readers

    assert sinks.markdown([{"a": 1, "b": None}, {"a": 2}], ["a", "b"]) == "| a | b |\n|-|-|\n| 1 | None |\n| 2 |  |"
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.int16).reshape(2, 3))
    assert [r["values"] for r in readers.read_arrays(spark, str(tmp_path)).collect()] == [[0.0, 1.0, 2.0, 3.0, 4.0, 5.0]]
    scores = spark.createDataFrame([(0.25, 0.5), (1.5, 1.0)], "cer double, rr double")
    got = [round(r[0], 9) for r in scores.select(policy.objective_80_clamped(F.col("cer"), F.col("rr"))).collect()]
    assert got == [round(80 * (0.6 * 0.75 + 0.4 * 0.5), 9), 32.0]
