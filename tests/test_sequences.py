import random

import pytest
from cadenza.functions import vectors as V
from cadenza.operators import sequences as S
from pyspark.sql import functions as F


def series(spark, values):
    return spark.createDataFrame([("a", t, float(p)) for t, p in enumerate(values)], "id string, t long, p double")


def machine(values, on, off):
    """Runs of a switch that a value of at least ``on`` turns on and one below ``off`` turns off."""
    runs, active = [], False
    for t, p in enumerate(values):
        active = p >= on or (active and p >= off)
        if active and runs and runs[-1][1] == t - 1:
            runs[-1] = (runs[-1][0], t)
        elif active:
            runs.append((t, t))
    return runs


@pytest.mark.parametrize("seed", range(4))
def test_hysteresis(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([0.0, 0.15, 0.45, 0.55, 0.62, 0.9, rng.random()]) for _ in range(rng.randint(1, 120))]
    got = S.active_runs(S.hysteresis(series(spark, values), ["id"], ["t"], "p", 0.62, 0.45), ["id"], ["t"], "t")
    assert sorted((r.start, r.end) for r in got.collect()) == machine(values, 0.62, 0.45)
    with pytest.raises(ValueError):
        S.hysteresis(series(spark, values), ["id"], ["t"], "p", 0.45, 0.45)


@pytest.mark.parametrize("seed", range(3))
def test_gaps_cores_and_guards(spark, seed):
    rng, at, rows = random.Random(40 + seed), 0, []
    for _ in range(30):
        start = at + rng.randint(1, 25)
        at = start + rng.randint(0, 30)
        rows.append((start, at))
    merged = []
    for start, end in rows:
        if merged and start - merged[-1][1] <= 9:
            merged[-1] = (merged[-1][0], end)
        else:
            merged.append((start, end))
    seg = S.merge_gaps(spark.createDataFrame([("a", *r) for r in rows], "id string, start long, end long").repartition(3), ["id"], 9)
    assert sorted((r.start, r.end) for r in seg.collect()) == merged
    cores = S.drop_short(seg, 12)
    assert sorted((r.start, r.end) for r in cores.collect()) == [(s, e) for s, e in merged if e - s + 1 >= 12]
    wide = S.add_guard(cores, 7, 5, at + 2).collect()
    assert all((r.guarded_start, r.guarded_end) == (max(r.start - 7, 0), min(r.end + 5, at + 2)) for r in wide)


def test_overlapping_merge_uses_running_maximum(spark):
    seg = spark.createDataFrame([("a", 0, 100), ("a", 10, 20), ("a", 90, 95), ("a", 300, 400)], "id string, start long, end long")
    assert sorted((r.start, r.end) for r in S.merge_overlaps(seg, ["id"], 0).collect()) == [(0, 100), (300, 400)]


def test_clean_runs_is_order_free(spark):
    df = S.hysteresis(series(spark, [0, 1, 0, 1, 1, 1, 0, 0, 1, 1, 1, 0, 0, 0]), ["id"], ["t"], "p", 0.7, 0.3)
    want = [0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0]
    for shape in (df.repartition(1), df.repartition(8)):
        got = S.clean_runs(shape, ["id"], ["t"]).orderBy("t").collect()
        assert [r.active for r in got] == want


def test_durations_and_windows(spark):
    one = spark.range(1)
    assert tuple(one.select(V.adaptive_duration(F.lit(3.0)), V.adaptive_duration(F.lit(40.0))).first()) == pytest.approx((0.3, 3.0))
    a = F.array(*[F.lit(float(i)) for i in range(10)])
    row = one.select(V.windows_with_tail(a, 4, 2).alias("w"), V.equal_parts(a, 3).alias("p"), V.resample_labels(a, F.lit(5)).alias("r"), V.weighted_median(F.array(F.struct(F.lit(0.2).alias("score"), F.lit(1.0).alias("weight")), F.struct(F.lit(0.9).alias("score"), F.lit(3.0).alias("weight")))).alias("m")).first()
    assert row.w[-1] == [6, 7, 8, 9] and len(row.w) == 5 and [len(p) for p in row.p] == [3, 3, 4] and row.r == [1, 3, 5, 7, 9] and row.m == 0.9


def test_si_sdr(spark):
    import numpy as np

    t = np.sin(np.arange(800) * 0.05)
    df = spark.createDataFrame([(t.tolist(), t.tolist(), [0.0] * 800)], "e array<double>, r array<double>, z array<double>")
    parts = lambda c: V.si_sdr_parts(F.col(c), F.col("r"))
    good, none = df.select(V.decibel(parts("e")["signal"], parts("e")["error"]), V.decibel(parts("z")["signal"], parts("z")["error"])).first()
    assert good > 60 and none < -60


def test_signal_udfs(spark):
    import numpy as np
    from cadenza.functions import signal as G

    x = np.random.default_rng(0).normal(size=4096).astype(float)
    df = spark.createDataFrame([(x.tolist(), [1.0] + [0.0] * 9, [1.0, 0.0, 0.0, 1.0], [0.0, 1.0, 1.0, 0.0])], "x array<double>, h array<double>, t array<double>, o array<double>")
    row = df.select(G.multi_resolution_distance("x", "x").alias("d"), G.convolve_room("x", "h").alias("c"), G.resample("x", F.lit(8000)).alias("r"), G.denoise("x").alias("n"), G.best_lag("t", "o", F.lit(1.0)).alias("lag"), G.overlap_add(lambda p: p, 512, 256)("x").alias("o"), G.recogniser(lambda k: 1 / 0)(F.lit("k")).alias("e")).first()
    assert row.d == pytest.approx(0) and np.allclose(row.c, x, atol=1e-5) and len(row.r) == 8192 and len(row.n) == 4096
    assert np.allclose(row.o[1:], x[1:], atol=1e-4) and row.e.status == "ERROR" and "ZeroDivisionError" in row.e.error
