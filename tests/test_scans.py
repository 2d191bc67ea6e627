"""Series cut into ranges give what windows over whole series give; percentiles against numpy."""

import random

import numpy as np
import pytest
from cadenza.operators import scans
from cadenza.operators import sequences as S
from pyspark.sql import functions as F


@pytest.fixture(autouse=True)
def several_ranges(spark):
    """Small tables, too, are cut into as many ranges as there are partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def series(spark, seed, rows=900):
    rng = random.Random(seed)
    out = []
    for key, n in (("long", rows), ("b", 40), (None, 15), ("one", 1)):
        times = rng.sample(range(10 * n), n)
        out += [(key, t, rng.choice([0.0, 0.2, 0.5, 0.7, 1.0, None]), rng.randrange(5)) for t in times]
    return spark.createDataFrame(out, "id string, t long, p double, g int").repartition(5)


def both(df, keys, order, run):
    plain, parted = run(df), run(scans.cut(df, keys, order))
    got = [sorted(map(str, x.drop("_part").select(*plain.columns).collect())) for x in (plain, parted)]
    assert got[0] == got[1] and len(got[0])


@pytest.fixture(params=[1])
def df(spark, request):
    return series(spark, request.param)


def test_every_kind_of_running_value(df):
    kinds = {k: (k, F.col("p") if k != "lag" else F.col("g")) for k in ("sum", "max", "last", "lag", "max_before")}
    both(df, ["id"], ["t"], lambda x: scans.scan(x, ["id"], ["t"], kinds).withColumn("sum", F.round("sum", 6)))
    both(df, [], ["t", "id"], lambda x: scans.scan(x, [], ["t", "id"], kinds).withColumn("sum", F.round("sum", 6)))
    assert scans.cut(df, ["id"], ["t"]).filter("id = 'long'").select("_part").distinct().count() > 1


def switched(x):
    return S.hysteresis(x, ["id"], ["t"], "p", 0.62, 0.45)


def test_runs_and_merges(df):
    both(df, ["id"], ["t"], switched)
    both(df, ["id"], ["t"], lambda x: S.active_runs(switched(x), ["id"], ["t"], "t"))
    both(df, ["id"], ["t"], lambda x: S.runs(x, ["id"], ["t"], "t", "p"))
    segments = df.filter("t % 3 > 0").select("id", F.col("t").alias("start"), (F.col("t") + 4 * F.col("g")).alias("end"))
    both(segments, ["id"], ["start", "end"], lambda x: S.merge_overlaps(x, ["id"], 2))
    both(segments, ["id"], ["start", "end"], lambda x: S.pad_and_merge(x, ["id"], 1, 3, 1))
    both(segments.withColumn("end", F.col("start")), ["id"], ["start"], lambda x: S.merge_gaps(x, ["id"], 4))


def test_cleanup_frames_and_counters(df):
    both(df, ["id"], ["t"], lambda x: S.clean_runs(switched(x), ["id"], ["t"], 2, 3))
    for width, stride in ((4, 2), (5, 3), (1, 1)):
        both(df.withColumn("m", (F.col("g") > 2).cast("int")), ["id"], ["t"], lambda x, w=width, s=stride: S.pooled_activity(x, ["id"], ["t"], "m", w, s, 0.4))
    both(df, ["id"], ["t"], lambda x: S.counted_steps(x, ["id"], ["t"], {"save": 4}, {"seen": "g"}))


def test_segment_features(df):
    core = S.merge_gaps(S.active_runs(switched(df), ["id"], ["t"], "t"), ["id"], 3)
    both(df.filter("p IS NOT NULL"), ["id"], ["t"], lambda x: S.segment_features(core, x, ["id"], "t", "p").withColumn("mean_p", F.round("mean_p", 9)))
    rows, want = df.filter("p IS NOT NULL").collect(), {}
    for c in core.collect():
        inside = [r.p for r in rows if r.id == c.id and c.start <= r.t <= c.end]
        want[c.id, c.start] = (round(float(np.mean(inside)), 9), len(inside))
    got = {(r.id, r.start): (round(r.mean_p, 9), r.frames) for r in S.segment_features(core, df.filter("p IS NOT NULL"), ["id"], "t", "p").collect()}
    assert got == want


@pytest.mark.parametrize("margin", [0.01, -0.2])
def test_percentiles(spark, monkeypatch, margin):
    """With brackets that hold the ranks, and with ones that don't."""
    monkeypatch.setattr(scans, "MARGIN", margin)
    rng = np.random.default_rng(7)
    groups = {"wide": rng.normal(size=3000), "ties": rng.integers(0, 4, 500).astype(float), None: rng.random(7), "single": np.array([3.5]), "ends": np.array([-np.inf, 1.0, 2.0, np.inf])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("wide", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: r for r in scans.percentiles(df, ["g"], "x", shares).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert got[k].n == len(x)
        for name, p in shares.items():
            if k != "ends":
                assert got[k][name] == pytest.approx(np.quantile(x, p), abs=1e-12)
    assert [got["ends"][s] for s in ("p0", "p50", "p100")] == [-np.inf, 1.5, np.inf]
    every = np.concatenate([x for k, x in groups.items()])
    assert scans.percentiles(df, [], "x", {"m": 0.5}).collect() == [(len(every), pytest.approx(np.quantile(every, 0.5)))]
    assert scans.percentiles(df.filter("g = 'nothing'"), [], "x", {"m": 0.5}).collect() == []
    odd = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "x double")
    assert scans.percentiles(odd, [], "x", {"m": 0.5, "low": 0.0}).first()[1:] == (2.0, 1.0)
