"""Ordered files, digests of lists, partial reports, finite writes, slices of large files."""

import hashlib
import json
import wave

import numpy as np
import pytest
from cadenza.operators.scans import cut
from cadenza.sources import documents, sinks, slices
from pyspark.sql import functions as F


def test_one_ordered_file(spark, tmp_path):
    rows = spark.range(3000).select((2999 - F.col("id")).alias("at"), F.concat(F.lit("line é "), (2999 - F.col("id")).cast("string")).alias("x")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        documents.write_ordered(rows, ["at"], "x", str(tmp_path / "whole.txt"), head="<", foot=">")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (tmp_path / "whole.txt").read_text() == "<" + "\n".join(f"line é {i}" for i in range(3000)) + ">"
    with pytest.raises(Exception, match="whole.txt"):
        documents.write_ordered(rows, ["at"], "x", str(tmp_path / "whole.txt"))
    documents.write_ordered(rows.limit(0), ["at"], "x", str(tmp_path / "none.txt"), head="[", foot="]")
    assert (tmp_path / "none.txt").read_text() == "[]"
    broken = rows.withColumn("x", F.when(F.col("at") == 7, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="broken"):
        documents.write_ordered(broken, ["at"], "x", str(tmp_path / "broken.txt"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["none.txt", "whole.txt"]


def test_submission_file_is_the_document(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 3 else str(i), f"/a/b{i}.wav", f'say "{i}"\n', 1, i / 8) for i in range(40)], "ord int, id string, audio string, content string, label int, cer double").repartition(4)
    documents.write_submission(rows, str(tmp_path / "s.json"), F.avg("cer"), F.lit(0.5), 1.25)
    want = json.loads(sinks.submission(rows, F.avg("cer"), F.lit(0.5), 1.25).first()[0])
    assert json.loads((tmp_path / "s.json").read_text()) == want and len(want["result"]["results"]) == 40


def test_digest_of_a_list(spark, monkeypatch):
    lines = [f"line {i}" for i in range(50)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)][::-1], "i int, x string").repartition(3)
    sha = lambda x: hashlib.sha256("\n".join(x).encode()).hexdigest()
    assert documents.listed_digest(df, ["i"], "x").first()[0] == sha(lines)
    assert documents.listed_digest(df.limit(0), ["i"], "x").first()[0] == sha([])
    monkeypatch.setattr(documents, "FAN", 4)
    while len(lines) > 1:
        lines = [sha(lines[i : i + 4]) for i in range(0, len(lines), 4)]
    assert documents.listed_digest(df, ["i"], "x").first()[0] == lines[0]


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    """The writer dies after an epoch's sums are written and before the epoch is committed; the restart runs it again."""
    sums = {"n": F.count("*"), "total": F.sum("v")}
    write, deaths = documents.partial_reports(None, ["k"], sums, str(tmp_path / "report")), []

    def dying(batch, epoch):
        write(batch, epoch)
        if epoch == 1 and not deaths:
            deaths.append(epoch)
            raise RuntimeError("died after the write")

    def run():
        stream = spark.readStream.schema("k int, v long").parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(dying).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    put = lambda a, b: spark.range(a, b).select((F.col("id") % 3).cast("int").alias("k"), F.col("id").alias("v")).write.mode("append").parquet(str(tmp_path / "in"))
    told = lambda: {r.k: (r.n, r.total) for r in documents.report_so_far(spark, str(tmp_path / "report"), ["k"], sums).collect()}
    want = lambda n: {k: (len(range(k, n, 3)), sum(range(k, n, 3))) for k in range(3)}
    put(0, 10)
    run()
    assert told() == want(10)
    put(10, 25)
    with pytest.raises(Exception, match="died"):
        run()
    run()
    assert deaths == [1] and told() == want(25)


def test_writes_are_stopped_by_values_that_are_not_finite(spark, tmp_path):
    good = spark.range(10).select("id", (F.col("id") / 2).alias("x"))
    assert documents.write_finite(good, str(tmp_path / "good"), ["x"]) == 10
    assert spark.read.parquet(str(tmp_path / "good")).count() == 10
    with pytest.raises(FileExistsError):
        documents.write_finite(good, str(tmp_path / "good"), ["x"])
    bad = good.withColumn("y", F.when(F.col("id") == 3, F.lit(float("nan"))).when(F.col("id") == 4, F.lit(float("-inf"))).when(F.col("id") < 9, 1.0))
    with pytest.raises(ValueError, match="'y': 3"):
        documents.write_finite(bad, str(tmp_path / "bad"), ["x", "y"])
    assert not (tmp_path / "bad").exists() and cut(good, [], ["id"]).count() == 10
    assert [tuple(r) for r in documents.non_finite_terms(bad, ["x", "y"]).collect()] == [("y", 3)]


def wav(path, x, channels, width, rate=8000):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(x.tobytes())


@pytest.mark.parametrize("per_task, rows", [(64 << 20, 65_536), (700, 100), (64, 7)])
def test_slices(spark, tmp_path, per_task, rows):
    rng = np.random.default_rng(2)
    stereo = rng.integers(-32768, 32767, (500, 2)).astype("<i2")
    wav(tmp_path / "a.wav", stereo, 2, 2)
    wav(tmp_path / "b.WAV", (bytes8 := rng.integers(0, 255, 301).astype(np.uint8)), 1, 1)
    (tmp_path / "sub").mkdir()
    np.save(tmp_path / "sub" / "c.npy", (grid := rng.random((20, 30)).astype(np.float64)))
    np.save(tmp_path / "d.npy", np.zeros(0, np.int32))
    (tmp_path / "other.txt").write_text("no")
    want = {"a.wav": (stereo / 32768).mean(1), "b.WAV": (bytes8 - 128.0) / 128, "c.npy": grid.ravel()}
    got = {}
    for r in slices.read_slices(spark, str(tmp_path), bytesPerTask=per_task, slice=rows).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r["first"], r["values"], r.rate))
    assert set(got) == set(want)
    for name, x in want.items():
        parts = sorted(got[name])
        assert [p[0] for p in parts] == np.cumsum([0, *[len(p[1]) for p in parts]])[:-1].tolist()
        assert np.concatenate([p[1] for p in parts]) == pytest.approx(x, abs=1e-6)
        assert {p[2] for p in parts} == ({None} if name == "c.npy" else {8000})


def test_a_slice_reads_only_its_bytes(tmp_path):
    """A sparse file beyond 4 GiB: its last range is read at once."""
    head = np.lib.format
    with open(tmp_path / "big.npy", "wb") as f:
        n = (5 << 30) // 4
        head.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": (n,)})
        start = f.tell()
        f.seek(start + 4 * (n - 2))
        f.write(np.array([1.5, 2.5], "<f4").tobytes())
    reader = slices._Slices({"path": str(tmp_path), "bytespertask": str(1 << 20), "slice": "65536"})
    parts = reader.partitions()
    assert len(parts) == -(-(start + 4 * n) // (1 << 20))
    last = list(reader.read(parts[-1]))
    assert last[-1][3][-2:] == [1.5, 2.5] and last[-1][1] + len(last[-1][3]) == n


def test_refused_arrays(tmp_path):
    np.save(tmp_path / "o.npy", np.array([{}], object), allow_pickle=True)
    reader = slices._Slices({"path": str(tmp_path)})
    with pytest.raises(ValueError, match="no slices"):
        list(reader.read(reader.partitions()[0]))


def test_digests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(slices, "BLOCK", 10)
    for name, text in (("a", b""), ("b", b"x" * 1001)):
        (tmp_path / name).write_bytes(text)
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in slices.digests(spark, str(tmp_path)).collect()}
    assert got == {name: (len(t), hashlib.sha256(t).hexdigest()) for name, t in (("a", b""), ("b", b"x" * 1001))}
