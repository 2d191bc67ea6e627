"""Chunk source and sentence state: batches, restarts, timers."""

import datetime
import shutil
import time

import numpy as np
import pytest
from cadenza.sources import samples
from cadenza.streaming import matcher, sentences
from cadenza.workspace import as_pattern
from pyspark.errors import StreamingQueryException


def put(folder, session, name, x, kind="<f4"):
    (folder / session).mkdir(parents=True, exist_ok=True)
    (folder / session / name).write_bytes(np.asarray(x).astype(kind).tobytes())


def once(df, out, checkpoint):
    df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()


def test_chunks_over_two_batches_and_a_restart(spark, tmp_path):
    samples.register(spark)
    rng = np.random.default_rng(1)
    a, b = rng.random(10_000, np.float32), rng.random(95, np.float32)
    source = lambda: spark.readStream.format("sample_chunks").option("chunk", 100).option("chunksPerTask", 7).load(str(tmp_path / "in"))
    put(tmp_path / "in", "a", "0001", a[:3333])
    put(tmp_path / "in", "b", "0001", b)
    put(tmp_path / "in", "a", "_0003", a[:50])  # not finished
    once(source(), tmp_path / "out", tmp_path / "check")
    got = lambda: sorted((r.session, r.seq, tuple(r.samples)) for r in spark.read.schema("session string, seq long, samples array<float>").parquet(str(tmp_path / "out")).collect())
    assert len(got()) == 33
    put(tmp_path / "in", "a", "0002", a[3333:3390])
    put(tmp_path / "in", "a", "0004", a[3390:])
    put(tmp_path / "in", "b", "0002", b[:10])
    once(source(), tmp_path / "out", tmp_path / "check")  # another query from the same checkpoint
    want = [("a", i, tuple(a[i * 100 : i * 100 + 100].tolist())) for i in range(100)] + [("b", 0, tuple(np.concatenate([b, b[:5]]).tolist()))]
    assert got() == want
    once(source(), tmp_path / "all", tmp_path / "check2")  # and all at once
    assert sorted((r.session, r.seq, tuple(r.samples)) for r in spark.read.parquet(str(tmp_path / "all")).collect()) == want


def test_a_batch_that_is_run_again_reads_the_same_bytes(tmp_path):
    put(tmp_path, "s", "1", np.arange(25), "<i2")
    reader = samples._Chunks({"path": str(tmp_path), "chunk": "4", "sampletype": "int16", "chunkspertask": "2"})
    end = reader.latestOffset()
    assert end == {"s": 6}
    parts = reader.partitions({"s": 1}, end)
    first = [b.to_pydict() for p in parts for b in reader.read(p)]
    put(tmp_path, "s", "2", np.arange(40), "<i2")
    assert [b.to_pydict() for p in reader.partitions({"s": 1}, end) for b in reader.read(p)] == first
    assert [n for b in first for n in b["seq"]] == [1, 2, 3, 4, 5] and first[0]["samples"][0] == [i / 32768 for i in range(4, 8)]
    assert reader.partitions(end, end) == []
    (tmp_path / "s" / "1").unlink()
    with pytest.raises(ValueError, match="have gone"):
        samples._Chunks({"path": str(tmp_path), "chunk": "40", "sampletype": "int16"}).partitions({}, {"s": 2})


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    sentences.use_rocksdb(spark)
    yield
    spark.conf.set(name, before)


KIND = "session string, seq long, text string"
COMMANDS = ["turnon", "stop"]
PIECES = ["please tu", "rn on", "now sto", "p", None, "stopp", "turn", " o", "n", "rest"]


def plain():
    out = []
    for s in ("x", "y"):
        sentence, first = "", 0
        for seq, text in enumerate(PIECES):
            sentence += text or ""
            hit, score = matcher.match(sentence, COMMANDS, 0.2)
            if hit:
                out.append((s, first, seq, hit, round(score, 9), sentence))
                sentence, first = "", seq + 1
    return out


def told(spark, out):
    return sorted((r.session, r.first_seq, r.last_seq, r.command, round(r.score, 9), r.sentence) for r in spark.read.schema(sentences.OUT).parquet(str(out)).filter("kind = 'command'").collect())


def test_commands_are_found_around_their_pieces(monkeypatch):
    """As by all windows, at any threshold, while few windows of a long text are held against a command."""
    rng, alphabet = np.random.default_rng(5), np.array(list("abc ,"))
    for n in (0, 1, 2, 5, 9, 40):
        for threshold in (0.0, 0.15, 0.29, 0.35, 0.5, 0.9):
            for _ in range(12):
                text = "".join(rng.choice(alphabet, n))
                commands = ["".join(rng.choice(alphabet[:3], k)) for k in rng.integers(1, 8, 3)]
                want = matcher.match(text, commands, threshold)
                assert matcher.find_command(text, commands, threshold) == (want if want[0] else (None, 1.0)), (text, commands, threshold)
    seen = []
    monkeypatch.setattr(matcher, "_distance", lambda a, b: seen.append(a) or matcher.edit_distance(a, b))
    text = "x" * 5000 + "licenced under" + "y" * 5000
    assert matcher.find_command(text, ["licensed under".replace(" ", "")], 0.15) == ("licensedunder", 1 / 13)
    assert len(seen) < 50


TIMED = KIND + ", ts timestamp"


def test_sentences_survive_a_restart(spark, tmp_path, rocksdb):
    """Pieces in three batches, each a query of its own from the same checkpoint; a piece that comes twice counts once.  Then
    another session moves the watermark on, and the idle sessions are closed."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def batch(rows):
        timed = [(s, n, t, datetime.datetime(2024, 1, 1, 0, 0, sec)) for s, n, t, sec in rows]
        spark.createDataFrame(timed[::-1], TIMED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(TIMED).parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
        once(sentences.sentence_events(stream, COMMANDS, threshold=0.2, idle_ms=20_000, event_time="ts"), tmp_path / "out", tmp_path / "check")

    try:
        for i, (a, b) in enumerate(((0, 3), (2, 7), (7, 10))):
            batch([(s, n, PIECES[n], n) for s in ("x", "y") for n in range(a, b)])
            assert len(told(spark, tmp_path / "out")) == sum(last < b for _, _, last, *_ in plain())
        assert told(spark, tmp_path / "out") == sorted(plain()) and len(plain()) == 8
        idle = lambda: sorted((r.session, r.first_seq, r.last_seq, r.sentence) for r in spark.read.schema(sentences.OUT).parquet(str(tmp_path / "out")).filter("kind = 'idle'").collect())
        assert idle() == []
        batch([("z", 0, "hello", 50)])
        batch([("z", 1, "again", 51), ("x", 0, "st", 51)])
        assert idle() == [("x", 8, 9, "nrest"), ("y", 8, 9, "nrest")]
        batch([("x", 1, "op", 52)])  # the closed session has begun anew
        assert ("x", 0, 1, "stop") in {t[:4] for t in told(spark, tmp_path / "out")}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_the_clock_closes_idle_sessions(spark, tmp_path, rocksdb):
    spark.createDataFrame([("x", 0, "please tu")], KIND).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
    query = sentences.sentence_events(stream, COMMANDS, threshold=0.2, idle_ms=500).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    rows, until = [], time.time() + 60
    while not rows and query.isActive and time.time() < until:
        time.sleep(0.5)
        rows = spark.read.schema(sentences.OUT).parquet(str(tmp_path / "out")).filter("kind = 'idle'").collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
    query.stop()
    assert [(r.session, r.first_seq, r.last_seq, r.sentence) for r in rows] == [("x", 0, 0, "please tu")]


def test_paths_with_signs_of_patterns(spark, tmp_path):
    """Of two files only the one named is streamed, whatever its name."""
    for name, text in (("a[b]{c,d}*?.parquet", "turnon"), ("ab.parquet", "stop")):
        spark.createDataFrame([(1, 0, text)], "session long, seq long, text string").coalesce(1).write.parquet(str(tmp_path / "new"))
        (tmp_path / name).write_bytes(next((tmp_path / "new").glob("*.parquet")).read_bytes())
        shutil.rmtree(tmp_path / "new")
    path = as_pattern(str(tmp_path / "a[b]{c,d}*?.parquet"))
    stream = spark.readStream.schema("session long, seq long, text string").parquet(path)
    once(stream, tmp_path / "out", tmp_path / "check")
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["turnon"]


def test_wrong_options(spark, tmp_path):
    samples.register(spark)
    with pytest.raises((StreamingQueryException, Exception), match="sampleType|positive"):
        once(spark.readStream.format("sample_chunks").option("sampleType", "int8").load(str(tmp_path)), tmp_path / "o", tmp_path / "c")
