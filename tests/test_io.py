import wave

import pytest
from cadenza.sources import readers, sinks
from cadenza.streaming import matcher
from pyspark.sql import functions as F


def test_json_lines(spark, tmp_path):
    good, bad = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    good.write_text('﻿{"id": 1, "t": "x"}\n\n{"id": 2}\n')
    bad.write_text('{"id": 1}\n[1]\nnope\n')
    assert sorted(r.id for r in readers.read_jsonl(spark, str(good), "id long, t string", strict=True).collect()) == [1, 2]
    assert readers.read_jsonl(spark, str(bad), "id long, t string").count() == 1
    with pytest.raises(Exception, match="not a JSON object"):
        readers.read_jsonl(spark, str(bad), "id long, t string", strict=True).collect()
    assert [r.line_no for r in readers.with_line_numbers(spark, str(bad)).orderBy("line_no").collect()] == [1, 2, 3]


def test_transcripts_and_phrases(spark, tmp_path):
    t, c, p = tmp_path / "t.txt", tmp_path / "t.csv", tmp_path / "p.txt"
    t.write_text("UTT001 打 开 空 调\nUTT002 关\n")
    c.write_text("dir/S0001.wav,打 开\nignored,x\n")
    p.write_text("打开。\n\n关闭\n打开\n")
    assert {tuple(r) for r in readers.read_transcripts(spark, str(t), strict=True).collect()} == {("UTT001", "打开空调"), ("UTT002", "关")}
    assert [tuple(r) for r in readers.read_transcripts(spark, str(c)).collect()] == [("S0001", "打开")]
    assert [r.phrase for r in readers.read_phrases(spark, str(p)).orderBy("ord").collect()] == ["打开", "关闭"]


def test_audio_listing_ledger(spark, tmp_path):
    (tmp_path / "S0001").mkdir()
    with wave.open(str(tmp_path / "S0001" / "a.wav"), "wb") as f:
        f.setnchannels(2), f.setsampwidth(2), f.setframerate(16000)
        f.writeframes(b"\x00\x40\x00\x20" * 4)
    row = readers.read_audio(spark, str(tmp_path)).first()
    assert row.rate == 16000 and row.samples == pytest.approx([0.375] * 4)
    listing = readers.list_files(spark, str(tmp_path))
    assert listing.first().speaker == "S0001" and listing.first().parent == "S0001"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    assert len(sinks.ledger(files).first().sha256) == 64
    found = readers.resolve_paths(spark.createDataFrame([("a",), ("zz",)], "p string"), "p", ["file:" + str(tmp_path / "S0001")], listing)
    assert {r.p: r.resolved is not None for r in found.collect()} == {"a": True, "zz": False}


def test_sinks_refuse_and_fan_out(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "dev")], "id int, split string")
    sinks.write_once(df, str(tmp_path / "o"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_once(df, str(tmp_path / "o"))
    sinks.write_splits(df, str(tmp_path / "s"), "split", ["train", "dev"], "id")
    assert (tmp_path / "s" / "split=train").is_dir()
    need = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    assert {tuple(r) for r in sinks.missing_files(need, spark.createDataFrame([("a", "9")], "path string, sha256 string")).collect()} == {("a", "differs"), ("b", "missing")}


def test_settings():
    assert readers.parse_settings("a:\n  x: 0.5 # note\n  y: true\n") == {"x": 0.5, "y": True}


def test_streaming_equals_batch(spark, tmp_path):
    commands = ["turnon", "stop"]
    rows = [(s, i, t) for s in (1, 2) for i, t in enumerate(["please tu", "rn on", "now sto", "p", "stopp"])]
    spark.createDataFrame(rows, "session long, seq long, text string").repartition(2).write.parquet(str(tmp_path / "pieces"))
    got = sorted((r.session, r.seq, r.command) for r in matcher.run_once(spark, str(tmp_path / "pieces"), {"session": "session", "seq": "seq", "text": "text"}, commands, threshold=0.2).collect())
    want = []
    for s in (1, 2):
        sentence = ""
        for _, seq, text in (r for r in rows if r[0] == s):
            sentence += text
            hit, _ = matcher.match(sentence, commands, 0.2)
            if hit:
                want.append((s, seq, hit))
                sentence = ""
    assert got == sorted(want) and want


def test_line_numbers_of_several_split_files(spark, tmp_path):
    """Numbers start at 1 in each file, wherever it is split and whichever task reads a split."""
    want = set()
    for name, n in (("a", 300), ("b", 1), ("c", 57)):
        lines = [f"{name} line {i}" if i % 5 else "" for i in range(1, n + 1)]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n" * (name != "c"))
        want |= {(name, i, line) for i, line in enumerate(lines, 1)}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("100b", "1000b", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = [(r.path.rsplit("/", 1)[1][0], r.line_no, r.value) for r in readers.with_line_numbers(spark, str(tmp_path)).collect()]
            assert len(got) == len(want) and set(got) == want
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40b")
        (tmp_path / "t").mkdir()
        (tmp_path / "t" / "x.txt").write_text("".join(f"u{i % 7} {i}\n" for i in range(100)))
        assert {r.utterance: r.text for r in readers.read_transcripts(spark, str(tmp_path / "t")).collect()} == {f"u{i % 7}": str(i) for i in range(100)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
