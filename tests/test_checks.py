"""Checks hold whatever is asked of a result: also where no column of it is read."""

import pytest
from cadenza.operators import paired, relational
from cadenza.sources import readers
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def fails(df, told):
    for ask in (lambda d: d.count(), lambda d: d.collect(), lambda d: d.groupBy(F.lit(1)).count().collect(), lambda d: d.select(d.columns[-1]).collect(), lambda d: d.write.format("noop").mode("overwrite").save()):
        with pytest.raises(PySparkException, match=told):
            ask(df)


def test_repeated_keys(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    assert relational.combined([one, one.withColumn("id", F.col("id") + 2)], "id").count() == 4
    fails(relational.combined([one, one], "id"), "repeated key")
    fails(relational.combined([one.union(one)], "id"), "repeated key 1|repeated key 2")


def test_missing_references(spark):
    rows, known = spark.createDataFrame([(1, "a"), (3, "b"), (None, "c")], "id int, x string"), spark.createDataFrame([(1, "t")], "id int, text string")
    assert relational.referenced(rows.filter("id = 1"), known, "id").count() == 1
    fails(relational.referenced(rows.filter("id > 1"), known, "id"), "no entry for 3")
    fails(relational.referenced(rows.filter("id IS NULL"), known, "id"), "no entry for null")


def test_strict_lines(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('﻿{"a": 1}\n\n{"a": 2, "b": "x"}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n[2]\n')
    (tmp_path / "cut.jsonl").write_text('{"a": 1}\n{"a": \n')
    assert readers.read_jsonl(spark, str(tmp_path / "good.jsonl"), "a int, b string", strict=True).count() == 2
    for name in ("bad", "cut"):
        fails(readers.read_jsonl(spark, str(tmp_path / f"{name}.jsonl"), "a int, b string", strict=True), "not a JSON object")
        assert readers.read_jsonl(spark, str(tmp_path / f"{name}.jsonl"), "a int, b string").count() == 1


def test_strict_transcripts(spark, tmp_path):
    (tmp_path / "good.txt").write_text("u1 a b\nu2 c\n")
    (tmp_path / "twice.txt").write_text("u1 a\nu1 b\n")
    (tmp_path / "empty.txt").write_text("u1 a\nu2\n")
    assert readers.read_transcripts(spark, str(tmp_path / "good.txt"), strict=True).count() == 2
    for name in ("twice", "empty"):
        fails(readers.read_transcripts(spark, str(tmp_path / f"{name}.txt"), strict=True), "repeated or empty transcript")


def test_votes(spark):
    runs = [(1, True, "m"), (2, True, "m"), (3, False, "m")]
    kind = "seed int, passed boolean, manifest string"
    assert paired.seed_vote(spark.createDataFrame(runs, kind), 1).first()["verdict"] == "ACCEPT_B1_CANDIDATE"
    for wrong in (runs[:2], [*runs[:2], (2, True, "m")], [*runs[:2], (3, True, "other")]):
        fails(paired.seed_vote(spark.createDataFrame(wrong, kind), 1), "three runs of distinct seeds")
