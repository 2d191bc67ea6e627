"""The indexed similarity join against all pairs in plain Python."""

import random
from collections import Counter

import pytest
from cadenza.operators import matching
from pyspark.sql import functions as F


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def plain_nearest(texts, bank):
    out = set()
    for t in {t for t in texts if t is not None}:
        scored = [(edits(t, p) / max(len(t), len(p)), o, p) for o, p in bank] if t else []
        score, _, phrase = min(scored, default=(1.0, 0, None))
        out.add((t, phrase, round(score, 9)))
    return out


def plain_match(texts, bank, threshold):
    out = set()
    for t in {t for t in texts if t is not None}:
        body, scored = "".join(c for c in t if c not in "，。、？！?!,. "), []
        for o, p in bank if body else ():
            for w in (len(p) - 1, len(p), len(p) + 1):
                parts = [body[i : i + w] for i in range(max(1, len(body) - w + 1))] if w >= 1 else []
                scored += [(edits(x, p) / max(len(x), len(p)), o, p) for x in parts]
        score, _, phrase = min(scored, default=(1.0, 0, None))
        out.add((t, phrase if score <= threshold and score < 1 else None, round(min(score, 1.0), 9)))
    return out


def changed(rng, s, letters):
    s = list(s)
    for _ in range(rng.randrange(9)):
        i = rng.randrange(len(s) + 1)
        s[i : i + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
    return "".join(s)


def case(seed, letters):
    rng = random.Random(seed)
    bank = [(o, "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 21])))) for o in range(40)]
    bank = [(o, p) for o, p in bank if p not in [q for x, q in bank if x < o]]
    texts = [changed(rng, rng.choice(bank)[1], letters) for _ in range(60)] + ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(20)]
    return [*texts, None, "", "#", "##########", bank[3][1]], bank


def frames(spark, texts, bank):
    return spark.createDataFrame([(t, 1) for t in texts], "text string, s int").repartition(3), spark.createDataFrame(bank, "ord int, phrase string").repartition(2)


@pytest.mark.parametrize("seed, letters", [(1, "ab"), (2, "abcdefghij kl"), (3, "打开关闭灯空调窗")])
def test_nearest_phrase(spark, monkeypatch, seed, letters):
    texts, bank = case(seed, letters)
    a, b = frames(spark, texts, bank)
    want = plain_nearest(texts, bank)
    assert {(r.text, r.phrase, round(r.distance, 9)) for r in matching.nearest_phrase(a, "text", b).collect()} == want
    monkeypatch.setattr(matching, "FEW", 3)
    monkeypatch.setattr(matching, "BANK_BLOCK", 3)
    monkeypatch.setattr(matching, "TEXT_BLOCK", 5)
    monkeypatch.setattr(matching, "EDITS", (1,))
    got = matching.nearest_phrase(a, "text", b).collect()
    assert {(r.text, r.phrase, round(r.distance, 9)) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("seed, letters", [(4, "abc"), (5, "开关灯，窗 。")])
def test_match_commands(spark, monkeypatch, seed, letters):
    monkeypatch.setattr(matching, "FEW", 0 if letters == "abc" else 64)
    texts, bank = case(seed, letters)
    a, b = frames(spark, texts, bank)
    threshold = 0.35 if letters == "abc" else 1.0
    got = matching.match_commands(a, "text", b, threshold).collect()
    assert {(r.text, r.command, round(r.score, 9)) for r in got} == plain_match(texts, bank, threshold)
    assert len(got) == len({t for t in texts if t is not None})


def test_empty_sides(spark):
    a, b = frames(spark, ["x", "", None], [(0, "y")])
    assert {(r.text, r.phrase, r.distance) for r in matching.nearest_phrase(a, "text", b.limit(0)).collect()} == {("x", None, 1.0), ("", None, 1.0)}
    assert {(r.text, r.command, r.score) for r in matching.match_commands(a, "text", b.limit(0)).collect()} == {("x", None, 1.0), ("", None, 1.0)}
    assert matching.nearest_phrase(a.limit(0), "text", b).count() == 0 and matching.match_commands(a.limit(0), "text", b).count() == 0


def test_no_product_in_any_plan(spark, capsys):
    """Texts and phrases meet by equality only, also where the last pairs are compared."""
    texts, bank = case(6, "abcdef")
    a, b = frames(spark, texts, bank)
    known = b.withColumn("m", F.length("phrase"))
    strings = a.filter("text <> ''").select(F.col("text").alias("g"), F.col("text").alias("s"), F.lit(1).alias("lo"), F.lit(99).alias("hi"), F.length("text").alias("n"))
    open_ = strings.select("g", F.lit(1.0).alias("most")).distinct()
    for df in (matching._in_blocks(strings, open_, known, Counter(len(p) for _, p in bank)), matching._substrings(strings, 2).join(matching._pieces(known, 2), "piece")):
        df.explain()
        plan = capsys.readouterr().out
        assert "HashJoin" in plan or "SortMergeJoin" in plan
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
