"""Weighted fair queueing against a queue made in plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from cadenza.llm import mixing

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by handing out the budget again and again until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, capped = share * sum(sizes.values()), {}
    while len(capped) < len(names):
        left, total = budget - sum(capped.values()), sum(weight[s] for s in names if s not in capped)
        above = [s for s in names if s not in capped and left * weight[s] / total > most * sizes[s] + 1e-9]
        if not above:
            return budget, {s: capped.get(s, left * weight[s] / total) for s in names}
        capped |= {s: most * sizes[s] for s in above}
    return budget, capped


def plain_mix(rows, share=1.5, most=2):
    sizes, seen, entries = Counter(), Counter(), defaultdict(list)
    for i, text, source in rows:
        n = len(WORD.findall((text or "").encode()))
        sizes[source] += n
        base = hashlib.md5(":".join(["mix", *([str(i)] if i is not None else []), *([text] if text is not None else [])]).encode()).hexdigest()
        seen[i, source, n, base] += 1
        for turn in range(most):
            copy = seen[i, source, n, base]
            key = int(hashlib.md5(f"{base}:{copy}:{turn}".encode()).hexdigest()[:15], 16)
            entries[source].append((turn, key, base, copy, i, n))
    budget, targets = plain_targets(sizes, share=share, most=most)
    queue = []
    for rank, source in enumerate(targets):
        done = 0
        for turn, key, base, copy, i, n in sorted(entries[source], key=lambda e: e[:4]):
            done += n
            queue.append((done / targets[source] if targets[source] else 0, rank, turn, key, base, copy, i, n, source))
    taken, until = Counter(), 0
    for *_, base, copy, i, n, source in sorted(queue, key=lambda e: e[:6]):
        until += n
        taken[i, n, base, copy, source] += n * (until <= budget)
    return sorted(((i, n, sizes[s], round(targets[s], 6), t) for (i, n, _, _, s), t in taken.items()), key=repr)


def result(df):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=repr)


SCHEMA = "doc_id long, text string, source string, size int, turn string, id string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", "i", 7) for r in rows], SCHEMA).repartition(3)


ODD = [(None, "a b c", "s"), (1, None, "s"), (2, "", None), (3, " \n\t ", "s"), (4, "x" * 70_000, "t"), (5, "two words", "s"), (5, "two words", "s"), (5, "two words", None), (5, "other words here", "t"), (6, "wort " * 3000, "t"), (7, "a\x0bb c", "Ω"), (8, "nul", "")]


def test_odd_rows_against_plain(spark):
    df = frame(spark, ODD)
    assert result(mixing.mix_sources(df)) == plain_mix(ODD)
    assert mixing.mix_sources(df.limit(0)).count() == 0 and mixing.mixture(df.limit(0)).count() == 0
    nothing = [(1, None, "s"), (2, " ", None)]
    assert result(mixing.mix_sources(frame(spark, nothing))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_hot_source_runs_and_copies(spark, monkeypatch):
    """A third of all rows in one source, a quarter of them equal; runs of a few entries; any number of ranges; three turns."""
    monkeypatch.setattr(mixing, "RUN", 4)
    rows = [(i, "w " * (1 + i * 7 % 23), "hot" if i % 3 else f"s{i % 9}") for i in range(300)] + [(7, "same text", "hot")] * 100
    assert result(mixing.mix_sources(frame(spark, rows))) == plain_mix(rows)
    assert result(mixing.mix_sources(frame(spark, rows), share=2.5, most=3)) == plain_mix(rows, share=2.5, most=3)


def test_sources_come_near_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    source = dict(docs.select("doc_id", "source").collect())
    taken, target, longest = Counter(), {}, Counter()
    for r in mixing.mix_sources(docs).collect():
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s], longest[s] = r.target, max(longest[s], r["size"])
        assert r.taken in (0, r["size"], 2 * r["size"])
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in target)
    assert sum(taken.values()) == pytest.approx(sum(target.values()), rel=1e-3)


def test_mixture_is_the_queue_in_order(spark):
    rows = [(i, "w " * (1 + i % 5), f"s{i % 4}") for i in range(200)]
    got = mixing.mixture(frame(spark, rows)).collect()
    assert [r.finish for r in got] == sorted(r.finish for r in got)
    at = 0
    for r in got:
        assert r.before == at
        at += r["size"]
    assert got == mixing.mixture(frame(spark, rows[::-1])).collect()
