"""Runs by heavy and light lag counting against a plain search of every lag and place."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from cadenza.llm import periods


def plain_runs(words):
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(words[x] == words[x + d] for x in range(i, i + length - d)) for d in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(key, text, plant=True):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(key).encode())
    if plant and key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    drop = {x for s, m, q in runs for x in range(s + q, s + m)}
    left = b" ".join(w for x, w in enumerate(words) if x not in drop)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (key, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def found(words):
    known = {}
    text = periods.coded(b" ".join(words), known)
    counts, base = periods.lag_matches([text])
    return periods.runs_of(text, counts[base[0] : base[1]])


def odd_words(rng):
    """Words of a small or large alphabet, with repeats of repeats."""
    out = [b"w%d" % rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 60))]
    for _ in range(rng.randrange(4)):
        a, b = sorted(rng.choices(range(len(out) + 1), k=2))
        out[b:b] = out[a:b] * rng.randrange(1, 9)
        out = out[:260]
    return out


@pytest.mark.parametrize("few, probed", [(64, 16), (0, 2), (3, 4)])
def test_runs_against_plain_search(monkeypatch, few, probed):
    """Whatever is counted by transform, and from whatever period on blocks are probed."""
    monkeypatch.setattr(periods, "FEW", few)
    monkeypatch.setattr(periods, "PROBED", probed)
    monkeypatch.setattr(periods, "SLICE", 50)
    rng = random.Random(few)
    for _ in range(250):
        words = odd_words(rng)
        assert found(words) == plain_runs(words), words


def test_matches_are_counted_exactly(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [np.minimum(rng.geometric(0.05 + 0.3 * (i % 3), n), 40).astype(np.int32) for i, n in enumerate((0, 1, 3, 4, 50, 3000, 700))]
    for few in (0, 8, 1 << 30):
        monkeypatch.setattr(periods, "FEW", few)
        counts, base = periods.lag_matches(texts)
        for t, text in enumerate(texts):
            for q in range(1, len(text) // 4 + 1):
                assert counts[base[t] + q] == (text[q:] == text[:-q]).sum()


def test_long_texts():
    """One word, a short and a long period, in texts that no search of every lag would finish."""
    rng = random.Random(5)
    other = [b"v%d" % rng.randrange(10**6) for _ in range(30_000)]
    assert found([b"a"] * 100_000) == [(0, 100_000, 1)]
    assert found([b"a", b"b"] * 50_000 + [b"c"]) == [(0, 100_000, 2)]
    assert found(other + other[-5000:] * 4 + [b"."]) == [(25_000, 25_000, 5000)]
    assert found(other) == []


def test_segments(monkeypatch):
    monkeypatch.setattr(periods, "SEGMENT", 7)
    raw = b" one two\tthree\n\nfour_long_words_here five" + b" x" * 20 + b" "
    known = {}
    codes = periods.coded(raw, known)
    assert [list(known)[c] for c in codes] == raw.split()


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    short = [r for r in docs.collect() if len((r.text or "").split()) < 600]
    assert sum(zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in short) > 5
    got = [r for r in rows(periods.op12_periodic_runs(spark, "/root/testdata/sf0.001")) if r[0] in {s.doc_id for s in short}]
    assert got == sorted((plain_row(r.doc_id, r.text) for r in short), key=repr)


def test_odd_rows(spark):
    texts = [(None, "a a a a a a a"), (1, None), (2, ""), (3, " \n\t "), (4, "x" * 70_000), (5, "b a b a b a b a c"), (5, "b a b a b a b a c"), (6, "a\x0ba a\xa0a a a a a"), (7, "Ä Ä Ä Ä Ä Ä ä"), (90, "eins zwei drei " * 30)]
    df = spark.createDataFrame([(*t, 1, "p", 2) for t in texts], "doc_id long, text string, id int, period string, start int").repartition(3)
    assert rows(periods.periodic_runs(df, rewrite=periods.planted)) == sorted((plain_row(*t) for t in texts), key=repr)
    assert rows(periods.periodic_runs(df)) == sorted((plain_row(*t, plant=False) for t in texts), key=repr)
    assert rows(periods.periodic_runs(df.limit(0))) == []
    spans = {r.doc_id: [tuple(x) for x in r.runs] for r in periods.periodic_runs(df, spans=True).collect()}
    assert spans[None] == [(0, 7, 1)] and spans[5] == [(0, 8, 2)] and spans[1] == []
