"""Phrase mining against counts in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from cadenza.llm import phrases


def plain(rows, least, best=2000):
    total, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", raw):
            words = re.findall(rb"[^\x20\x09]+", piece)
            total[lang] += len(words)
            f.update((lang, *words[i : i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
    f = {k: n for k, n in f.items() if n >= least}
    covered = {}
    for (lang, *ws), n in f.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                covered[lang, *ws[i : i + m]] = max(covered.get((lang, *ws[i : i + m]), 0), n)
    scored = {}
    for (lang, *ws), a in f.items():
        if len(ws) < 2 or 100 * covered.get((lang, *ws), 0) >= 100 * a:
            continue
        cuts = []
        for k in range(1, len(ws)):
            left, right = f[lang, *ws[:k]], f[lang, *ws[k:]]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        scored.setdefault(lang, []).append((-score, -a, b" ".join(ws), left, right))
    out = []
    for lang, found in scored.items():
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:best], 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, text string, w1 int, word string, n int").repartition(3)


def odd_rows(seed, n=150):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice(["A", "b", "C", "d e", "Ä", "ä", "f\xa0g", "h", "a b c d e"]) + rng.choice(["", "", "", "", ".", ",", "\n", "\r\n", "!", "\x0b", "\t"]) for _ in range(rng.randrange(40))]
        out.append((rng.choice(["x", "x", "x", "y", None]), rng.choice([" ", "  ", " \t"]).join(words)))
    return out + [(None, None), ("x", ""), ("und", " . ! "), ("z", None), ("x", "x" * 70_000), ("y", "b a " * 3000)]


@pytest.mark.parametrize("heavy, segment, piece, slots", [(1 << 20, 1 << 20, 4 << 20, 1 << 26), (30, 16, 100, 1 << 15), (0, 1, 1, 1 << 15)])
def test_against_plain(spark, heavy, segment, piece, slots):
    """Whatever prefix is split, wherever texts are cut, and however many words and prefixes the filters mix up."""
    bounds = phrases.Bounds(piece=piece, segment=segment, heavy=heavy, slots=slots)
    rows = odd_rows(heavy)
    want = plain(rows, 5)
    assert len({r[0] for r in want}) > 1
    assert mined(frame(spark, rows), least=5, bounds=bounds) == want


def test_best_of_each_language_and_ties(spark):
    rows = odd_rows(1) + [("x", "tie one. tie two. one tie. two tie.")] * 7
    assert mined(frame(spark, rows), least=5, best=9) == plain(rows, 5, best=9)


def test_nothing_to_find(spark):
    df = frame(spark, [("x", "a b c"), (None, None)])
    assert mined(df, least=3) == [] and mined(df.limit(0), least=1) == []


def test_words_that_share_a_number_are_told_apart(spark):
    """With numbers of few bits the first salt mixes words up, and another is taken."""
    rows = odd_rows(2, 60)
    texts = {}
    for lang, text in rows:
        texts.setdefault(lang or "und", []).extend(phrases.parts(text or "", 1 << 20))
    blocks = {lang: phrases.Block(p) for lang, p in texts.items()}
    words = {(lang, b.raw[x:y].tobytes()) for lang, b in blocks.items() for x, y in zip(b.begin, b.end, strict=True)}

    def clear(salt, bits):
        return len(np.unique(np.concatenate([b.numbers(phrases._seed(salt, lang), bits) for lang, b in blocks.items()]))) == len(words)

    bits = next(b for b in range(1, 64) if not clear(phrases.SALTS[0], b) and any(clear(s, b) for s in phrases.SALTS))
    assert mined(frame(spark, rows), least=5, bounds=phrases.Bounds(bits=bits)) == plain(rows, 5)
    with pytest.raises(RuntimeError):
        mined(frame(spark, rows), least=5, bounds=phrases.Bounds(bits=1))


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    cases = [(10**12, 10**14, 10**12, 10**13 + 7), (3 * 10**11 + 1, 9 * 10**13 + 11, 4 * 10**11, 10**12 + 3), (100, 10**14, 100, 10**13), (7, 9, 7, 8)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a long, n long, l long, r long")
    got = df.select("i", phrases.score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [1000 * a * n // (left * right) for a, n, left, right in cases]


def test_growth_of_a_prefix():
    after = np.array([[1, 2, 0, 0], [1, 2, 3, 0], [4, 0, 0, 0]], np.uint64)
    out = []
    phrases._grow((9,), after, np.array([2, 3, 1]), 2, out)
    assert out == [((9, 1), 5), ((9, 1, 2), 5), ((9, 1, 2, 3), 3)]


def test_parts_of_long_texts():
    """Whatever the parts, each phrase of up to five words begins in one of them that has all of it."""
    rng = random.Random(4)
    text = " ".join(rng.choice(["a", "bb", "ccc.", "dd,d", "\n", "eeeee"]) for _ in range(300))
    flat = [w for piece in re.split("[.,\n]", text) for w in [*piece.split(), "."]]
    want = Counter(tuple(flat[i : i + m]) for m in range(1, 6) for i in range(len(flat)) if "." not in flat[i : i + m] and len(flat[i : i + m]) == m)
    for segment in (1, 5, 40, 10_000):
        got = Counter()
        for part in phrases.parts(text, segment):
            b = phrases.Block([part])
            w = [b.raw[x:y].tobytes().decode() for x, y in zip(b.begin, b.end, strict=True)]
            for i in np.flatnonzero(b.starts):
                for m in range(1, 6):
                    if i + m <= len(w) and b.linked[i : i + m - 1].all():
                        got[tuple(w[i : i + m])] += 1
        assert got == want
