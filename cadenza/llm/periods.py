"""Periodic runs of words within each text, by heavy and light lag counting."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import table
from .kernel import bound_batches, chunks, strings, tidy

#: Least words in a run, and least periods.
LEAST, TIMES = 6, 4
#: Bytes of text taken together, and bytes of one text that are split into words at once.
PIECE, SEGMENT = 512 << 10, 1 << 20
#: Occurrences in a text from which a word may be counted by transform, whatever the text's length.
FEW = 64
#: Occurrences whose differences are taken together.
SLICE = 1 << 20
#: Words of a block that are held against the block after it before whole stretches are.
PROBES = 8
#: Periods from which on blocks are probed.
PROBED = 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

Run = tuple[int, int, int]  # start, length, period
Rewrite = Callable[[object, np.ndarray], np.ndarray]


def segments(raw: bytes) -> Iterator[bytes]:
    """A text in parts that end between words."""
    at = 0
    while len(raw) - at > SEGMENT:
        cut = _SPACE.search(raw, at + SEGMENT)
        if not cut:
            break
        yield raw[at : cut.start()]
        at = cut.start()
    yield raw[at:] if at else raw


def coded(raw: bytes, known: dict[bytes, int]) -> np.ndarray:
    """A text's words as numbers; equal words, and no others, have equal numbers."""
    parts = [np.fromiter((known.setdefault(w, len(known)) for w in part.split()), np.int32) for part in segments(raw)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _size(n: int) -> int:
    """A length of transforms, at least n, that is quick."""
    k = 1 << max(3, (n - 1).bit_length())
    return next(m for m in (k // 8 * 5, k // 4 * 3, k) if m >= n)


def lag_matches(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How often words that are q apart are equal, for each text and each q up to a quarter of its words.

    Returns (counts, base): the matches of text t at lag q are ``counts[base[t] + q]``.  Words that a text has few times add the
    differences of their places; for frequent ones the autocorrelation of all of a text's is one inverse transform of their
    summed power spectra.  Sums of whole numbers far below 2**52 round to exactly the counts.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    reach = sizes // TIMES
    base = np.concatenate([[0], np.cumsum(reach + 1)])
    counts = np.zeros(base[-1], np.int64)
    if not len(texts) or not sizes.sum():
        return counts, base
    word = np.concatenate(texts).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = doc * (word.max() + 1) + word
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    often = np.diff(np.append(first, len(key)))
    of = doc[order[first]]
    padded = np.array([_size(int(n + r)) for n, r in zip(sizes, reach, strict=True)])
    limit = np.maximum(FEW, np.sqrt(padded * np.log2(padded)) / 3)
    heavy = often > limit[of]

    group = np.repeat(np.arange(len(first)), often)
    light = np.flatnonzero(~heavy[group])
    group, at, to, most = group[light], place[order[light]], base[doc[order[light]]], reach[doc[order[light]]]
    begin = 0
    while begin < len(group):  # whole groups
        end = begin + SLICE
        end = len(group) if end >= len(group) else int(np.searchsorted(group, group[end], "left"))
        end = end if end > begin else int(np.searchsorted(group, group[begin], "right"))
        left, k, held, n_held = np.arange(begin, end), 1, [], 0
        while len(left):
            left = left[left + k < end]
            left = left[group[left + k] == group[left]]
            apart = at[left + k] - at[left]
            near = apart <= most[left]  # later ones are farther away still
            left = left[near]
            held.append(to[left] + apart[near])
            n_held, k = n_held + len(left), k + 1
            if n_held > SLICE:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
                held, n_held = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        begin = end

    for t in np.unique(of[heavy]):
        m, power = int(padded[t]), 0
        for g in np.flatnonzero(heavy & (of == t)):
            x = np.zeros(m)
            x[place[order[first[g] : first[g] + often[g]]]] = 1
            f = np.fft.rfft(x)
            power = power + (f.real**2 + f.imag**2)
        counts[base[t] : base[t + 1]] += np.rint(np.fft.irfft(power, m)[: reach[t] + 1]).astype(np.int64)
    return counts, base


def _islands(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches of at least so many true values: (start, length)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    start, length = edge[::2], edge[1::2] - edge[::2]
    long = length >= least
    return list(zip(start[long].tolist(), length[long].tolist(), strict=True))


def _stretches(text: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """Maximal stretches of matches at lag q, of at least ``least`` (three blocks of q): (start, matches).

    For longer periods two neighbouring blocks of q words are probed first, both of which any such stretch covers."""
    n = len(text)
    if q < PROBED:
        return _islands(text[:-q] == text[q:], least)
    j = np.arange(n // q - 1)
    probe = (j * q)[:, None] + np.arange(PROBES) * q // PROBES
    good = (text[probe] == text[probe + q]).all(1)
    out = []
    for a, m in _islands(good, TIMES - 2):
        lo, hi = max(0, (a - 1) * q), min(n - q, (a + m + 1) * q)
        out += [(lo + s, k) for s, k in _islands(text[lo:hi] == text[lo + q : hi + q], least)]
    return out


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] * (q > 1)


def runs_of(text: np.ndarray, matches: np.ndarray) -> list[Run]:
    """All runs of a text, by start and period.  ``matches[q]`` counts the equal words that are q apart (overwritten).

    Lags are visited upwards.  Only those with the matches that a run needs are scanned; matches that lie within a run of a
    divisor of q don't count, as no run of smallest period q shares q + 1 words with such a one.
    """
    out: list[Run] = []
    lags = np.arange(len(matches))
    need = np.maximum(LEAST - lags, (TIMES - 1) * lags)
    for q in np.flatnonzero((matches >= need) & (lags > 0)).tolist():
        if matches[q] < need[q]:
            continue
        for start, m in _stretches(text, q, int(need[q])):
            length = m + q
            part = text[start : start + length]
            if any((part[q // p :] == part[: -(q // p)]).all() for p in _primes(q)):
                continue
            out.append((start, length, q))
            again = np.arange(2 * q, min(length, len(matches)), q)
            matches[again] -= length - again
    return sorted(out, key=lambda r: (r[0], r[2]))


def _row(text: np.ndarray, runs: list[Run], word: list[bytes]) -> tuple:
    keep = np.ones(len(text), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    left, digest = text[keep] if runs else text, hashlib.sha256()
    for at in range(0, len(left), SLICE):
        digest.update(b" " * (at > 0) + b" ".join([word[c] for c in left[at : at + SLICE].tolist()]))
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    return (len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], listed, digest.hexdigest())


FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_TYPES = [pa.int64()] * 5 + [pa.string()] * 2


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None, spans: bool = False) -> DataFrame:
    """One row per document: id, n_runs, its run of most periods (start, length, period, exponent_milli), digests of all its runs and of
    the text that is left without repeats; with ``spans`` also ``runs``, an array of (start, length, period).

    A run is a stretch of words with a smallest period q, of at least 6 words and four periods, that can't be longer.
    Words of any run after its first q are repeats.  Of runs with equally many periods the first, then that of smaller period is named.
    ``rewrite`` may replace a text's words, given its id and the numbers of its words, by others of its words.

    Whole texts are treated, each in one task, in time of about n**1.5 for n words at worst; nothing is shuffled.  Null and empty
    texts have no words: no runs, four nulls, digests of nothing.  Rows that repeat and null ids are rows like others; further
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            ids = batch.column(0)
            for i, j in chunks(offsets, PIECE):
                known: dict[bytes, int] = {}
                texts = [coded(data[offsets[d] : offsets[d + 1]].tobytes(), known) for d in range(i, j)]
                if rewrite:
                    texts = [rewrite(ids[d].as_py(), t) for d, t in zip(range(i, j), texts, strict=True)]
                word = list(known)
                counts, base = lag_matches(texts)
                found = [runs_of(t, counts[a:b]) for t, a, b in zip(texts, base[:-1], base[1:], strict=True)]
                columns = list(zip(*[_row(t, r, word) for t, r in zip(texts, found, strict=True)], strict=True))
                arrays = [ids.slice(i, j - i), *[pa.array(c, k) for c, k in zip(columns, _TYPES, strict=True)]]
                names = ["id", *[f.split()[0] for f in FIELDS.split(", ")]]
                if spans:
                    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                    arrays.append(pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found], kind))
                    names.append("runs")
                yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, {FIELDS}" + ", runs array<struct<start:bigint,length:bigint,period:bigint>>" * spans
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


def planted(key: object, text: np.ndarray) -> np.ndarray:
    """The texts of the registered query: every tenth id, by checksum, repeats a stretch of its words up to its end."""
    if key is None or not len(text):
        return text
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return text
    n, g = len(text), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([text[:a], text[a + np.arange(n - a) % p]])


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=planted)
