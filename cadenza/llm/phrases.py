"""Collocations: frequent contiguous phrases by prefix projection, scored by their weakest cut."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import materialize, table
from .kernel import _U, BYTE_VALUE, bound_batches, mix, powers, tidy

#: Words in a phrase at most.
LONGEST = 5
#: Words are told apart by their numbers; whether that holds is checked, and if not, another salt is taken.
SALTS = ("", "1", "2", "3")
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]


@dataclass(frozen=True)
class Bounds:
    """What bounds memory: results are the same whatever they are."""

    #: Bytes of text of a language that are taken together, of all languages that wait, and of one text that are split at once.
    piece: int = 4 << 20
    wait: int = 24 << 20
    segment: int = 1 << 20
    #: Occurrences of a prefix from which on its longer prefixes become tasks in its place, and of all prefixes of a task.
    heavy: int = 1 << 20
    #: Slots of a filter of words or phrases (a multiple of 32768): one bit each, so 8 MiB whatever the data.
    slots: int = 1 << 26
    #: Bits in the number of a word.
    bits: int = 64


#: Ends of pieces, all told by one of them; what separates words; A-Z.
_ENDS, _BLANK = b".,;:!?\n\x0b\x0c\r", b"\t"
_PLAIN = bytes.maketrans(_ENDS + _BLANK + bytes(range(65, 91)), b"." * len(_ENDS) + b" " + bytes(range(97, 123)))


def _edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end."""
    solid = ((raw != 32) & (raw != 46)).view(np.int8)
    edge = np.flatnonzero(np.diff(solid, prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def parts(text: str, segment: int) -> Iterator[tuple[bytes, int]]:
    """A plain text in parts, and how many of a part's last words the next part begins with."""
    raw = text.encode().translate(_PLAIN)
    at = seen = 0
    while len(raw) - seen > segment:
        cut = raw.find(b" ", seen + segment)
        if cut < 0:
            break
        begin, _ = _edges(np.frombuffer(raw[at:cut], np.uint8))
        again = min(LONGEST - 1, len(begin))
        yield raw[at:cut], again
        at, seen = (at + int(begin[-again]) if again else cut), cut
    yield raw[at:] if at else raw, 0


class Block:
    """The words of several texts of one language.

    ``begin`` and ``end`` in ``raw``; ``linked``: the next word is in the same piece; ``starts``: phrases that begin there are
    counted here (those at a part's last words are in the next part)."""

    def __init__(self, held: list[tuple[bytes, int]]):
        self.raw = np.frombuffer(b".".join(p for p, _ in held), np.uint8)
        n = len(self.raw)
        self.begin, self.end = _edges(self.raw)
        p, inverse = powers(n + 1)
        total = np.zeros(n + 1, _U)
        np.cumsum(BYTE_VALUE[self.raw] * p[:n], out=total[1:])
        self.hash = (total[self.end] - total[self.begin]) * inverse[self.begin]
        piece = np.cumsum(self.raw == 46, dtype=np.int32)[self.begin]
        self.linked = np.append(piece[1:] == piece[:-1], False)[: len(piece)]
        self.starts = np.ones(len(piece), bool)
        last = np.searchsorted(self.begin, np.cumsum([len(p) + 1 for p, _ in held]))
        for at, (_, again) in zip(last, held, strict=True):
            self.starts[at - again : at] = False

    def numbers(self, seed: int, bits: int) -> np.ndarray:
        """A number for each word, never 0."""
        return np.maximum(mix(self.hash ^ _U(seed)) >> _U(64 - bits), _U(1))


def _seed(salt: str, lang: str) -> int:
    return xxhash.xxh64_intdigest((salt + "\0" + lang).encode())


def _blocks(batches: Iterator[pa.RecordBatch], bounds: Bounds) -> Iterator[tuple[str, Block]]:
    """Texts of a task by language, some ``piece`` bytes at a time."""
    held: dict[str, list[tuple[bytes, int]]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for part in parts(text, bounds.segment):
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part[0]) + 1
                for k in list(size) if sum(size.values()) > bounds.wait else [lang] if size[lang] > bounds.piece else []:
                    del size[k]
                    yield k, Block(held.pop(k))
    yield from ((k, Block(v)) for k, v in held.items())


def _slot(keys: np.ndarray, slots: int) -> np.ndarray:
    """The slot of each prefix (a row of word numbers, 0 from its end on)."""
    x = np.zeros(len(keys), _U)
    for i in range(keys.shape[1]):
        x = mix(x ^ keys[:, i])
    return x % _U(slots)


def _bitmap(rows: DataFrame, slots: int) -> np.ndarray:
    """The filter whose bits are set at the slots in column ``slot``: made by the executors, of a fixed size on the driver."""
    place = F.col("slot") + 1  # buckets and positions count from 1
    bits = rows.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(slots // 8, np.uint8)
    for b, part in bits.collect():
        at = (b - 1) * len(part)
        out[at : at + len(part)] = np.frombuffer(part, np.uint8)
    return out


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a filter has each key."""
    at = _slot(keys, 8 * len(bits))
    return (bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


def _words(texts: DataFrame, salt: str, bounds: Bounds) -> DataFrame:
    """(lang, word, h, slot, n): how often each language has each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block in _blocks(batches, bounds):
            h, raw = block.numbers(_seed(salt, lang), bounds.bits), block.raw.tobytes()
            _, first, which = np.unique(h, return_index=True, return_inverse=True)
            like, length = first[which], block.end - block.begin
            # Words of a number are held against the first of them, byte by byte; another word gets a row of its own.
            same = length == length[like]
            step = np.arange(length[same].sum()) - np.repeat(np.cumsum(length[same]) - length[same], length[same])
            alike = block.raw[np.repeat(block.begin[same], length[same]) + step] == block.raw[np.repeat(block.begin[like[same]], length[same]) + step]
            if len(alike):
                same[same] = np.logical_and.reduceat(alike, np.cumsum(length[same]) - length[same])
            n = np.bincount(which[same & block.starts], minlength=len(first))
            at = np.concatenate([first[n > 0], np.flatnonzero(~same & block.starts)])
            n = np.concatenate([n[n > 0], np.ones(len(at) - (n > 0).sum(), np.int64)])
            for i in range(0, len(at), 1 << 16):
                a = at[i : i + (1 << 16)]
                word = [raw[x:y].decode() for x, y in zip(block.begin[a].tolist(), block.end[a].tolist(), strict=True)]
                arrays = [pa.array([lang] * len(a)), pa.array(word, pa.string()), pa.array(h[a].view(np.int64)), pa.array(_slot(h[a, None], bounds.slots).astype(np.int64)), pa.array(n[i : i + (1 << 16)])]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "word", "h", "slot", "n"])

    counted = texts.mapInArrow(tidy(run), "lang string, word string, h long, slot long, n long")
    return counted.groupBy("lang", "word", "h", "slot").agg(F.sum("n").alias("n"))


def _summed(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, with their sums."""
    if not len(rows):
        return rows, n
    order = np.lexsort(rows.T[::-1])
    rows, n = rows[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]))
    return rows[new], np.add.reduceat(n, new)


def _dealt(rows: np.ndarray, n: np.ndarray, depth: np.ndarray, key: np.ndarray, tasks: int) -> Iterator[pa.RecordBatch]:
    """Rows, packed by task: (task, rows, n, depth), the last three as bytes."""
    task = _slot(key, tasks).astype(np.int64)
    order = np.argsort(task, kind="stable")
    rows, n, depth, task = np.ascontiguousarray(rows[order]), n[order].astype(np.uint32), depth[order].astype(np.uint8), task[order]
    at = np.concatenate([[0], np.flatnonzero(np.diff(task)) + 1, [len(task)]]) if len(task) else np.zeros(1, np.int64)

    def packed(x: np.ndarray) -> pa.Array:
        size = x.nbytes // max(1, len(x))
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * size).astype(np.int32)), pa.py_buffer(x)])

    whole = pa.RecordBatch.from_arrays([pa.array(task[at[:-1]]), packed(rows), packed(n), packed(depth)], _DEALT)
    for i in range(0, len(whole), 256):
        yield whole.slice(i, 256)


_DEALT = ["task", "rows", "n", "depth"]
_DEALT_TYPE = "task long, rows binary, n binary, depth binary"
_FOUND = ", ".join(f"{w} long" for w in WORDS) + ", slot long, n long"


def _unpacked(group: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bytes_of = lambda c: b"".join(group.column(c).to_pylist())
    return np.frombuffer(bytes_of("rows"), _U).reshape(-1, width), np.frombuffer(bytes_of("n"), np.uint32).astype(np.int64), np.frombuffer(bytes_of("depth"), np.uint8)


def _found(rows: np.ndarray, n: np.ndarray, bounds: Bounds) -> pa.RecordBatch:
    """Phrases (0 from their end on) as a batch of w1, ..., slot, n."""
    full = np.zeros((len(rows), LONGEST), _U)
    full[:, : rows.shape[1]] = rows
    return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(full[:, i]).view(np.int64)) for i in range(LONGEST)], pa.array(_slot(rows, bounds.slots).astype(np.int64)), pa.array(n)], [*WORDS, "slot", "n"])


def _frequent_words(block: Block, seed: int, frequent: np.ndarray, bounds: Bounds) -> np.ndarray:
    """Numbers of the words, 0 for those that the filter lacks, and zeros beyond the last."""
    h = block.numbers(seed, bounds.bits)
    h[~_has(frequent, h[:, None])] = 0
    return np.concatenate([h, np.zeros(LONGEST, _U)])


def _pairs(texts: DataFrame, salt: str, least: int, frequent, heavy, tasks: int, bounds: Bounds) -> DataFrame:
    """(w1, w2, ..., slot, n) of all frequent phrases of two words.

    Each word's task gets the words that follow it; a heavy word's followers are dealt to many tasks, each follower to one."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block in _blocks(batches, bounds):
            h = _frequent_words(block, _seed(salt, lang), frequent.value, bounds)
            i = np.flatnonzero(block.starts & block.linked & (h[: len(block.linked)] != 0) & (h[1 : len(block.linked) + 1] != 0))
            rows, n = _summed(np.stack([h[i], h[i + 1]], 1), np.ones(len(i), np.int64))
            key = rows.copy()
            key[~_has(heavy.value, rows[:, :1]), 1] = 0
            yield from _dealt(rows, n, np.ones(len(rows)), key, tasks)

    def count(group: pa.Table) -> pa.Table:
        rows, n, _ = _unpacked(group, 2)
        rows, n = _summed(rows, n)
        return pa.Table.from_batches([_found(rows[n >= least], n[n >= least], bounds)])

    return texts.mapInArrow(tidy(project), _DEALT_TYPE).groupBy("task").applyInArrow(count, _FOUND)


def _chains(block: Block, seed: int, frequent: np.ndarray, pairs: np.ndarray, bounds: Bounds) -> np.ndarray:
    """For each place at which a counted phrase of three words may begin: the numbers of its words and of those after it, 0
    from the first on that isn't in a frequent pair with the one before."""
    h = _frequent_words(block, seed, frequent, bounds)
    size = len(block.linked)
    ok = np.zeros(size + LONGEST, bool)
    ok[:size] = block.linked & (h[:size] != 0) & (h[1 : size + 1] != 0)
    i = np.flatnonzero(ok)
    ok[i] = _has(pairs, np.stack([h[i], h[i + 1]], 1))
    i = np.flatnonzero(block.starts & ok[:size] & ok[1 : size + 1])
    rows = np.stack([h[i + j] for j in range(LONGEST)], 1)
    for j in range(2, LONGEST):
        rows[~ok[i + j - 1] | (rows[:, j - 1] == 0), j] = 0
    return rows


def _depth(rows: np.ndarray, heavy: list[np.ndarray]) -> np.ndarray:
    """The length of each row's shortest prefix, of two words at least, that isn't heavy."""
    depth = np.full(len(rows), 2, np.int64)
    still = np.ones(len(rows), bool)
    for width, bits in enumerate(heavy, 2):
        still &= _has(bits, rows[:, :width])
        depth[still] = width + 1
    return depth


def _longer(texts: DataFrame, salt: str, frequent, pairs, heavy: list, bounds: Bounds) -> DataFrame:
    """(w1, ..., slot, n) of the phrases of one word more than the longest heavy prefixes that begin with one of these."""
    width = len(heavy) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block in _blocks(batches, bounds):
            rows = _chains(block, _seed(salt, lang), frequent.value, pairs.value, bounds)
            rows = rows[(_depth(rows, [b.value for b in heavy]) == width) & (rows[:, width - 1] != 0), :width]
            yield _found(*_summed(rows, np.ones(len(rows), np.int64)), bounds)

    return texts.mapInArrow(tidy(run), _FOUND).groupBy(*WORDS, "slot").agg(F.sum("n").alias("n"))


def _grow(prefix: tuple[int, ...], after: np.ndarray, n: np.ndarray, least: int, out: list[tuple[tuple[int, ...], int]]) -> None:
    """All frequent phrases that go on from a prefix, depth first.  ``after``: distinct rows of what follows it, in order,
    0 from the end on; ``n``: how often each does."""
    if not after.shape[1] or n.sum() < least:
        return
    at = np.concatenate([[0], np.flatnonzero(after[1:, 0] != after[:-1, 0]) + 1, [len(after)]])
    sums = np.add.reduceat(n, at[:-1])
    for i in np.flatnonzero((sums >= least) & (after[at[:-1], 0] != 0)).tolist():
        longer = (*prefix, int(after[at[i], 0]))
        out.append((longer, int(sums[i])))
        _grow(longer, after[at[i] : at[i + 1], 1:], n[at[i] : at[i + 1]], least, out)


def _grown(texts: DataFrame, salt: str, least: int, frequent, pairs, heavy: list, tasks: int, bounds: Bounds) -> DataFrame:
    """(w1, ..., slot, n) of the frequent phrases that go on from light prefixes: each prefix, with what follows each of its
    occurrences, is grown in one task."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block in _blocks(batches, bounds):
            rows, n = _summed(rows := _chains(block, _seed(salt, lang), frequent.value, pairs.value, bounds), np.ones(len(rows), np.int64))
            depth = _depth(rows, [b.value for b in heavy])
            some = depth < LONGEST
            rows, n, depth = rows[some], n[some], depth[some]
            some = rows[np.arange(len(rows)), depth] != 0
            rows, n, depth = rows[some], n[some], depth[some]
            key = np.where(np.arange(LONGEST) < depth[:, None], rows, _U(0))
            yield from _dealt(rows, n, depth, key, tasks)

    def mine(group: pa.Table) -> pa.Table:
        rows, n, depth = _unpacked(group, LONGEST)
        out: list[tuple[tuple[int, ...], int]] = []
        for width in np.unique(depth).tolist():
            own, times = _summed(rows[depth == width], n[depth == width])
            at = np.concatenate([[0], np.flatnonzero((own[1:, :width] != own[:-1, :width]).any(1)) + 1, [len(own)]])
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                _grow(tuple(own[i, :width].tolist()), own[i:j, width:], times[i:j], least, out)
        keys = np.zeros((len(out), LONGEST), _U)
        for i, (phrase, _) in enumerate(out):
            keys[i, : len(phrase)] = phrase
        return pa.Table.from_batches([_found(keys, np.array([x for _, x in out], np.int64), bounds)])

    return texts.mapInArrow(tidy(project), _DEALT_TYPE).groupBy("task").applyInArrow(mine, _FOUND)


def frequent_phrases(texts: DataFrame, least: int, bounds: Bounds = Bounds()) -> tuple[DataFrame, DataFrame]:
    """Words by language (lang, word, h, n), and all phrases of up to ``LONGEST`` words, single ones too, that occur at least
    ``least`` times, as the numbers of their words: (w1, ..., f).  ``texts`` has lang and text, without nulls.

    Occurrences are projected twice: of frequent words, with the word that follows, and of frequent pairs, with what follows as
    far as its words are frequent pairs too.  Either time those of a prefix go to one task, which grows phrases rightwards; equal
    ones of a block of text travel as one.  A prefix of more than ``bounds.heavy`` occurrences is no task: its extensions by
    a word are counted apart and become prefixes in its place.  What tells tasks of texts which words and pairs are
    frequent, and which prefixes heavy, are filters of a fixed size; a false hit costs time only.
    """
    spark = texts.sparkSession
    bound_batches(spark)
    shared = lambda rows: spark.sparkContext.broadcast(_bitmap(rows, bounds.slots))
    often, large = F.col("n") >= least, F.col("n") > bounds.heavy
    tasks = lambda rows: int(rows.filter(often).agg(F.sum("n")).first()[0] or 0) // max(1, bounds.heavy // 4) + 1
    for salt in SALTS:
        words = materialize(_words(texts, salt, bounds), "phrase-words")
        mixed = words.groupBy("h").agg(F.count("*").alias("words"), F.max("n").alias("n")).filter(often & (F.col("words") > 1))
        if mixed.isEmpty():
            break
    else:
        raise RuntimeError("words can't be told apart by their numbers")
    frequent = shared(words.filter(often))
    known = [materialize(_pairs(texts, salt, least, frequent, shared(words.filter(large)), tasks(words), bounds), "phrase-pairs")]
    pairs, heavy = shared(known[0]), []
    while len(heavy) < LONGEST - 2 and not known[-1].filter(large).isEmpty():
        heavy.append(shared(known[-1].filter(large)))
        known.append(materialize(_longer(texts, salt, frequent, pairs, heavy, bounds), "phrase-longer"))
    found = _grown(texts, salt, least, frequent, pairs, heavy, tasks(known[0]), bounds)
    none = [F.lit(0).cast("long").alias(w) for w in WORDS[1:]]
    for k in (words.select(F.col("h").alias("w1"), *none, "slot", "n"), *known):
        found = found.unionByName(k.filter(often))
    return words, materialize(found.select(*WORDS, F.col("n").alias("f")), "phrase-frequent")


def _cut(k: int, right: bool) -> list:
    """The words of a phrase before, or after, its first k, as columns w1, ..."""
    part = WORDS[k:] if right else WORDS[:k]
    return [F.col(w).alias(o) for w, o in zip(part, WORDS, strict=False)] + [F.lit(0).cast("long").alias(o) for o in WORDS[len(part) :]]


def score(a, n, lr_left, lr_right):
    """floor(1000 * a * n / (l * r)) of whole numbers, in decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    times = (wide(a) * wide(n)).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", times, (wide(lr_left) * wide(lr_right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, *, least: int = 100, best: int = 2000, text_col: str = "text", lang_col: str = "lang", bounds: Bounds = Bounds()) -> DataFrame:
    """Each language's best phrases of 2 to 5 words by their weakest cut: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split at ``.,;:!?`` and ends of lines; a phrase lies within a piece.  ``a``, ``l`` and
    ``r`` count a phrase, its words before its weakest cut and those after it, ``n`` all words of the language.  Phrases
    (of ``a >= least``) that lie within a longer one as frequent as they are left out.

    A null text is empty; a null language is ``und``.  Equal texts count each by itself.  Ties of score go to the higher ``a``, then to
    the phrase that comes first in its bytes; cuts of equal score to the first.  Columns other than the two named are ignored,
    whatever their names; an empty table, or one without frequent phrases, gives an empty result.
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words, found = frequent_phrases(texts, least, bounds)
    many = found.filter("w2 <> 0").withColumnRenamed("f", "a")

    # A phrase within one that is as frequent lies within one of a word more that is.
    size = sum(F.when(F.col(w) != 0, 1).otherwise(0) for w in WORDS)
    within = None
    for m in range(3, LONGEST + 1):
        longer = many.filter(size == m)
        for part in (longer.select(*_cut(m - 1, False), "a"), longer.select(*_cut(1, True), "a")):
            within = part if within is None else within.unionByName(part)
    covered = within.distinct()
    whole = materialize(many.join(covered, [*WORDS, "a"], "left_anti"), "phrase-whole")

    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    named = words.filter(F.col("n") >= least).select("lang", "word", "h")
    cuts = None
    for k in range(1, LONGEST):
        here = whole.filter(F.col(WORDS[k]) != 0).select(F.struct(*WORDS).alias("phrase"), "a", F.lit(k).alias("k"), F.struct(*_cut(k, False)).alias("left"), F.struct(*_cut(k, True)).alias("right"))
        cuts = here if cuts is None else cuts.unionByName(here)
    f = found.select(F.struct(*WORDS).alias("part"), "f")
    cuts = cuts.join(f.select(F.col("part").alias("left"), F.col("f").alias("l")), "left").join(f.select(F.col("part").alias("right"), F.col("f").alias("r")), "right")
    cuts = cuts.join(named.select("lang", F.col("h").alias("first")), F.col("phrase.w1") == F.col("first")).join(total, "lang")
    cuts = cuts.withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).cast("long"))
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("x")).select("lang", "phrase.*", "x.*")
    # Names are needed for what may be among the best: whatever is no worse by score and frequency than the last of these.
    order = [F.desc("score"), F.desc("a")]
    near = weakest.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= best)
    for w in WORDS:
        near = near.join(named.select(F.col("h").alias(w), F.col("word").alias(f"{w}_word")), w, "left")
    near = near.withColumn("phrase", F.concat_ws(" ", *[f"{w}_word" for w in WORDS]))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_mining(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
    n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
    g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i : i + m - 1], ' '))) AS phrase
          FROM w, range(1, 6) AS sizes(m) WHERE len(ws) >= m),
    f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= 100),
    c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2),
    s AS (SELECT lang, array_to_string(ws[i : i + j - 1], ' ') AS phrase, max(a) AS longer
          FROM c, range(2, 5) AS lengths(j), range(1, 6) AS starts(i) WHERE j < m AND i + j - 1 <= m GROUP BY ALL),
    k AS (SELECT c.* FROM c LEFT JOIN s USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
    x AS (SELECT k.lang, k.phrase, a, cut, l.f AS l, r.f AS r, n,
                 CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
          FROM k, range(1, 5) AS cuts(cut), f l, f r, n
          WHERE cut < k.m AND l.lang = k.lang AND l.phrase = array_to_string(ws[1 : cut], ' ')
            AND r.lang = k.lang AND r.phrase = array_to_string(ws[cut + 1 : ], ' ') AND n.lang = k.lang),
    y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
    SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, score
    FROM y QUALIFY rank <= 2000"""
