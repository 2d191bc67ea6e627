"""Language-model scoring with a hierarchical Pitman-Yor model over bytes.

A text is lower-cased (A-Z) and read as its words, each followed by a space, and one end symbol.  The model gives every
such byte a probability after the six bytes before it; the restaurant of a context has the restaurant of the context
without its first byte as parent, down to the restaurant without context and a uniform base.  The product over a text is a
proper probability of its sequence of words and end.  (Bytes, as most distinct words of a corpus are rare: contexts of words
would need a table as large as the corpus, and unseen words a spelling anyway.)

Corpus statistics are sums over all training texts.  They are kept as packed arrays: a block of texts yields one row for each
part of the key space, with the sorted keys that occur in the block and their counts; parts are merged, answered and
sent back to the blocks that asked.  Neither the vocabulary nor the model is ever gathered or broadcast; what the driver
holds is the restaurants of at most one byte of context (65,536 counts).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import materialize
from .kernel import _U, LOWER, HashIndex, bound_batches, chunks, mix, release, strings, words
from .language import held_out

ORDER = 6
#: Text bytes in a block.
BLOCK_BYTES = 24 << 20
SPACE, END, START = 0x20, 0x0A, 0x00
#: Symbols worked on at once while texts are surveyed.
PIECE = 512 << 10
#: Answers are numbers of this part of a decimal digit.
GRAIN = 1_000_000
#: Sweeps of the sampler over every part; predictions of the last ``KEPT`` are averaged.
SWEEPS, KEPT = 6, 4
#: Strength of every restaurant; discounts are estimated for each order from its sections of one and of two customers.
THETA = 5.0
_STEPS_EXACT = 48


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] places, then those of the next."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, offsets of each text's symbols, 63-bit word hashes, document of each word)."""
    h, doc, begin, end = words(data, offsets)
    n, size = len(offsets) - 1, end - begin
    offs = np.concatenate([[0], np.cumsum(np.bincount(doc, size + 1, n).astype(np.int64) + 1)])
    out = np.full(offs[-1], SPACE, np.uint8)
    out[offs[1:] - 1] = END
    # Before a word lie the words before it with a space each, and the ends of the documents before its own.
    out[_ragged(np.cumsum(size) - size + np.arange(len(h)) + doc, size)] = LOWER[data[_ragged(begin, size)]]
    return out, offs, h >> _U(1), doc


def grams(sym: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For every symbol the key of its ORDER symbols of context and itself (itself lowest); START before a text."""
    n = len(sym)
    key = sym.astype(np.uint64)
    place = np.arange(n) - np.repeat(offs[:-1], np.diff(offs))
    for back in range(1, ORDER + 1):
        before = np.zeros(n, np.uint64)
        before[back:] = sym[:-back]
        before[place < back] = START
        key |= before << _U(8 * back)
    return key


def _part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """Keys with equal last two bytes of context stay together: their restaurants share all parents of that order and above."""
    return (mix((key >> _U(8)) & _U(0xFFFF)) % _U(parts)).astype(np.int64)


def _tally(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return keys[at], np.add.reduceat(weight[order], at) if len(at) else np.zeros(0, np.int64)


def _distinct(keys: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of at most 63 bits and how often each was seen in training."""
    packed = (keys << _U(1)) | seen.astype(np.uint64)
    packed.sort()
    key = packed >> _U(1)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat((packed & _U(1)).astype(np.uint32), at) if len(at) else np.zeros(0, np.uint32)


def _join(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two tallies with sorted keys as one."""
    (key, count), (more, n) = a, b
    at = np.searchsorted(key, more)
    known = np.zeros(len(more), bool)
    inside = at < len(key)
    known[inside] = key[at[inside]] == more[inside]
    count[at[known]] += n[known]
    new = ~known
    at = at[new] + np.arange(int(new.sum()))  # where they end up
    old = np.ones(len(key) + len(at), bool)
    old[at] = False
    out_key, out_count = np.empty(len(old), key.dtype), np.empty(len(old), count.dtype)
    out_key[at], out_count[at] = more[new], n[new]
    out_key[old] = key
    del key, a
    out_count[old] = count
    return out_key, out_count


def _merge(tallies: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Tallies with sorted keys as one, small ones first."""
    while len(tallies) > 1:
        tallies.sort(key=lambda t: -len(t[0]))
        b, a = tallies.pop(), tallies.pop()
        tallies.append(_join(a, b))
    return tallies[0]


_BLOCK = "block bigint, kind string, part int, ids binary, payload binary, counts binary"
_ROW = pa.schema([("block", pa.int64()), ("kind", pa.string()), ("part", pa.int32()), ("ids", pa.binary()), ("payload", pa.binary()), ("counts", pa.binary())])


def _row(*values) -> pa.RecordBatch:
    return pa.record_batch([pa.array([v], t) for v, t in zip(values, _ROW.types, strict=True)], schema=_ROW)


def _survey(parts: int, block_bytes: int):
    """Blocks of texts, and for each block and part the keys in it and their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        size, tallies = 0, {}
        bodies, lengths, ids, trains = [], [], [], []

        def take(batch: pa.RecordBatch) -> None:
            data, offsets = strings(batch.column(1))
            train = ~batch.column(2).to_numpy(zero_copy_only=False)
            ids.append(batch.column(0).to_numpy())
            trains.append(train)
            for i, j in chunks(offsets, PIECE):
                sym, offs, h, doc = symbols(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                bodies.append(sym.tobytes())
                lengths.append(np.diff(offs))
                tallies.setdefault("word", []).append(_distinct(h, train[i:j][doc]))
                tallies.setdefault("gram", []).append(_distinct(grams(sym, offs), np.repeat(train[i:j], np.diff(offs))))
                for kind, own in tallies.items():  # merged as they grow, to bound memory
                    if len(own) > 1 and sum(len(k) for k, _ in own[1:]) > max(len(own[0][0]), 1 << 19):
                        tallies[kind] = [_merge(own)]  # counts of 32 bits: a block has fewer symbols

        def block() -> Iterator[pa.RecordBatch]:
            who = np.stack([np.concatenate(x).astype("<i8") for x in (ids, lengths, trains)])
            text = zstandard.ZstdCompressor(level=3).compress(b"".join(bodies))
            for x in (bodies, lengths, ids, trains):
                x.clear()
            yield _row(number, "text", 0, who.tobytes(), text, b"")
            for kind in ("word", "gram"):
                key, count = _merge(tallies.pop(kind))
                part = _part_of(key, parts) if kind == "gram" else (key % _U(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edge = np.searchsorted(part[order], np.arange(parts + 1))
                for p in range(parts):
                    own = order[edge[p] : edge[p + 1]]
                    if len(own):
                        packed, turn = _pack_keys(kind, key[own])
                        yield _row(number, kind, p, b"", packed, _pack(count[own][turn], "<u4"))
            del key, count, part, order
            release()

        for batch in batches:
            _, offsets = strings(batch.column(1))
            for i, j in chunks(offsets, block_bytes):
                # Whole documents, so that a block ends at the first that fills it.
                take(batch.slice(i, j - i))
                size += int(offsets[j] - offsets[i])
                if size >= block_bytes:
                    yield from block()
                    size, number = 0, number + 1
        if ids:
            yield from block()

    return run


def _pack(numbers: np.ndarray, form: str) -> bytes:
    """Numbers by bytes of equal weight, compressed: high bytes of sorted keys and of counts repeat."""
    raw = np.ascontiguousarray(numbers.astype(form)).view(np.uint8).reshape(len(numbers), -1)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(raw.T).tobytes())


def _unpack(raw: bytes, form: str) -> np.ndarray:
    size = np.dtype(form).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1).T).view(form).ravel()


def _turned(keys: np.ndarray) -> np.ndarray:
    """Keys with the bytes of their context in reverse: sorted that way neighbours have more in common.  Twice gives them back."""
    raw = np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, [0, *range(ORDER, 0, -1), *range(ORDER + 1, 8)]]).view("<u8").ravel()


def _pack_keys(kind: str, keys: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Sorted distinct keys packed, and the order that this puts them in."""
    if kind == "word":
        return _pack(np.diff(keys, prepend=_U(0)), "<u8"), np.arange(len(keys))
    turned = _turned(keys)
    order = np.argsort(turned)
    return _pack(turned[order], "<u8"), order


def _unpack_keys(kind: str, raw: bytes) -> np.ndarray:
    numbers = _unpack(raw, "<u8")
    return np.cumsum(numbers, dtype=np.uint64) if kind == "word" else _turned(numbers)


class Restaurants:
    """Restaurants of one order: sections (context, dish) with their customers and tables.

    A Gibbs step takes all customers of a section up and seats them again one by one in the Chinese restaurant, given all
    else: the i-th joins an old table of its dish with weight i - d t, or opens a new one with weight (theta + d T) times
    the parent's probability.  The seating is accepted by the ratio of the step weights' products.  Only the numbers of
    tables matter to predictions and parents, so only those are kept.

    It is an approximate sampler, in two ways.  The sections of a restaurant are reseated side by side, each given the tables
    that the others had before the sweep, not after their own turn.  And from ``_STEPS_EXACT`` customers on, groups take
    the weight of their first customer.
    Sections of an order are seated together, as arrays; from ``_STEPS_EXACT`` customers on, a section's further customers
    arrive in groups of a tenth, whose new tables are one binomial draw.
    """

    def __init__(self, context: np.ndarray, dish_parent: np.ndarray, n_contexts: int, rng: np.random.Generator):
        self.context, self.parent, self.n, self.rng = context, dish_parent, n_contexts, rng
        self.customers = np.zeros(len(context), np.int64)
        self.tables = np.zeros(len(context), np.int64)
        self.weight = np.zeros(len(context))
        self.d, self.theta = 0.5, THETA

    def set_customers(self, customers: np.ndarray) -> None:
        changed = customers != self.customers
        self.customers = customers
        self.tables[changed] = np.minimum(self.tables[changed], customers[changed])
        self.weight[changed] = -np.inf  # an old seating of other customers is never kept
        once, twice = (customers == 1).sum(), (customers == 2).sum()
        self.d = float(np.clip(once / max(once + 2 * twice, 1), 0.05, 0.9))
        self.total = np.bincount(self.context, customers, self.n)

    def reseat(self, p_parent: np.ndarray) -> None:
        total = np.bincount(self.context, self.tables, self.n)[self.context]
        order = np.argsort(-self.customers, kind="stable")
        c = self.customers[order]
        some = int((c > 0).sum())
        order, c = order[:some], c[:some]
        base = self.theta + self.d * (total - self.tables)[order]
        p = np.maximum(p_parent[order], 1e-300)
        t = np.ones(some, np.int64)  # the first customer always opens a table
        weight = np.log(base * p)
        i = 1
        while some and i < c[0]:
            live = int(np.searchsorted(-c, -i, "left"))  # sections with more than i customers
            step = 1 if i < _STEPS_EXACT else max(1, i // 10)
            m = np.minimum(step, c[:live] - i)
            tt = t[:live]
            new = (base[:live] + self.d * tt) * p[:live]
            whole = i - self.d * tt + new
            chance = np.minimum(new / whole, 1.0)
            weight[:live] += m * np.log(whole)
            t[:live] += (self.rng.random(live) < chance) if step == 1 else self.rng.binomial(m, chance)
            i += step
        old = self.weight[order]
        accept = np.log(self.rng.random(some)) < weight - old
        spots = order[accept]
        self.tables[spots], self.weight[spots] = t[accept], weight[accept]

    def predict(self, p_parent: np.ndarray) -> np.ndarray:
        seats = np.bincount(self.context, self.tables, self.n)[self.context]
        old = np.maximum(self.customers - self.d * self.tables, 0)
        return (old + (self.theta + self.d * seats) * p_parent) / (self.theta + self.total[self.context])


def _levels(key: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For orders ORDER down to 2: (context number of each section, section's place among those of the order below, contexts)."""
    out, now = [], key
    for order in range(ORDER, 1, -1):
        context = now >> _U(8)
        _, number = np.unique(context, return_inverse=True)
        below = now & _U((1 << (8 * order)) - 1)
        next_, place = np.unique(below, return_inverse=True)
        out.append((number, place, int(number.max()) + 1 if len(number) else 0))
        now = next_
    out.append((now, np.zeros(0, np.int64), 0))  # keys of order 1: a byte of context and the dish
    return out


def sample_part(key: np.ndarray, count: np.ndarray, p_one: np.ndarray, seed: int, sweeps: int = SWEEPS, kept: int = KEPT) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Averaged predictive probability of each key, and customers sent to order 1 as (16-bit key, tables)."""
    rng = np.random.default_rng(seed)
    *levels, (base, _, _) = _levels(key)
    rooms = [Restaurants(number, place, n, rng) for number, place, n in levels]
    below = p_one[base.astype(np.int64)]
    mean, used = np.zeros(len(key)), 0

    def predictions() -> list[np.ndarray]:
        """From the lowest order up, each by section of its order."""
        probs = [below]
        for room in reversed(rooms):
            probs.append(room.predict(probs[-1][room.parent]))
        return probs

    customers = count.astype(np.int64)
    for room in rooms:  # the sparsest seating to begin with: a table for each section
        room.set_customers(customers)
        room.tables = (customers > 0).astype(np.int64)
        customers = np.bincount(room.parent, room.tables, int(room.parent.max(initial=-1)) + 1).astype(np.int64)
    for sweep in range(sweeps):
        probs = predictions()
        customers = count.astype(np.int64)
        for depth, room in enumerate(rooms):
            room.set_customers(customers)
            room.reseat(probs[len(rooms) - 1 - depth][room.parent])
            customers = np.bincount(room.parent, room.tables, int(room.parent.max(initial=-1)) + 1).astype(np.int64)
        if sweep >= sweeps - kept:
            mean += predictions()[-1]
            used += 1
    return mean / max(used, 1), (base, customers)


def low_orders(customers: np.ndarray, seed: int = 0, sweeps: int = 20, kept: int = 10) -> np.ndarray:
    """Averaged predictive probabilities (65,536) of the restaurants with one byte of context, given their customers."""
    rng = np.random.default_rng(seed)
    key = np.arange(65536)
    one = Restaurants(key >> 8, key & 255, 256, rng)
    root = Restaurants(np.zeros(256, np.int64), np.zeros(256, np.int64), 1, rng)
    one.set_customers(customers)
    one.tables = (customers > 0).astype(np.int64)
    mean = np.zeros(65536)
    for sweep in range(sweeps):
        root.set_customers(np.bincount(one.parent, one.tables, 256).astype(np.int64))
        root.reseat(np.full(256, 1 / 256))
        p_root = root.predict(np.full(256, 1 / 256))
        one.reseat(p_root[one.parent])
        if sweep >= sweeps - kept:
            mean += one.predict(p_root[one.parent]) / kept
    return mean


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Score every whole text, learning from the rows outside the held-out fold (CRC-32 of the id's text, remainder 2).

    1. Texts are read once: blocks of them, and per block the distinct words and keys of seven bytes with training counts.
    2. Tables sent to the one-byte contexts are counted in a first sampling round; the driver samples their restaurants.
    3. Each part of the key space merges its blocks' counts, samples its restaurants given these, and answers each
       block: log10 of the averaged predictive probability of its keys, counts of its words.
    4. Each block adds up its texts' scores from its own answers.

    Words are held by 63-bit hashes.  Null texts count as empty: one end token.  Null ids are held out and returned as null;
    repeated rows are scored, and learned from, as often as they occur.  Other columns are ignored; an empty table gives an
    empty result; without training rows base and model are uniform.

    Very long texts are scored whole; a block holds whole texts.  A symbol's log10 probability is rounded to a millionth.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity (10 ** (-score / n_tokens)).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    result = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    no_id = -(2**63)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(no_id)).alias("id"), F.col(text_col).alias("body"), held_out(id_col, folds).alias("out"))
    parts = min(1 << 16, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # there are 1 << 16 keys to deal by
    survey = materialize(source.mapInArrow(_survey(parts, block_bytes), _BLOCK), "survey")
    asked = survey.filter("kind <> 'text'").select("block", "kind", "part", "payload", "counts")

    def merged(kind: str, pdf: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        release()  # what the group before left
        keys = [_unpack_keys(kind, x) for x in pdf["payload"]]
        return keys, *_tally(np.concatenate(keys), np.concatenate([_unpack(x, "<u4") for x in pdf["counts"]]).astype(np.int64))

    def first_round(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """For words: training tokens and distinct training words.  For grams: customers of one-byte contexts."""
        _, keys, count = merged(key[0], pdf)
        if key[0] == "word":
            return pd.DataFrame({"at": [-1], "n": [int(count.sum())], "d": [int((count > 0).sum())]})
        _, (at, n) = sample_part(keys, count, np.full(65536, 1 / 256), seed=int(key[1]), sweeps=1, kept=1)
        return pd.DataFrame({"at": at.astype(np.int64), "n": n, "d": 0})

    facts = asked.groupBy("kind", "part").applyInPandas(first_round, "at bigint, n bigint, d bigint").groupBy("at").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).toPandas()
    of_words, low = facts[facts["at"] < 0], facts[facts["at"] >= 0]
    trained = source.filter(~F.col("out")).count()
    n_train, vocabulary = int(of_words["n"].sum()) + trained, int(of_words["d"].sum()) + (trained > 0)
    customers = np.zeros(65536, np.int64)
    customers[low["at"].to_numpy(np.int64)] = low["n"].to_numpy(np.int64)
    p_one = low_orders(customers)

    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asked_keys, keys, count = merged(key[0], pdf)
        if key[0] == "word":
            value, form = count, "<u4"
        else:
            value, form = np.round(-np.log10(sample_part(keys, count, p_one, seed=int(key[1]))[0]) * GRAIN), "<u4"
        return pd.DataFrame({"block": pdf["block"], "kind": pdf["kind"], "payload": pdf["payload"], "value": [_pack(value[np.searchsorted(keys, k)], form) for k in asked_keys]})

    answers = asked.groupBy("kind", "part").applyInPandas(answer, "block bigint, kind string, payload binary, value binary")
    texts = survey.filter("kind = 'text'").select("block", "ids", "payload")
    floor = n_train + vocabulary + 1

    def settle(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        release()
        index, value = {}, {}
        for kind, form in (("word", "<u4"), ("gram", "<u4")):
            own = right[right["kind"] == kind]
            index[kind] = HashIndex(np.concatenate([np.zeros(0, np.uint64), *(_unpack_keys(kind, x) for x in own["payload"])]))
            value[kind] = np.concatenate([np.zeros(0, form), *(_unpack(x, form) for x in own["value"])])
        frames = []
        for who, payload in zip(left["ids"], left["payload"], strict=True):
            ids, lens, train = np.frombuffer(who, "<i8").reshape(3, -1)
            sym, all_offs = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8), np.concatenate([[0], np.cumsum(lens)])
            for i, j in chunks(all_offs, 2 << 20):
                n, s, offs = j - i, sym[all_offs[i] : all_offs[j]], all_offs[i : j + 1] - all_offs[i]
                score = -np.add.reduceat(value["gram"][index["gram"].find(grams(s, offs))], offs[:-1], dtype=np.int64) / GRAIN
                h, doc, _, _ = words(s, offs)
                c = value["word"][index["word"].find(h >> _U(1))]
                base = np.bincount(doc, np.log10((c + 1.0) / floor), n) + np.log10((trained + 1) / floor)
                known = np.bincount(doc, c > 0, n).astype(np.int64) + (trained > 0)
                frames.append(pd.DataFrame({"id": ids[i:j], "held_out": train[i:j] == 0, "n_tokens": np.bincount(doc, minlength=n) + 1, "n_known": known, "train_tokens": n_train, "base_score": base, "score": score, "perplexity": 10.0 ** (-score / (np.bincount(doc, minlength=n) + 1))}))
        return pd.concat(frames) if frames else pd.DataFrame(columns=[c.split()[0] for c in result.split(", ")])

    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(settle, result)
    return scored.select(F.nullif("id", F.lit(no_id)).alias(id_col), *[c.split()[0] for c in result.split(", ")[1:]])
