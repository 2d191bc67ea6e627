"""Near-duplicate documents by HyperMinHash sketches, with every link confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import discard, materialize
from .components import connected_components, facing_blocks
from .kernel import _U, CHUNK, bound_batches, mix, strings, tidy, words

#: Registers in a band: four registers of 16 bits fill a 64-bit key.
ROWS = 4
#: A pair at the threshold shares no band with at most this probability.
MISS = 1e-6
#: Members of a candidate bucket that are compared in one block.
BLOCK = 2048
#: Shingles by which 32-bit sets may be wrong, besides what their sizes let expect (see ``_slack``).
SLACK = 2
_HASH_BITS, _VALUE_BITS, _MANTISSA = 54, 38, 10
_DOCS = 1 << (64 - _HASH_BITS)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of documents (first, last + 1): distinct k-word shingles as sorted 54-bit hashes, and their document
    (counted from first).  A document of fewer words has its whole word sequence as its only shingle."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(n, i + _DOCS - 1, max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1))
        h, doc, _, _ = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        count = np.bincount(doc, minlength=j - i)
        last = np.cumsum(count)
        scale = mix(np.arange(1, k + 1, dtype=np.uint64)) | _U(1)
        total = np.zeros(len(h), np.uint64)
        at = np.arange(len(h))
        for w in range(k):
            # Words beyond the document's end add nothing: then the shingle is short.
            ok = at + w < last[doc]
            total[ok] += h[np.minimum(at + w, len(h) - 1)[ok]] * scale[w]
        starts = at + k <= last[doc]
        starts |= (count[doc] < k) & (at == (last - count)[doc])
        key = (mix(total[starts]) >> _U(64 - _HASH_BITS)) | (doc[starts].astype(np.uint64) << _U(_HASH_BITS))
        key.sort()
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        yield i, j, key & _U((1 << _HASH_BITS) - 1), (key >> _U(_HASH_BITS)).astype(np.int64)
        i = j


_PROBES: dict[int, np.ndarray] = {}


def _probes(m: int) -> np.ndarray:
    """For each register an order in which it asks the others when it is empty."""
    if m not in _PROBES:
        rng = np.random.default_rng(7_000_003)
        _PROBES[m] = np.array([rng.permutation(m) for _ in range(m)])
    return _PROBES[m]


def hyperminhash(shingle: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Registers (n_docs, m) of 16 bits: leading zeros and the 10 bits after the first one of the least value in a bucket.

    Empty buckets borrow another's register in a fixed pseudo-random order, so agreement of a register keeps the
    probability of the Jaccard similarity for small sets as well."""
    bucket = ((shingle & _U(0xFFFF)) * _U(m)) >> _U(16)
    least = np.full(n_docs * m, 1 << _VALUE_BITS, np.int64)
    np.minimum.at(least, doc * m + bucket.astype(np.int64), np.maximum((shingle >> _U(16)).astype(np.int64), 1))
    least = least.reshape(n_docs, m)
    empty = least == 1 << _VALUE_BITS
    fraction, length = np.frexp(least.astype(np.float64))
    register = ((_VALUE_BITS + 1 - length) << _MANTISSA) | ((fraction * 2 - 1) * (1 << _MANTISSA)).astype(np.int64)
    rows = np.flatnonzero(empty.any(1) & ~empty.all(1))
    if len(rows):
        sub, lack = register[rows], empty[rows]
        filled, probes = sub.copy(), _probes(m)
        for a in range(m):
            r, j = np.nonzero(lack)
            if not len(r):
                break
            source = probes[j, a]
            ok = ~empty[rows[r], source]
            filled[r[ok], j[ok]] = sub[r[ok], source[ok]]
            lack[r[ok], j[ok]] = False
        register[rows] = filled
    return register.astype(np.uint16)


def _sketch(k: int, m: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for i, j, shingle, doc in shingle_sets(data, offsets, k):
                n = j - i
                size = np.bincount(doc, minlength=n)
                one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                full = np.flatnonzero(size)
                if len(full):
                    first = (np.cumsum(size) - size)[full]
                    one[full] = np.add.reduceat(mix(shingle), first)
                    two[full] = np.add.reduceat(mix(shingle ^ _U(0x5851F42D4C957F2D)), first)
                sketch = hyperminhash(shingle, doc, n, m)
                raw = pa.Array.from_buffers(pa.binary(m * 2), n, [None, pa.py_buffer(np.ascontiguousarray(sketch))]).cast(pa.binary())
                yield pa.record_batch([batch.column(0).slice(i, n), pa.array(size, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), raw], ["id", "n", "d1", "d2", "sketch"])

    return run


def _bucket(band: np.ndarray, number) -> np.ndarray:
    """A bucket's key: a band's registers, mixed with its number."""
    return mix(band + np.asarray(number).astype(np.uint64) * _U(0x9E3779B97F4A7C15)).view(np.int64)


@tidy
def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = strings(batch.column(1))
        n = batch.num_rows
        if not n:
            continue
        bands = offsets[1] // 8
        key = _bucket(data.view(np.uint64), np.tile(np.arange(bands), n))
        yield pa.record_batch([pa.array(key), batch.column(0).take(pa.array(np.repeat(np.arange(n), bands)))], ["bucket", "id"])


def _likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether a pair can reach num / den: by sizes, and by the estimate corrected for colliding registers, less five
    standard deviations."""
    low, high = np.minimum(na, nb), np.maximum(na, nb)
    m, t = a.shape[-1], num / den
    chance = 0.1699 * 4 * na * nb / (na + nb) ** 2 / (1 << _MANTISSA)
    estimate = ((a == b).sum(-1) / m - chance) / (1 - chance)
    return (den * low >= num * high) & (estimate >= t - 5 * np.sqrt(t * (1 - t) / np.minimum(m, high)))


def _star_filter(num: int, den: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(strings(batch.column(c))[0].tobytes(), np.uint16).reshape(batch.num_rows, -1) for c in (4, 5))
                ok = _likely(a, b, *(batch.column(c).to_numpy() for c in (2, 3)), num, den)
                yield batch.filter(pa.array(ok)).select([0, 1])

    return run


def _sets(k: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for i, j, shingle, doc in shingle_sets(data, offsets, k):
                edge = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=j - i))]) * 8
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(shingle)]).cast(pa.binary())
                yield pa.record_batch([batch.column(0).slice(i, j - i), raw], ["id", "shingles"])

    return run


def _confirm(num: int, den: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


@tidy
def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets as 32-bit hashes."""
    for batch in batches:
        data, offsets = strings(batch.column(1))
        edge = (offsets // 2).astype(np.int64)
        half = (data.view(np.uint64) >> _U(_HASH_BITS - 32)).astype(np.uint32)
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(edge), pa.py_buffer(half)]).cast(pa.binary())
        yield pa.record_batch([batch.column(0), raw], ["id", "short"])


def _slack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shingles by which sets of these sizes may be wrong: false matches expected, and eight standard deviations."""
    expected = np.asarray(a, np.float64) * b / 2**32
    return SLACK + np.ceil(expected + 8 * np.sqrt(expected)).astype(np.int64)


def _rest(num: int, den: int):
    """Links across the components of a bucket (or of two blocks of one), for rows sorted by bucket.

    A pair is looked at in the first band that it shares only.  Sets are compared by 32-bit hashes; a pair that is above the
    threshold by ``_slack`` shingles, which grows with the sizes, is a link (as many false matches are as unlikely as a 54-bit
    collision), one that is within them is left to the full sets.  What a link joins here is not compared again, so links are fewer than rows.
    """

    def pairs(g: dict) -> Iterator[pa.RecordBatch]:
        n, (names, root) = len(g["id"]), np.unique(g["comp"], return_inverse=True)
        bands, own = g["sketch"].view(np.uint64), g["lo"][0] == g["hi"][0]
        of_bucket = next((k for k in range(bands.shape[1]) if (bands[:, k] == bands[0, k]).all() and _bucket(bands[:1, k], k)[0] == g["bucket"][0]), 0)
        every, found = np.arange(n), []
        for i in range(n):
            ok = root != root[i]
            ok &= (every > i) if own else ((g["block"] == g["hi"]) & (g["block"][i] == g["lo"][i]))
            j = np.flatnonzero(ok)
            if len(j):
                j = j[(bands[j] == bands[i]).argmax(1) == of_bucket]
            if len(j):
                j = j[_likely(g["sketch"][i], g["sketch"][j], g["n"][i], g["n"][j], num, den)]
            if not len(j):
                continue
            sets = [g["short"][k] for k in j]
            flat, mine = np.concatenate(sets), g["short"][i]
            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            common = np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum(size) - size)
            fits = lambda c: den * c >= num * (g["n"][i] + g["n"][j] - c)  # noqa: E731, B023
            sure, open_ = fits(common - _slack(g["n"][i], g["n"][j])), fits(common + SLACK)
            for k in j[sure]:
                if root[k] != root[i]:
                    found.append((g["id"][i], g["id"][k], True))
                    root[root == root[k]] = root[i]
            found += [(g["id"][i], g["id"][k], False) for k in j[open_ & ~sure] if root[k] != root[i]]
        if found:
            a, b, sure = (np.array(x) for x in zip(*found, strict=True))
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sure)], ["a", "b", "sure"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
            col = {c: table.column(c).to_numpy() for c in ("bucket", "lo", "hi", "block", "id", "n", "comp")}
            sketch = np.frombuffer(strings(table.column("sketch"))[0].tobytes(), np.uint16).reshape(table.num_rows, -1)
            data, offsets = strings(table.column("short"))
            flat, offsets = np.frombuffer(data.tobytes(), np.uint32), offsets // 4
            key = np.stack([col["bucket"], col["lo"], col["hi"]])
            edge = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [table.num_rows]])
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if e - s > 1:
                    yield from pairs({k: v[s:e] for k, v in col.items()} | {"sketch": sketch[s:e], "short": [flat[offsets[r] : offsets[r + 1]] for r in range(s, e)]})

        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[-1].as_py() for c in range(3)]
            change = np.flatnonzero(~np.logical_and.reduce([batch.column(c).to_numpy() == last[c] for c in range(3)]))
            cut = change[-1] + 1 if len(change) else 0
            if held and cut == 0 and [held[-1].column(c)[-1].as_py() for c in range(3)] != last:
                yield from solve(pa.Table.from_batches(held))
                held = []
            if cut:
                yield from solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Group documents whose shingle sets have den * intersection >= num * union, directly or through others.

    1. Each text becomes a HyperMinHash sketch; documents of equal sets (by size and a 128-bit digest) form a class.
    2. Four neighbouring registers make a band; classes that share a band's key are candidates.  In every such bucket
       each class is held against those of smallest and of largest id: collision-corrected estimate first, then the full sets.
    3. Components of the confirmed links.  In buckets that still hold several components, all pairs across components
       are estimated, in blocks of bounded size, and the likely ones confirmed; members of a bucket's largest component
       face those of the others only (``components.facing_blocks``).  Components again.

    So no link is skipped because a bucket is large, and no pair within a component is compared.  The number of bands
    follows from the threshold: a pair at the threshold shares none with probability below ``MISS``, and the estimate turns
    away a true link with probability below 1e-6.  Sets hold 54-bit hashes of shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  Fewer words than ``shingle``: the whole sequence is
    the one shingle.  Null text or no words: no shingle, linked with nothing.  A null id: returned with null component.
    Rows that repeat an id are one node.  Other columns are ignored; an empty table gives an empty result.

    Returns id, n_shingles, component_id (smallest id reachable), kept (id = component_id).
    """
    bound_batches(docs.sparkSession)
    t = num / den
    bands = max(8, math.ceil(math.log(MISS) / math.log(1 - t**ROWS)))
    m = bands * ROWS
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    rows = materialize(source.mapInArrow(_sketch(shingle, m), "id bigint, n bigint, d1 bigint, d2 bigint, sketch binary"), "sketches")
    classes = materialize(rows.filter("n > 0 AND id IS NOT NULL").groupBy("n", "d1", "d2", "sketch").agg(F.min("id").alias("id")), "classes")
    bucketed = classes.select("id", "sketch").mapInArrow(_bands, "bucket bigint, id bigint")
    hubs = bucketed.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("other")).filter("hub < other")
    # Rows of buckets with several classes: all that candidates can come from.
    shared = materialize(bucketed.join(hubs, "bucket"), "buckets")
    some = classes.select("id", "n", "sketch")
    wanted = shared.select("id").distinct()
    sets = materialize(source.join(wanted, "id", "left_semi").mapInArrow(_sets(shingle), "id bigint, shingles binary"), "sets")
    stars = shared.select("id", F.explode(F.array("hub", "other")).alias("hub")).filter("hub <> id").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
    stars = stars.join(some.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b").join(some.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    stars = stars.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_star_filter(num, den), "a bigint, b bigint")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left, right = sets.withColumnsRenamed({"id": "a", "shingles": "sa"}), sets.withColumnsRenamed({"id": "b", "shingles": "sb"})
        return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(_confirm(num, den), "a bigint, b bigint"), "links")

    links = confirmed(stars)
    labels = connected_components(links)
    named = shared.join(labels, shared["id"] == labels["node"], "left").select("bucket", "id", F.coalesce("component", "id").alias("comp"))
    short = sets.mapInArrow(_short, "id bigint, short binary")
    facing = facing_blocks(materialize(named.withColumnRenamed("id", "node"), "members"), BLOCK).withColumnRenamed("node", "id")
    open_rows = facing.join(some, "id").join(short, "id").select("bucket", "lo", "hi", "block", "id", "n", "comp", "sketch", "short")
    keys = ["bucket", "lo", "hi"]
    n_tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = materialize(open_rows.repartition(n_tasks, *keys).sortWithinPartitions(*keys, "id").mapInArrow(_rest(num, den), "a bigint, b bigint, sure boolean"), "rest")
    if not more.isEmpty():
        found = more.filter("sure").select("a", "b").unionByName(confirmed(more.filter("NOT sure").select("a", "b").distinct()))
        labels = connected_components(links.unionByName(found))
    labels = materialize(labels, "labels")
    discard(sets)
    grouped = classes.join(labels, classes["id"] == labels["node"], "left").select("n", "d1", "d2", F.coalesce("component", "id").alias("component_id"))
    out = rows.select("id", "n", "d1", "d2").join(grouped.withColumnsRenamed({"n": "n_", "d1": "d1_", "d2": "d2_"}), (F.col("n") == F.col("n_")) & (F.col("d1") == F.col("d1_")) & (F.col("d2") == F.col("d2_")), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
