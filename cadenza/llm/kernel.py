"""Vectorised work on the bytes of Arrow string columns.

Spark hands a Python worker a string column as one byte buffer and an array of offsets.  The helpers here find words and
hash them on that buffer as a whole, so no Python object is made per word.  Batches are cut into pieces of ``CHUNK``
bytes (at document borders) to bound memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

CHUNK = 2 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 3)
_U = np.uint64
_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte; the hash of a word is the sum of value(byte) * _P**position, then mixed.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: Rows in an Arrow batch at most, where rows are whole texts.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_ROWS`` if it is larger: a batch of texts is held on both sides of the
    pipe to a worker.  It stays lowered, as plans read it when they run."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release() -> None:
    """Hand freed memory back to the system: a worker otherwise keeps the most that any of its tasks needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that hands freed memory back after its last one."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_P**i and _P**-i for i < n, modulo 2**64."""
    if len(_POW.get("p", ())) < n:
        m = max(n, CHUNK + (1 << 16))
        inv = _U(pow(int(_P), -1, 2**64))
        for key, base in (("p", _P), ("i", inv)):
            out = np.full(m, base, np.uint64)
            out[0] = 1
            _POW[key] = np.cumprod(out, dtype=np.uint64)
    return _POW["p"], _POW["i"]


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (starting at 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes (or one longer document)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased (A-Z) texts: (hash, document, start, end).  ``[^\\x20\\x09-\\x0D]+`` within a document."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n == 0:
        return none.astype(np.uint64), none, none, none
    solid = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    begin = np.flatnonzero(solid & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | first[1:])) + 1
    p, inv = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTE_VALUE[LOWER[data]] * p[:n], out=total[1:])
    h = (total[end] - total[begin]) * inv[begin]
    return mix(h), np.searchsorted(offsets, begin, "right") - 1, begin, end


class HashIndex:
    """Open-addressing map from distinct uint64 keys to their position, grown and looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.zeros(0, np.uint64)
        self.add(keys)

    def add(self, keys: np.ndarray) -> None:
        """Keys that are not in it yet; they get the next positions."""
        base, self.keys = len(self.keys), np.concatenate([self.keys, keys])
        if base == 0 or 2 * len(self.keys) > self.mask + 1:
            bits = max(4, int(np.ceil(np.log2(max(len(self.keys), 1) * 2 + 2))))
            self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
            self.slot_key = np.zeros(1 << bits, np.uint64)
            self.slot_at = np.full(1 << bits, -1, np.int32)
            base = 0
        todo = np.arange(base, len(self.keys), dtype=np.int32)
        at = self._home(self.keys[base:])
        while len(todo):
            free = self.slot_at[at] < 0
            self.slot_at[at[free]] = todo[free]  # of several claims for a slot the last stays
            won = self.slot_at[at] == todo
            self.slot_key[at[won]] = self.keys[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of keys, -1 where absent."""
        at = self._home(keys)
        got = self.slot_at[at]
        bad = np.flatnonzero((got >= 0) & (self.slot_key[at] != keys))
        while len(bad):
            at_bad = (at[bad] + 1) & self.mask
            at[bad] = at_bad
            got[bad] = self.slot_at[at_bad]
            bad = bad[(got[bad] >= 0) & (self.slot_key[at_bad] != keys[bad])]
        return got
