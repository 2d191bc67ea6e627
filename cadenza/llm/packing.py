"""Packing of tokenised documents into fixed-length training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import materialize
from .kernel import bound_batches, chunks, strings, tidy

#: Pieces dealt to one packing task; only the last bins of a task can stay half empty.
PIECES_PER_TASK = 60_000
#: Bins that a task keeps open.
OPEN_BINS = 2048
#: Pieces that arrive in a row by falling size.
RUN = 4_000
#: Bytes of text encoded at once: every byte takes some 40 more while that lasts.
PIECE = 256 << 10
_PIECE = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _tokenise(path: str, capacity: int, end_id: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import BatchBPE

        bpe = BatchBPE.get(path)
        for batch in batches:
            _, offsets = strings(batch.column(1))
            for i, j in chunks(offsets, PIECE):
                part = batch.slice(i, j - i)
                flat, offs = bpe.encode(part.column(1).to_pylist())
                n = j - i
                ids = np.full(len(flat) + n, end_id, "<u4")
                ids[np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(offs))] = flat
                first = offs[:-1] + np.arange(n)
                total = np.diff(offs) + 1
                pieces = -(-total // capacity)
                doc = np.repeat(np.arange(n), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = total - (pieces - 1) * capacity  # the first piece takes what does not fill a sequence
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                view, at = memoryview(ids).cast("B"), first[doc] + start
                crc = [zlib.crc32(view[4 * a : 4 * (a + b)]) for a, b in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.record_batch([part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    return run


class BestFit:
    """Bounded-space online best fit.

    Open bins are kept by free space, and a bitset has a bit for each free space that some open bin has.  An item goes to
    the fullest bin that can take it, found by the lowest set bit at or above its size; if none can, a bin is opened, and
    if ``open_bins`` are open already, the fullest closes first.  Items of an open bin are all that is held.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most, self.bits, self.count = capacity, open_bins, 0, 0
        self.by_free: list[list[list]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> list:
        stack = self.by_free[free]
        bin_ = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_

    def add(self, size: int, item) -> list | None:
        """Place an item (0 < size <= capacity); returns a bin that this closes."""
        closed = None
        above = self.bits >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, []
            if self.count == self.most and size < self.capacity:
                closed = self._take((self.bits & -self.bits).bit_length() - 1)
        bin_.append(item)
        free -= size
        if free == 0:
            return bin_  # never while another bin closes: an item that opens a bin and fills it has the full size
        self.by_free[free].append(bin_)
        self.bits |= 1 << free
        self.count += 1
        return closed

    def rest(self) -> Iterator[list]:
        for stack in self.by_free:
            yield from stack


def _pack(capacity: int, open_bins: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        fit, out, n_bins = BestFit(capacity, open_bins), [], 0

        def emit(bin_: list) -> None:
            nonlocal n_bins
            offset = 0
            for item in bin_:
                out.append((*item, base + n_bins, offset))
                offset += item[3]
            n_bins += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

        for batch in batches:
            for item in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                if (closed := fit.add(item[3], item)) is not None:
                    emit(closed)
            if len(out) > 8192:
                yield flush()
        for bin_ in fit.rest():
            emit(bin_)
        if out:
            yield flush()

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Ids of each text plus ``end_id``, cut into pieces of ``capacity`` (only the first may be shorter), as lengths and
    CRC-32 of the ids (little-endian 32-bit)."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).mapInArrow(_tokenise(tokenizer_path, capacity, end_id), _PIECE)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` ids.

    Texts are read and tokenised once, where they lie; only piece lengths (40 bytes each) are shuffled to packing tasks,
    whose number follows the number of pieces.  Pieces arrive in runs that a hash of the key makes, each from long to short:
    small pieces then find room that large ones left, while few bins are open; a repeated task gives the same bins.

    Null and empty texts are one end id.  Repeated rows are packed as often as they occur.  Other columns are ignored; an
    empty table gives an empty result.  Returns id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    pieces = materialize(token_pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id), "pieces")
    tasks = max(1, -(-pieces.count() // pieces_per_task))
    run = F.pmod(F.xxhash64("id", "piece"), F.lit(max(1, pieces_per_task // RUN)))
    dealt = pieces.repartition(tasks, "id", "piece").sortWithinPartitions(run, F.desc("length"), "id", "piece", "ids_crc32")
    packed = dealt.mapInArrow(_pack(capacity, open_bins), f"{_PIECE}, sequence_id bigint, offset bigint")
    return packed.withColumnRenamed("id", id_col)
