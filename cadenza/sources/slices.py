"""Arrays and audio of any size in slices, and digests of any file: planned by byte ranges, read by ranges."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .samples import store

#: Bytes of a file that hold its header at most, and that are hashed at once.
HEADER, BLOCK = 64 << 10, 4 << 20


@dataclass
class Layout:
    """Where a file's values lie: their first byte, bytes in all, numpy type, values in a frame, offset and scale, and rate."""

    at: int
    length: int
    kind: str
    channels: int = 1
    zero: float = 0.0
    unit: float = 1.0
    rate: int | None = None


def npy_layout(head: bytes, size: int) -> Layout:
    """Of a plain ``.npy`` file in C order; objects and other orders are refused."""
    import numpy as np
    from numpy.lib import format as npy

    f = io.BytesIO(head)
    version = npy.read_magic(f)
    shape, fortran, dtype = npy.read_array_header_1_0(f) if version == (1, 0) else npy.read_array_header_2_0(f)
    if dtype.hasobject or dtype.kind not in "biuf" or (fortran and len(shape) > 1):
        raise ValueError(f"an array of {dtype}{' in Fortran order' if fortran else ''} has no slices")
    return Layout(f.tell(), min(int(np.prod(shape, dtype=np.int64)) * dtype.itemsize, size - f.tell()), dtype.str)


def wav_layout(head: bytes, size: int) -> Layout:
    """Of PCM, by the chunks of its header; the data may be longer than the 32 bits of its length can say."""
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, form = 12, None
    while at + 8 <= len(head):
        name, length = head[at : at + 4], struct.unpack_from("<I", head, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", head, at + 8)
        if name == b"data" and form:
            code, channels, rate, _, _, bits = form
            if code not in (1, 0xFFFE) or bits not in (8, 16, 32):
                raise ValueError(f"WAV of format {code} with {bits} bits")
            rest = size - at - 8
            length = rest if length >= 0xFFFFFFFF - 1 or length == 0 or length > rest else length
            return Layout(at + 8, length, {8: "|u1", 16: "<i2", 32: "<i4"}[bits], channels, 128.0 if bits == 8 else 0.0, 1 / (128 if bits == 8 else 1 << (bits - 1)), rate)
        at += 8 + length + length % 2
    raise ValueError("no samples in the header's reach")


LAYOUTS = {".npy": npy_layout, ".wav": wav_layout}


@dataclass
class Range(InputPartition):
    """Bytes of a file from ``first`` on, after its header."""

    path: str
    size: int
    first: int
    length: int


class ArraySlices(DataSource):
    """``spark.read.format("array_slices")``: (path, first, rate, values) of the ``.npy`` and ``.wav`` files below ``path``.

    A file is read in ranges of ``bytesPerTask`` (64 MiB), each by a task that reads the header and then no more than its range,
    in rows of ``slice`` frames (65,536): ``first`` is the number of a row's first frame.  Channels are averaged and whole-number
    samples scaled to [-1, 1) in audio; arrays keep their values.  The driver lists names and sizes only."""

    @classmethod
    def name(cls) -> str:
        return "array_slices"

    def schema(self) -> str:
        return "path string, first long, rate int, values array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Slices({k.lower(): v for k, v in self.options.items()})


class _Slices(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.most, self.rows = int(options.get("bytespertask", 64 << 20)), int(options.get("slice", 65_536))
        if self.most <= 0 or self.rows <= 0:
            raise ValueError("bytesPerTask and slice are positive")

    def partitions(self) -> Sequence[InputPartition]:
        return [Range(p, n, at, min(self.most, n - at)) for p, n in files_below(self.root) if p[p.rfind(".") :].lower() in LAYOUTS for at in range(0, max(n, 1), self.most)]

    def read(self, partition: Range) -> Iterator[tuple]:
        import numpy as np

        with store(self.root)[0].open_input_file(partition.path) as f:
            layout = LAYOUTS[partition.path[partition.path.rfind(".") :].lower()](f.read(HEADER), partition.size)
            kind = np.dtype(layout.kind)
            frame = kind.itemsize * layout.channels
            # Frames that begin within the range; those that end beyond it are read whole.
            begin, end = (-(-max(0, x - layout.at) // frame) for x in (partition.first, partition.first + partition.length))
            end = min(end, layout.length // frame)
            for first in range(begin, end, self.rows):
                n = min(self.rows, end - first)
                f.seek(layout.at + first * frame)
                x = np.frombuffer(f.read(n * frame), kind).astype(np.float64)
                x = ((x - layout.zero) * layout.unit).reshape(-1, layout.channels).mean(1)
                yield partition.path, first, layout.rate, x.astype(np.float32).tolist()


def files_below(root: str) -> list[tuple[str, int]]:
    """Names and sizes of all files below a folder, or of one file."""
    from pyarrow import fs

    where, path = store(root)
    one = where.get_file_info(path)
    found = [one] if one.type == fs.FileType.File else where.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File)


def read_slices(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ArraySlices)
    return spark.read.format("array_slices").options(**options).load(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of all files below a folder, of any size: a task reads a file block by block, and holds one block."""
    listed = files_below(path)

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for name, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = hashlib.sha256()
                with store(path)[0].open_input_stream(name) as f:
                    while block := f.read(BLOCK):
                        digest.update(block)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([digest.hexdigest()])], ["path", "bytes", "sha256"])

    files = spark.createDataFrame(listed, "path string, bytes long")
    return files.repartition(max(1, min(len(listed), 4096)), "path").mapInArrow(run, "path string, bytes long, sha256 string")
