"""Samples as streaming chunks of a fixed size: a Python data source over folders of raw captures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a sample by its type; values are floats, whole numbers of 16 bits in units of 1/32768.
WIDTH = {"float32": 4, "int16": 2}


def store(path: str):
    """The file system of a path and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Slice(InputPartition):
    """Chunks of one session: where their bytes lie, as (file, first byte, bytes), and the number of the first."""

    session: str
    first: int
    pieces: list[tuple[str, int, int]]


class SampleChunks(DataSource):
    """``spark.readStream.format("sample_chunks")``: (session, seq, samples) in chunks of ``chunk`` samples.

    ``path`` holds a folder for each session, and in it files of raw samples, which follow each other by name; a
    capture appends by adding files (names that begin with ``.`` or ``_`` are still being written).  A chunk may span any
    number of files; samples that don't fill one wait for more.  Options: ``chunk`` (9600), ``sampleType`` (float32 or
    int16), ``chunksPerTask`` (4096: what one task reads at most).

    An offset is the number of chunks delivered by session, so a batch that is run again, or a restart from a checkpoint,
    cuts the same chunks from the same bytes.  Files must not change once they are there; the driver holds file names and
    sizes, never samples."""

    @classmethod
    def name(cls) -> str:
        return "sample_chunks"

    def schema(self) -> str:
        return "session string, seq long, samples array<float>"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Chunks(dict(self.options))


class _Chunks(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"].rstrip("/"), options.get("sampletype", options.get("sampleType", "float32"))
        if self.kind not in WIDTH:
            raise ValueError(f"sampleType {self.kind}")
        self.size = int(options.get("chunk", 9600)) * WIDTH[self.kind]
        self.most = int(options.get("chunkspertask", options.get("chunksPerTask", 4096)))
        if self.size <= 0 or self.most <= 0:
            raise ValueError("chunk and chunksPerTask are positive")

    def _files(self) -> dict[str, list[tuple[str, int]]]:
        from pyarrow import fs

        where, root = store(self.path)
        found: dict[str, list[tuple[str, int]]] = {}
        for f in where.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
            inner = f.path[len(root) :].strip("/").split("/")
            if f.type == fs.FileType.File and len(inner) == 2 and not inner[1].startswith((".", "_")):
                found.setdefault(inner[0], []).append((f.path, f.size))
        return {session: sorted(files) for session, files in sorted(found.items())}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {session: n for session, files in self._files().items() if (n := sum(size for _, size in files) // self.size)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        files = self._files()
        out: list[InputPartition] = []
        for session, until in sorted(end.items()):
            for first in range(start.get(session, 0), until, self.most):
                lo, hi, at, pieces = first * self.size, min(first + self.most, until) * self.size, 0, []
                for path, size in files.get(session, []):
                    a, b = max(lo, at), min(hi, at + size)
                    if a < b:
                        pieces.append((path, a - at, b - a))
                    at += size
                if at < hi:
                    raise ValueError(f"files of session {session} have gone")
                out.append(Slice(session, first, pieces))
        return out

    def read(self, partition: InputPartition) -> Iterator:
        import numpy as np
        import pyarrow as pa

        where, _ = store(self.path)
        seq, rest = partition.first, b""
        for path, at, length in partition.pieces:
            with where.open_input_file(path) as f:
                f.seek(at)
                while length:
                    part = f.read(min(length, max(self.size, 1 << 20)))
                    if not part:
                        raise ValueError(f"{path} has become shorter")
                    length -= len(part)
                    rest += part
                    whole = len(rest) // self.size
                    if whole:
                        x = np.frombuffer(rest[: whole * self.size], "<f4" if self.kind == "float32" else "<i2").astype(np.float32)
                        x = x / np.float32(32768) if self.kind == "int16" else x
                        samples = pa.FixedSizeListArray.from_arrays(pa.array(x), self.size // WIDTH[self.kind]).cast(pa.list_(pa.float32()))
                        yield pa.RecordBatch.from_arrays([pa.array([partition.session] * whole), pa.array(range(seq, seq + whole), pa.int64()), samples], ["session", "seq", "samples"])
                        seq, rest = seq + whole, rest[whole * self.size :]


def register(spark: SparkSession) -> None:
    """Make the data source known to a session."""
    spark.dataSource.register(SampleChunks)
