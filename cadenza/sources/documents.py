"""One ordered file from many tasks, partial reports by epoch, writes that are stopped by what they see."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.text import stem
from ..operators.scans import cut, scan
from ..workspace import scratch
from .samples import store

#: Bytes that are copied at once when parts are joined.
COPY = 8 << 20


@dataclass
class Part(WriterCommitMessage):
    """A task's file: its number, where it lies, whether it has any line."""

    number: int
    path: str
    filled: bool


class OrderedFile(DataSource):
    """``df.write.format("ordered_file")``: the lines of a frame (one string column) as one file, in the order of its partitions.

    Options: ``path`` (a file that doesn't exist yet, on a store that driver and executors share), ``head``, ``between`` and
    ``foot``, written before, between and after lines.  Each task writes a part; the commit joins the parts in order, block by
    block, into a hidden file and renames it.  A job that fails leaves neither file nor parts."""

    @classmethod
    def name(cls) -> str:
        return "ordered_file"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.where, self.path = options["path"], store(options["path"])[1]
        self.head, self.between, self.foot = (options.get(k, "").encode() for k in ("head", "between", "foot"))
        folder, _, name = self.path.rpartition("/")
        self.parts = f"{folder}/.{name}-{uuid.uuid4().hex}"
        from pyarrow import fs

        if store(self.where)[0].get_file_info(self.path).type != fs.FileType.NotFound:
            raise FileExistsError(self.path)
        store(self.where)[0].create_dir(self.parts, recursive=True)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        number, path = context.partitionId(), f"{self.parts}/{context.partitionId()}-{context.taskAttemptId()}"
        filled = False
        with store(self.where)[0].open_output_stream(path) as out:
            for row in iterator:
                out.write((self.between if filled else b"") + row[0].encode())
                filled = True
        return Part(number, path, filled)

    def commit(self, messages: list) -> None:
        where, whole, first = store(self.where)[0], f"{self.parts}/whole", True
        with where.open_output_stream(whole) as out:
            out.write(self.head)
            for part in sorted((m for m in messages if m and m.filled), key=lambda m: m.number):
                if not first:
                    out.write(self.between)
                first = False
                with where.open_input_stream(part.path) as f:
                    while block := f.read(COPY):
                        out.write(block)
            out.write(self.foot)
        where.move(whole, self.path)
        where.delete_dir(self.parts)

    def abort(self, messages: list) -> None:
        store(self.where)[0].delete_dir(self.parts)


def write_ordered(lines: DataFrame, order: list[str], value: str, path: str, *, head: str = "", between: str = "\n", foot: str = "") -> None:
    """The lines in column ``value`` as one file in the given order, whatever their number; refuses a path that exists."""
    lines.sparkSession.dataSource.register(OrderedFile)
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order).select(F.coalesce(F.col(value), F.lit("")).alias("value"))
    ranged.write.format("ordered_file").options(path=path, head=head, between=between, foot=foot).mode("append").save()


def write_submission(rows: DataFrame, path: str, cer: Column, rr: Column, seconds: float) -> None:
    """The document of ``sinks.submission`` as a file: items are written by tasks in the order of ``ord``; the driver has its averages."""
    ident = F.coalesce(F.col("id").cast("string"), stem(F.col("audio")))
    item = F.to_json(F.struct(ident.alias("id"), "content", "label", "cer"))
    means = rows.agg(cer.alias("cer"), rr.alias("rr")).first()
    foot = "".join(f', "{k}": {json.dumps(v)}' for k, v in (("avg_cer", means["cer"]), ("avg_rr", means["rr"]), ("duration", seconds)) if v is not None)
    write_ordered(rows.select("ord", item.alias("item")), ["ord"], "item", path, head='{"result": {"results": [\n', between=",\n", foot=f"\n]{foot}}}}}\n")


#: Lines that one digest of a list of digests stands for.
FAN = 4096


def listed_digest(lines: DataFrame, order: list[str], value: str) -> DataFrame:
    """(value): one SHA-256 for an ordered list of lines of any length.

    Each run of ``FAN`` lines, joined by line feeds, has a digest; these are lines again, until there is one.  Up to ``FAN``
    lines it is the digest of the lines themselves; no lines have that of the empty text."""
    now, by = lines.select(*order, F.col(value).alias("_line")), order
    while True:
        placed = scan(cut(now, [], by), [], by, {"_n": ("sum", F.lit(1).cast("long"))})
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "\n")
        now, by = placed.groupBy(F.expr(f"(_n - 1) div {FAN}").alias("_run")).agg(F.sha2(joined, 256).alias("_line")), ["_run"]
        if now.limit(2).count() < 2:
            return now.agg(F.coalesce(F.max("_line"), F.sha2(F.lit(""), 256)).alias("value"))


def partial_reports(stream: DataFrame, keys: list[str], sums: dict[str, Column], path: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: each epoch's sums by key go to a folder of its own, which a batch that is run again
    replaces.  So no row counts twice, wherever a run is cut off; see ``report_so_far``."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.groupBy(*keys).agg(*[x.alias(name) for name, x in sums.items()]).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def report_so_far(spark: SparkSession, path: str, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """The sums over all epochs written so far; they are taken by adding up (counts and sums, no averages)."""
    epochs = spark.read.option("basePath", path).parquet(f"{path}/epoch=*")
    return epochs.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in sums])


def non_finite(c: str) -> Column:
    """Null, NaN or infinite."""
    x = F.col(c).cast("double")
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def non_finite_terms(df: DataFrame, columns: list[str]) -> DataFrame:
    """(term, n): the columns that have values that aren't finite, and how many."""
    counts = df.agg(*[F.count_if(non_finite(c)).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("term"), F.col(f"`{c}`").alias("n")) for c in columns])).alias("x")
    return counts.select(pairs).select("x.*").filter("n > 0")


def write_finite(df: DataFrame, path: str, columns: list[str]) -> int:
    """Write a Parquet table whose terms are all finite, and return its rows.  They are counted as they are written, in one
    pass; if any isn't, the files go before anyone can see them and the terms are named in the error."""
    spark = df.sparkSession
    seen, hidden = Observation(f"finite-{uuid.uuid4().hex}"), scratch(spark, "finite")
    df.observe(seen, F.count("*").alias("_rows"), *[F.count_if(non_finite(c)).alias(f"_c{i}") for i, c in enumerate(columns)]).write.parquet(hidden)
    got = seen.get
    bad = {c: got[f"_c{i}"] for i, c in enumerate(columns) if got[f"_c{i}"]}
    java = spark._jvm.org.apache.hadoop.fs.Path
    files = java(hidden).getFileSystem(spark._jsc.hadoopConfiguration())
    if bad:
        files.delete(java(hidden), True)
        raise ValueError(f"not finite: {bad}")
    target = java(path)
    if files.exists(target) or not files.mkdirs(target.getParent()) or not files.rename(java(hidden), target):
        files.delete(java(hidden), True)
        raise FileExistsError(path)
    return got["_rows"]
