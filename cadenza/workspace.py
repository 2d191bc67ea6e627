"""Shared folders for intermediate tables.

Every intermediate that must outlive a lost executor is written as Parquet below the folder that the session names in
``spark.checkpoint.dir``.  Only where that is unset (tests, a laptop) a folder of our own is made and set.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: Whether a query's shuffle files go when it ends; else they lie on executors' disks until the driver's JVM collects its plan.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN.append(tempfile.mkdtemp(prefix="cadenza-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/cadenza/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage without relying on any executor.  What was shuffled
    for it goes at once; the session's own setting holds for all other queries."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def discard(df_or_path: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete a table that ``materialize`` wrote, once nothing reads it any more."""
    if isinstance(df_or_path, str):
        roots = {df_or_path}
    else:
        spark = df_or_path.sparkSession
        roots = {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()}
    for root in roots:
        if "/cadenza/" not in root:
            raise ValueError(f"{root} is not a scratch table")
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_pattern(path: str) -> str:
    """A pattern that only this path matches: streams read a file, as well as a folder, by pattern."""
    return re.sub(r"([\\{}\[\]*?,])", r"\\\1", path[:-1]) + f"[{path[-1]}]"
