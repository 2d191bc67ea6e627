"""Shard placement through a permutation-filled lookup table, with DataFrame operations only."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = 65_537) -> list[int]:
    """Which shard each slot belongs to.

    A shard's preference order visits all slots of the prime-sized table: (offset + j * skip) mod size, offset and skip
    from its name's digest.  Shards take turns; each claims the first slot of its order that is still free.  So shards
    differ by one slot at most, and a shard that comes or goes moves little else.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards: distinct names, at least one")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("size: a prime, no smaller than the number of shards")
    digest = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % size for d in digest]
    skip = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 if size > 2 else 1 for d in digest]
    table, free = [-1] * size, size
    while free:
        for s in range(len(shards)):
            while table[at[s]] >= 0:
                at[s] = (at[s] + skip[s]) % size
            table[at[s]] = s
            free -= 1
            if not free:
                break
    return table


def lookup_frame(spark: SparkSession, shards: list[str], size: int = 65_537) -> DataFrame:
    """The table as (slot, shard, shard_name), made of literals."""
    names = F.array(*[F.lit(s) for s in shards])
    packed = F.lit(",".join(map(str, lookup_table(shards, size))))
    return spark.range(1).select(F.posexplode(F.split(packed, ",")).alias("slot", "s")).select("slot", F.col("s").cast("int").alias("shard"), F.element_at(names, F.col("s").cast("int") + 1).alias("shard_name"))


def assign_shards(rows: DataFrame, shards: list[str], *, key_col: str = "doc_id", size: int = 65_537) -> DataFrame:
    """Add slot, shard (number) and shard_name to every row, by a digest of the key's text.

    The broadcast side has ``size`` rows whatever the data; rows are not shuffled.  All rows of a key go to one shard, so
    the key should be fine-grained (a document, not a source).  A null key counts as the empty string.  Columns of these three
    names in the input are replaced; an empty table gives an empty result.
    """
    rows = rows.drop(*[c for c in ("slot", "shard", "shard_name") if c in rows.columns])
    digest = F.sha2(F.coalesce(F.col(key_col).cast("string"), F.lit("")), 256)
    slot = F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")
    return rows.withColumn("slot", slot).join(F.broadcast(lookup_frame(rows.sparkSession, shards, size)), "slot")
