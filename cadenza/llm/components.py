"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import discard, materialize

#: Rounds after which something must be wrong: they grow with the logarithm of the longest path.
MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """Label the nodes of undirected edges (a, b) with the smallest node they reach.

    Alternating large-star and small-star rounds: every node's larger neighbours, then its smaller ones, are linked to the
    smallest neighbour, until all edges point at roots.  Minima are pre-aggregated before the shuffle; a node with very many
    neighbours is a skewed join key, which adaptive execution splits.  Each round is written to the shared folder.

    Null ends and self-links are ignored.  Returns (node, component) for nodes that have a link, roots included.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a > b").distinct()
        after = materialize(small, "edges")
        discard(now)
        now, was = after, mark
        mark = _mark(now)
        if mark == was:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def facing_blocks(members: DataFrame, block: int) -> DataFrame:
    """Deal the members (bucket, node, comp) of each bucket that holds several components to pairs of blocks (lo <= hi), so
    that any two of different components meet in one: (bucket, lo, hi, block) and the other columns.

    Members of a bucket's largest component need not meet each other.  So they get blocks of their own, which face only those
    of the other members: a bucket of one huge component and a few strays moves its rows once for each block of strays.
    """
    counted = members.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    most = counted.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"), F.count("*").alias("n_comps"))
    strays, mains = F.ceil((F.col("n_all") - F.col("n_main")) / block).cast("int"), F.ceil(F.col("n_main") / block).cast("int")
    most = most.filter("n_comps > 1").select("bucket", "main", strays.alias("strays"), mains.alias("mains"))
    is_main = F.col("comp") == F.col("main")
    h = F.xxhash64("node")
    own = F.when(is_main, F.col("strays") + F.pmod(h, F.col("mains"))).otherwise(F.pmod(h, F.col("strays"))).cast("int")
    rows = members.join(most, "bucket").withColumn("block", own)
    others = F.sequence(F.lit(0), F.when(is_main, F.col("strays") - 1).otherwise(F.col("strays") + F.col("mains") - 1))
    kept = [c for c in members.columns if c != "bucket"]
    rows = rows.select("bucket", *kept, "block", F.explode(others).alias("other"))
    return rows.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", *kept)


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.bitwiseAND((1 << 31) - 1)), F.sum(F.shiftrightunsigned(h, 33))).first())
