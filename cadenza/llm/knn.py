"""Exact top-k by inner product as a Voronoi join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import materialize

#: Pivots at most; their distances to each other and k + 1 distances for each are all that the driver holds.
MAX_PIVOTS = 512
QUERIES_PER_PIVOT = 512
#: Rows of a local problem.
QUERY_BLOCK, DATA_BLOCK = 2048, 16384


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as float64, shorter vectors padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n and (size == dim).all():
        return flat.reshape(n, dim)
    out = np.zeros((n, dim))
    rows = np.repeat(np.arange(n), size)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _far(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> np.ndarray:
    """Distances to the pivots, one more coordinate included."""
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T + (extra[:, None] - pivot_extra) ** 2
    return np.sqrt(np.maximum(square, 0))


def _best(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, exact: bool) -> dict[str, np.ndarray]:
    """The k highest products of each query, ties to the smaller id; a row is no neighbour of its own."""
    order = np.argsort(xid, kind="stable")
    x, xid = x[order], xid[order]
    if not exact:  # products beyond what a double holds
        q, x = q.astype(np.int64), x.astype(np.int64)
    none = -np.inf if exact else np.iinfo(np.int64).min
    out_q, out_x, out_s = [], [], []
    for a in range(0, len(q), 256):
        part, ids = q[a : a + 256], qid[a : a + 256]
        scores = part @ x.T
        scores[ids[:, None] == xid[None, :]] = none
        for row, one in zip(scores, ids, strict=True):
            if len(row) > k:
                limit = row[np.argpartition(row, len(row) - k)[len(row) - k]]
                above = np.flatnonzero(row > limit)
                pick = np.concatenate([above, np.flatnonzero(row == limit)[: k - len(above)]])
            else:
                pick = np.arange(len(row))
            pick = pick[row[pick] > none]
            out_q.append(np.full(len(pick), one))
            out_x.append(xid[pick])
            out_s.append(row[pick])
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return {"query_id": join(out_q, np.int64), "vec_id": join(out_x, np.int64), "score": join(out_s, np.int64)}


def _nearest_ids(far: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n least distances of different ids, in order, and the ids: however often an id occurs, n others than any one lie within
    the last of n + 1."""
    order = np.argsort(far, kind="stable")
    first = np.sort(np.unique(ids[order], return_index=True)[1])[:n]
    return far[order][first], ids[order][first]


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """floor(scale * component); rows whose vector (or id) is null or holds a null or non-finite component are left out."""
    x = F.col(vec_col)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return vectors.filter(x.isNotNull() & F.col(id_col).isNotNull() & ~odd).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale)))).alias("v"))


def voronoi_top_k(vectors: DataFrame, is_query: Column, k: int = 20, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """For each row for which ``is_query`` (an expression over ``id_col`` as ``id``) holds, the k other rows of highest
    integer inner product; ties go to the smaller id.

    Products become distances by one more coordinate: sqrt(M - |x|**2) for data, M the largest squared norm, and 0 for
    queries; then nearer means higher.  Rows join the cell of their nearest pivot.  Each cell's k + 1 least distances (of different ids) to
    its pivot bound, with the distances between pivots, how far the k-th neighbour of any query of a cell can be; a data
    row goes to a query cell only if the triangle inequality lets it lie within that bound.  Bounds are widened by a
    rounding allowance, so no neighbour is lost.  Cells are cut into blocks of bounded size by hash (a cell may hold
    any share of the rows), each pair of blocks is solved by one matrix product, and the local winners are merged.

    Null ids or vectors, and vectors with null or non-finite components, take no part; shorter vectors count as padded
    with zeros; an id that occurs twice is one candidate per row, no candidate of itself, and as a
    query one whose answers are those of all its rows.  Products are whole numbers of up to
    62 bits; vectors that could give larger ones are refused.  With fewer than k
    candidates all are returned.  Returns query_id, rank (from 1), vec_id, score.
    """
    spark = vectors.sparkSession
    base = materialize(integer_vectors(vectors, id_col, vec_col, scale), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))
    facts = base.agg(F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("nq"), F.max(F.size("v")).alias("dim"), F.max(norm).alias("m"), F.max(F.array_max(F.transform("v", lambda y: F.abs(y)))).alias("top")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not facts["n"] or not facts["nq"] or not facts["dim"]:
        return spark.createDataFrame([], schema)
    dim, reach, exact = facts["dim"], float(facts["m"]), facts["dim"] * float(facts["top"] or 0) ** 2 < 2**53
    if dim * float(facts["top"] or 0) ** 2 >= 2**62:
        raise ValueError("scores would not fit into 64 bits")
    n_pivots = min(MAX_PIVOTS, max(8, -(-facts["nq"] // QUERIES_PER_PIVOT)))
    picked = base.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(n_pivots).collect()
    pivots = np.zeros((len(picked), dim))
    for i, row in enumerate(picked):
        pivots[i, : len(row["v"])] = row["v"]
    pivot_extra = np.sqrt(np.maximum(reach - (pivots * pivots).sum(1), 0))
    n_cells, slack = len(pivots), 1e-6 * np.sqrt(reach + 1) + 1e-6

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = [(np.zeros(0), np.zeros(0, np.int64)) for _ in range(n_cells)]
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            far = _far(x, np.sqrt(np.maximum(reach - (x * x).sum(1), 0)), pivots, pivot_extra)
            cell, own = far.argmin(1), batch.column(1).to_numpy()
            for c in np.unique(cell):
                least[c] = _nearest_ids(np.concatenate([least[c][0], far[cell == c, c]]), np.concatenate([least[c][1], own[cell == c]]), k + 1)
        for c, (x, i) in enumerate(least):
            yield pa.record_batch([pa.array(np.full(len(x), c), pa.int32()), pa.array(x), pa.array(i)], ["cell", "far", "id"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            far = _far(x, np.zeros(len(x)), pivots, pivot_extra)
            cell = far.argmin(1)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(far[np.arange(len(x)), cell])], ["id", "v", "cell", "far"])

    nearest = Window.partitionBy("cell").orderBy("far", "id")
    closest = base.select("v", "id").mapInArrow(summarise, "cell int, far double, id bigint").groupBy("cell", "id").agg(F.min("far").alias("far"))
    summary = closest.withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= k + 1).toPandas()
    queries = materialize(base.filter(is_query).mapInArrow(place, "id bigint, v array<bigint>, cell int, far double"), "queries")
    groups = queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).toPandas()
    between = _far(pivots, pivot_extra, pivots, pivot_extra)
    cell_of, reach_of = summary["cell"].to_numpy(), summary["far"].to_numpy()
    radius, bound, parts = np.zeros(n_cells), np.full(n_cells, -1.0), np.zeros(n_cells, int)
    for c, n, r in groups.itertuples(index=False):
        upper, _ = _nearest_ids(r + between[c][cell_of] + reach_of, summary["id"].to_numpy(), k + 1)
        radius[c], parts[c] = r, -(-n // QUERY_BLOCK)
        bound[c] = upper[k] if len(upper) > k else np.inf
    blocks = max(1, -(-facts["n"] // DATA_BLOCK))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                x = _matrix(batch.column(1), dim)
                far = _far(x, np.sqrt(np.maximum(reach - (x * x).sum(1), 0)), pivots, pivot_extra)
                row, cell = np.nonzero((far - radius <= bound + slack) & (parts > 0))
                times = parts[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                rows = pa.array(row)
                yield pa.record_batch([pa.array(cell, pa.int32()), pa.array(part, pa.int32()), batch.column(2).take(rows), batch.column(0).take(rows), batch.column(1).take(rows)], ["cell", "part", "block", "id", "v"])

    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    data = base.select("id", "v", block.alias("block")).mapInArrow(replicate, "cell int, part int, block int, id bigint, v array<bigint>")
    part_of = F.lit([int(p) or 1 for p in parts])
    asked = queries.select("cell", F.pmod(F.xxhash64("id", F.lit(7)), F.element_at(part_of, F.col("cell") + 1)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v")

    def solve(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        side = lambda pdf: _matrix(pa.array(pdf["v"], pa.list_(pa.int64())), dim)
        return pd.DataFrame(_best(side(left), left["id"].to_numpy(), side(right), right["id"].to_numpy(), k, exact))

    keys = ["cell", "part", "block"]
    local = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(solve, "query_id bigint, vec_id bigint, score bigint")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
