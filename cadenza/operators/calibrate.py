"""Logistic models fitted by distributed sums: each iteration is one aggregate of a few numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import clip, logit, sigmoid
from ..workspace import materialize


def _sums(df: DataFrame, exprs: list[Column]) -> np.ndarray:
    return np.array([0.0 if v is None else float(v) for v in df.agg(*exprs).first()])


def fit_irls(rows: DataFrame, features: list[str], label: str, *, l2: float = 1.0, intercept: bool = True, tol: float = 1e-6, rounds: int = 100) -> dict:
    """Class-balanced (weights of either class sum to one half), L2 without the intercept, Newton steps until the largest change is below ``tol``.

    Each round sums the gradient and the upper triangle of the Hessian where the rows lie; the driver solves a system of
    the number of features."""
    data = materialize(rows.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_y")), "fit")
    n1, n = (float(v or 0) for v in data.agg(F.sum("_y"), F.count("*")).first())
    if n1 == 0 or n1 == n:
        raise ValueError("both classes are needed")
    w = F.when(F.col("_y") == 1, 0.5 / n1).otherwise(0.5 / (n - n1))
    x = [*([F.lit(1.0)] if intercept else []), *[F.col(f) for f in features]]
    beta, k = np.zeros(len(x)), len(x)
    penalty = np.full(k, l2)
    penalty[0] = 0.0  # the first coefficient goes free, which without an intercept is the first feature
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    for done in range(1, rounds + 1):
        z = F.lit(0.0)
        for b, c in zip(beta, x, strict=True):
            z = z + float(b) * c
        p = sigmoid(z)
        got = _sums(data, [*[F.sum(w * (F.col("_y") - p) * c) for c in x], *[F.sum(w * p * (1 - p) * x[i] * x[j]) for i, j in upper]])
        hessian = np.zeros((k, k))
        for v, (i, j) in zip(got[k:], upper, strict=True):
            hessian[i, j] = hessian[j, i] = v
        step = np.linalg.solve(hessian + np.diag(penalty) + 1e-12 * np.eye(k), got[:k] - penalty * beta)
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    return {"features": features, "intercept": float(beta[0]) if intercept else 0.0, "weights": beta[1:].tolist() if intercept else beta.tolist(), "rounds": done}


def probability(model: dict) -> Column:
    """Clipped to [1e-6, 1 - 1e-6]."""
    z = F.lit(model["intercept"])
    for f, b in zip(model["features"], model["weights"], strict=True):
        z = z + float(b) * F.col(f).cast("double")
    return clip(sigmoid(z), 1e-6, 1 - 1e-6)


def log_likelihood_ratio(p: Column, prior: float = 0.5) -> Column:
    return logit(p) - float(np.log(prior / (1 - prior)))


#: Distinct feature vectors that the driver takes for descent; with more, each epoch is a job over blocks of them.
MOST_VECTORS, BLOCK = 200_000, 65_536


def _step(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray, bias: float) -> np.ndarray:
    """Summed gradients of the weights and of the bias."""
    g = w * (1 / (1 + np.exp(-np.clip(x @ beta + bias, -10, 10))) - y)
    return np.append(x.T @ g, g.sum())


def _blocks(counted: DataFrame, names: list[str], mean: np.ndarray, scale: np.ndarray, half: tuple[float, float]) -> DataFrame:
    """Scaled vectors, labels and weights, ``BLOCK`` vectors a row, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(names))], 1) - mean) / scale
            y, n = (batch.column(len(names) + i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1))
            data = np.column_stack([x, y, n * np.where(y == 1, *half)])
            for i in range(0, len(data), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([data[i : i + BLOCK].tobytes()], pa.binary())], ["block"])

    return materialize(counted.mapInArrow(run, "block binary"), "gate")


def _gradient(blocks: DataFrame, width: int, beta: np.ndarray, bias: float) -> np.ndarray:
    """The gradient over all blocks: one row of sums for each task, then one altogether."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1)
        for batch in batches:
            for raw in batch.column(0):
                data = np.frombuffer(raw.as_buffer(), float).reshape(-1, width + 2)
                total += _step(data[:, :width], data[:, width], data[:, width + 1], beta, bias)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], [f"g{i}" for i in range(width + 1)])

    names = [f"g{i}" for i in range(width + 1)]
    return _sums(blocks.mapInArrow(run, ", ".join(f"{c} double" for c in names)), [F.sum(c) for c in names])


def fit_gate(rows: DataFrame, features: list[str], label: str, *, epochs: int = 2000, rate: float = 0.02, l2: float = 0.001, seed: int = 7, start: dict | None = None) -> dict:
    """Full-batch gradient descent with balanced classes, clipped gradients (5), weights (20) and logits (10).

    Feature vectors recur, so rows are counted by distinct vector first.  Up to ``MOST_VECTORS`` of them are descended on
    the driver; beyond that each epoch sums partial gradients where the vectors lie, and the driver sees one row of sums.
    Both take the same steps.  ``start``, an earlier model of the same scaling, goes on from its weights; else they are a normal draw of this
    library's generator."""
    stats = rows.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop))], F.sum(F.col(label).cast("double")).alias("ones"), F.count(label).alias("n")).first()
    mean = np.array([stats[f"m{i}"] for i in range(len(features))], float)
    scale = np.array([stats[f"s{i}"] or 0.0 for i in range(len(features))], float)
    scale[scale < 1e-8] = 1.0
    ones, n = float(stats["ones"] or 0), float(stats["n"])
    half = 0.5 / max(ones, 1), 0.5 / max(n - ones, 1)
    counted = materialize(rows.groupBy(*features, label).agg(F.count("*").alias("_n")), "vectors")
    if counted.count() <= MOST_VECTORS:
        held = counted.toPandas()
        x, y = (held[features].to_numpy(float) - mean) / scale, held[label].to_numpy(float)
        w = held["_n"].to_numpy(float) * np.where(y == 1, *half)
        gradient = lambda beta, bias: _step(x, y, w, beta, bias)
    else:
        blocks = _blocks(counted.select(*features, label, "_n"), features, mean, scale, half)
        gradient = lambda beta, bias: _gradient(blocks, len(features), beta, bias)
    beta, bias = (np.array(start["weights"], float), float(start["bias"])) if start else (np.random.default_rng(seed).normal(0, 0.01, len(features)), 0.0)
    for _ in range(epochs):
        g = gradient(beta, bias)
        beta = np.clip(beta - rate * np.clip(g[:-1] + l2 * beta, -5, 5), -20, 20)
        bias -= rate * float(np.clip(g[-1], -5, 5))
    return {"feature_names": features, "feature_mean": mean.tolist(), "feature_scale": scale.tolist(), "weights": beta.tolist(), "bias": bias, "threshold": 0.5}
