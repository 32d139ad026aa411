"""The two main axes of the one-hot matrix by subspace iteration, without a column per category (RES-6).

A few directions are kept as their loadings: an array on the driver for the numeric columns, a table (slot, loadings) for the
slots of text columns.  A round projects the centred rows on the directions (one join of the slot table per text column,
which Spark broadcasts only while its measured size is small), adds up the projections per column and slot, and takes the axes within
the subspace so spanned.  Rounds end when the variance on the first two axes grows no more; where the directions are as many as the
columns, the first round is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .rows import Layout

DIRECTIONS, ROUNDS, TOLERANCE = 8, 30, 1e-9


def _combine(columns: list[Column], weights: np.ndarray) -> Column:
    out = F.lit(0.0)
    for c, w in zip(columns, weights.tolist()):
        out = out + c * F.lit(float(w))
    return out


def _loadings(k: int, prefix: str = "v") -> list[Column]:
    return [F.col(f"{prefix}{j}") for j in range(k)]


def _gram(table: DataFrame | None, left: str, right: str, k: int) -> np.ndarray:
    """k x k products of two sets of loadings of the same table."""
    if table is None:
        return np.zeros((k, k))
    row = table.agg(*[F.sum(F.col(f"{left}{i}") * F.col(f"{right}{j}")) for i in range(k) for j in range(k)]).first()
    return np.array([x or 0.0 for x in row]).reshape(k, k)


def main_axes(df: DataFrame, feature_columns: list[str], keep: list[str], axes: int = 2) -> tuple[DataFrame, np.ndarray, float]:
    """(``keep`` and the centred coordinates ``p0``, ``p1``, ...; the variance on each axis; the total variance).

    An axis has no sign of its own: the sum of its loadings' cubes is made positive for two columns or more of text, the
    largest loading (the first of equals) where all columns are numeric."""
    layout = Layout.of(df, feature_columns)
    rows = reliable_checkpoint(df.select(*keep, *layout.columns()))
    numeric = len(layout.numeric)
    num = [F.col("__num")[k] for k in range(numeric)]
    slots = None
    if layout.text:
        slots = reliable_checkpoint(rows.select(F.explode("__cat").alias("slot")).groupBy("slot").agg(F.count("*").alias("n")))
    n, *sums = rows.agg(F.count("*"), *map(F.sum, num), *[F.sum(c * c) for c in num]).first()
    if not n:
        return rows.select(*keep, *[F.lit(0.0).alias(f"p{j}") for j in range(axes)]), np.zeros(axes), 0.0
    mean = np.array(sums[:numeric]) / n
    hot, squares = (slots.agg(F.count("*"), F.sum(F.col("n") * F.col("n").cast("double"))).first() if slots is not None else (0, 0.0))
    total = float((np.array(sums[numeric:]) / n - mean ** 2).sum() + len(layout.text) - (squares or 0.0) / n / n)
    k = min(DIRECTIONS, numeric + int(hot))
    rng = np.random.default_rng(42)
    v = rng.normal(size=(numeric, k))
    table = None
    if slots is not None:
        table = slots.select("slot", "n", *[(F.xxhash64("slot", F.lit(j)) / F.lit(2.0 ** 62)).alias(f"v{j}") for j in range(k)])

    def orthonormal(v: np.ndarray, table: DataFrame | None):
        gram = v.T @ v + _gram(table, "v", "v", k)
        values, vectors = np.linalg.eigh(gram)
        good = values > 1e-12 * max(values.max(), 1e-300)
        turn = vectors[:, good] / np.sqrt(values[good])
        turn = np.hstack([turn, np.zeros((k, k - turn.shape[1]))])
        if table is not None:
            table = table.select("slot", "n", *[_combine(_loadings(k), turn[:, j]).alias(f"v{j}") for j in range(k)])
        return v @ turn, table

    def project(v: np.ndarray, table: DataFrame | None) -> DataFrame:
        """The rows with their centred coordinates y0, y1, ..."""
        out, parts = rows, [[] for _ in range(k)]
        centre = mean @ v
        if table is not None:
            centre = centre + np.array([x or 0.0 for x in table.agg(*[F.sum(F.col("n") * c) for c in _loadings(k)]).first()]) / n
            for c in range(len(layout.text)):
                own = table.select(F.col("slot").alias(f"s{c}"), *[F.col(f"v{j}").alias(f"w{c}_{j}") for j in range(k)])
                out = out.join(own, F.col("__cat")[c] == F.col(f"s{c}"))
                for j in range(k):
                    parts[j].append(F.col(f"w{c}_{j}"))
        return out.select(*keep, "__num", "__cat", *[
            (_combine(num, v[:, j]) + sum(parts[j], F.lit(0.0)) - F.lit(float(centre[j]))).alias(f"y{j}") for j in range(k)])

    v, table = orthonormal(v, table)
    before = -1.0
    for _ in range(ROUNDS):
        y = project(v, table)
        ys = [F.col(f"y{j}") for j in range(k)]
        found = y.agg(*[F.sum((num[a] - F.lit(float(mean[a]))) * c) for a in range(numeric) for c in ys] or [F.count("*")]).first()
        b = np.array(list(found)).reshape(numeric, k) if numeric else np.zeros((0, k))
        fresh = None
        if table is not None:
            per = y.select(F.explode("__cat").alias("slot"), *ys).groupBy("slot").agg(*[F.sum(c).alias(f"b{j}") for j, c in enumerate(ys)])
            fresh = reliable_checkpoint(table.join(per, "slot"))
        inner = v.T @ b + _gram(fresh, "v", "b", k)
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(values)[::-1]
        values, vectors = values[order], vectors[:, order]
        variance = float(values[:axes].sum())
        if variance - before <= TOLERANCE * max(variance, 1e-300):
            break
        before = variance
        v = b
        if fresh is not None:
            table = fresh.select("slot", "n", *[F.col(f"b{j}").alias(f"v{j}") for j in range(k)])
        v, table = orthonormal(v, table)
    # the last round's directions, turned to the axes within them
    v = v @ vectors
    if table is not None:
        table = reliable_checkpoint(table.select("slot", "n", *[_combine(_loadings(k), vectors[:, j]).alias(f"v{j}") for j in range(k)]))
        cubes = (v ** 3).sum(0) + np.array([x or 0.0 for x in table.agg(*[F.sum(c * c * c) for c in _loadings(k)]).first()])
        sign = np.where(cubes >= 0, 1.0, -1.0)
    else:
        sign = np.array([1.0 if a[abs(a).round(9).argmax()] >= 0 else -1.0 for a in v.T])
    y = project(v, table)
    zero = F.lit(0.0)
    points = y.select(*keep, *[(F.col(f"y{j}") * F.lit(float(sign[j])) if j < k else zero).alias(f"p{j}") for j in range(axes)])
    shares = np.zeros(axes)
    shares[:min(axes, k)] = np.maximum(values[:axes], 0.0)[:k] / n
    return points, shares, total
