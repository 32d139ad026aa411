"""Training rows without a column per category.

A row is ``__num``, its numeric features (null or NaN counts as 0), and ``__cat``, one 64-bit slot per text feature: the hash
of column and value, 'missing' for null.  A slot stands for the 0/1 column of the one-hot matrix that it would be;
no dictionary of values is made, so a text column may have any number of values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cardinality import distinct_counts
from ..operators.selection import _is_numeric, _number

#: Rows that a task maps at once, and in the passes of a solver, whose blocks shall stay in the processor's cache.
CHUNK, CACHED = 2048, 256


@dataclass
class Layout:
    """Which feature columns are numbers and which are texts."""
    numeric: list[str]
    text: list[str]

    @staticmethod
    def of(df: DataFrame, feature_columns: list[str]) -> "Layout":
        numeric = [c for c in feature_columns if _is_numeric(df.schema[c].dataType)]
        return Layout(numeric, [c for c in feature_columns if c not in numeric])

    def _text(self, c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("missing"))

    def columns(self) -> list[Column]:
        slots = [F.xxhash64(F.lit(c), self._text(c)) for c in self.text]
        return [F.array(*map(_number, self.numeric)).cast("array<double>").alias("__num"),
                F.array(*slots).cast("array<bigint>").alias("__cat")]

    def one_hot_moments(self, df: DataFrame) -> tuple[int, int, float]:
        """Rows, columns and variance over all cells of the one-hot matrix, which has an empty column for null per text
        feature; the matrix itself is never made."""
        sums = [F.sum(f(_number(c))) for c in self.numeric for f in (lambda x: x, lambda x: x * x)]
        n, *found = df.agg(F.count("*"), *sums).first()
        values = distinct_counts(df, {c: self._text(c) for c in self.text})
        width = len(self.numeric) + sum(values.values()) + len(self.text)
        cells = max(n * width, 1)
        mean = (sum(x or 0.0 for x in found[::2]) + n * len(self.text)) / cells
        return n, width, (sum(x or 0.0 for x in found[1::2]) + n * len(self.text)) / cells - mean * mean


def blocks(batch: pa.RecordBatch, layout: Layout, chunk: int = CHUNK):
    """(first row, numbers, slots) for stretches of a batch that has ``__num`` and ``__cat``."""
    n, names = batch.num_rows, batch.schema.names
    num = batch.column(names.index("__num")).flatten().to_numpy(zero_copy_only=False).reshape(n, len(layout.numeric))
    cat = batch.column(names.index("__cat")).flatten().to_numpy(zero_copy_only=False).reshape(n, len(layout.text))
    for at in range(0, n, chunk):
        yield at, num[at:at + chunk], cat[at:at + chunk]


class Fourier:
    """Random Fourier features of the RBF kernel exp(-gamma |x - y|^2) over the one-hot matrix.

    The frequencies of a slot are drawn from a generator keyed by the slot itself, so no table over all values is needed; a
    worker remembers some thousands of them."""

    HELD = 16_384

    def __init__(self, layout: Layout, gamma: float, size: int, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.scale, self.seed, self.size = np.sqrt(2.0 * gamma), seed, size
        self.numeric = rng.normal(scale=self.scale, size=(len(layout.numeric), size))
        self.shift = rng.uniform(0, 2 * np.pi, size=size)
        self.width, self.held = size, {}

    def __getstate__(self):
        return {**self.__dict__, "held": {}}

    def _slot(self, slot: int) -> np.ndarray:
        found = self.held.get(slot)
        if found is None:
            if len(self.held) >= self.HELD:
                self.held.clear()
            key = np.random.Philox(key=[slot % (1 << 64), self.seed])
            found = self.held[slot] = np.random.Generator(key).normal(scale=self.scale, size=self.size)
        return found

    def map(self, num: np.ndarray, cat: np.ndarray) -> np.ndarray:
        out = num @ self.numeric + self.shift
        if cat.shape[1]:
            values, at = np.unique(cat, return_inverse=True)
            table = np.array([self._slot(int(s)) for s in values])
            for c in at.reshape(cat.shape).T:
                out += table[c]
        return np.sqrt(2.0 / self.size) * np.cos(out)

    def quick(self, num: np.ndarray, cat: np.ndarray) -> np.ndarray:
        """``map`` in single precision, for the sums of many passes.  The phase is brought into one turn in double
        precision first, so an element is off by some 1e-7 of its range, however large the numbers are."""
        turn = 2 * np.pi
        out = num @ (self.numeric / turn) + self.shift / turn
        if cat.shape[1]:
            values, at = np.unique(cat, return_inverse=True)
            table = np.array([self._slot(int(s)) for s in values]) / turn
            for c in at.reshape(cat.shape).T:
                out += table[c]
        out -= np.rint(out)
        phase = out.astype(np.float32)
        phase *= np.float32(turn)
        np.cos(phase, out=phase)
        phase *= np.float32(np.sqrt(2.0 / self.size))
        return phase


def summed(rows: DataFrame, partial: Callable, size: int) -> np.ndarray:
    """``size`` numbers added up over all rows: ``partial(batches)`` gives a task's sums, Spark adds the tasks'."""
    def run(batches):
        total = np.asarray(partial(batches), float)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(total), dtype=np.int32)), "v": pa.array(total)})
    out = np.zeros(size)
    for i, v in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[i] = v
    return out


def lbfgs(value_and_gradient: Callable, start: np.ndarray, most: int = 40, tolerance: float = 1e-4, memory: int = 8) -> np.ndarray:
    """Minimise a smooth convex function; every evaluation is one pass over the rows.  Ends when the value falls by
    less than ``tolerance`` of itself, or after ``most`` evaluations."""
    x, (f, g) = start, value_and_gradient(start)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    used = 1
    while used < most:
        d, alphas = -g, []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            alphas.append(a)
            d = d - a * y
        if steps:
            s, y = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(steps, reversed(alphas)):
            d = d + s * (a - (y @ d) / (s @ y))
        slope, step = g @ d, 1.0 if steps else 1.0 / max(1.0, np.linalg.norm(g))
        if slope > -1e-14:
            break
        while used < most:
            fresh, (f1, g1) = x + step * d, value_and_gradient(x + step * d)
            used += 1
            if f1 <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        if (fresh - x) @ (g1 - g) > 1e-12:
            steps = [*steps, (fresh - x, g1 - g)][-memory:]
        done = f - f1 <= tolerance * max(abs(f), 1e-12)
        x, f, g = fresh, f1, g1
        if done:
            break
    return x
