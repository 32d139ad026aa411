"""One-class SVM (TRN-8), approximated for distributed data.

Exact kernel SVMs have no distributed solver here, so a kernel is approximated by ``n_components`` random features
whose inner products it is on average: random Fourier features for ``rbf``, products of random sign projections for ``poly`` (degree 3),
sign projections of the text slots beside the numbers themselves for ``linear``.  gamma is 1 / (columns x variance of all
cells) of the one-hot matrix.  The linear one-class primal

    min  1/2 ||w||^2 + 1/(nu n) sum_i max(0, rho - <w, z_i>) - rho,

its hinge rounded off over a narrow stretch, is solved by L-BFGS; an evaluation is one pass that maps the rows in blocks and
whose sums Spark adds up (one number per component reaches the driver).  ``anomaly_score = -<w, z(x)>`` (the negated
``score_samples`` up to a factor); anomalies are scores above the (1 - nu) quantile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reliable_checkpoint
from .rows import CACHED, Fourier, Layout, blocks, lbfgs, summed

DEGREE = 3
#: Where the hinge is rounded off, as a share of |mean feature|^2.
ROUND = 0.02


class Signs(Fourier):
    """Projections on random signs, keyed by slot; ``degree`` independent ones are multiplied."""

    def __init__(self, layout: Layout, gamma: float, size: int, seed: int = 42, degree: int = DEGREE):
        super().__init__(layout, 0.5, size * degree, seed)
        rng = np.random.default_rng(seed)
        self.numeric = rng.choice([-1.0, 1.0], size=(len(layout.numeric), size * degree))
        self.degree, self.width, self.factor = degree, size, gamma ** (degree / 2) / np.sqrt(size)

    def _slot(self, slot: int) -> np.ndarray:
        found = self.held.get(slot)
        if found is None:
            if len(self.held) >= self.HELD:
                self.held.clear()
            rng = np.random.Generator(np.random.Philox(key=[slot % (1 << 64), self.seed]))
            found = self.held[slot] = rng.choice([-1.0, 1.0], size=self.size)
        return found

    def _project(self, num: np.ndarray, cat: np.ndarray) -> np.ndarray:
        out = num @ self.numeric
        if cat.shape[1]:
            values, at = np.unique(cat, return_inverse=True)
            table = np.array([self._slot(int(s)) for s in values])
            for c in at.reshape(cat.shape).T:
                out += table[c]
        return out

    def map(self, num: np.ndarray, cat: np.ndarray) -> np.ndarray:
        return self._project(num, cat).reshape(len(num), self.degree, self.width).prod(1) * self.factor

    def quick(self, num: np.ndarray, cat: np.ndarray) -> np.ndarray:
        return self.map(num, cat)


class Linear(Signs):
    """The numbers as they are, and sign projections of the slots where there are text columns."""

    def __init__(self, layout: Layout, gamma: float, size: int, seed: int = 42):
        super().__init__(Layout([], layout.text), 1.0, size, seed, degree=1)
        self.numbers, self.texts = len(layout.numeric), bool(layout.text)
        self.slots, self.width = size, self.numbers + size * self.texts

    def map(self, num: np.ndarray, cat: np.ndarray) -> np.ndarray:
        if not self.texts:
            return num
        return np.hstack([num, self._project(np.zeros((len(num), 0)), cat) * self.factor])


KERNELS = {"rbf": Fourier, "poly": Signs, "linear": Linear}


class OneClassModel:
    """Feature map and weights."""

    def __init__(self, layout: Layout, features: Fourier, weights: np.ndarray):
        self.layout, self.features, self.weights = layout, features, weights

    def score(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and ``anomaly_score`` of rows that have the feature columns."""
        sent = df.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            own = sent.value
            for batch in batches:
                parts = [-(own.features.map(num, cat) @ own.weights) for _, num, cat in blocks(batch, own.layout)]
                s = np.concatenate(parts) if parts else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(s, pa.float64())], names=[*keep, "anomaly_score"])
        schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("anomaly_score", T.DoubleType())])
        return df.select(*keep, *self.layout.columns()).mapInArrow(run, schema)


def fit_one_class_svm(df: DataFrame, feature_columns: list[str], rid: str, nu: float = 0.1, kernel: str = "rbf",
                      n_components: int = 512, iterations: int = 60, seed: int = 42) -> OneClassModel:
    if kernel not in KERNELS:
        raise ValueError(f"kernel {kernel!r}: choose from {sorted(KERNELS)}; others have no feature map")
    layout = Layout.of(df, feature_columns)
    n, width, variance = layout.one_hot_moments(df)
    features = KERNELS[kernel](layout, 1.0 / (width * variance) if variance > 0 else 1.0, n_components, seed)
    size = features.width
    # read once per evaluation: kept on the executors; a lost block is rebuilt from the checkpoint
    rows = reliable_checkpoint(df.select(*layout.columns())).persist(StorageLevel.MEMORY_AND_DISK)
    spark = df.sparkSession

    def first(batches):
        out = np.zeros(size + 1)
        for batch in batches:
            for _, num, cat in blocks(batch, layout):
                z = features.map(num, cat)
                out[:-1] += z.sum(0)
                out[-1] += (z ** 2).sum()
        return out
    sums = summed(rows, first, size + 1) / max(n, 1)
    unit = np.sqrt(sums[-1]) or 1.0             # features are scaled to a mean square of one
    mean = sums[:-1] / unit
    soft = ROUND * max(mean @ mean, 1e-6)

    def evaluate(x: np.ndarray):
        w, rho = x[:-1], x[-1]
        sent = spark.sparkContext.broadcast((features, w, rho))

        def partial(batches):
            own, w, rho = sent.value
            out, w = np.zeros(size + 2), w / unit
            for batch in batches:
                for _, num, cat in blocks(batch, layout, CACHED):
                    z = own.quick(num, cat)
                    gap = rho - z @ w.astype(z.dtype)
                    slope = np.clip(gap / soft, 0.0, 1.0)
                    out[:size] += slope.astype(z.dtype) @ z
                    out[size] += slope.sum()
                    out[size + 1] += np.where(gap < soft, slope * gap / 2, gap - soft / 2).sum()
            out[:size] /= unit
            return out
        s = summed(rows, partial, size + 2) / (nu * max(n, 1))
        sent.destroy()
        return 0.5 * w @ w + s[size + 1] - rho, np.append(w - s[:size], s[size] - 1.0)

    best = lbfgs(evaluate, np.append(mean, mean @ mean), iterations, 1e-5)
    rows.unpersist()
    return OneClassModel(layout, features, best[:-1] * unit)


def one_class_svm(df: DataFrame, feature_columns: list[str], rid: str, nu: float = 0.1, n_components: int = 512,
                  iterations: int = 60, seed: int = 42, kernel: str = "rbf") -> DataFrame:
    base = reliable_checkpoint(df.select(*dict.fromkeys([rid, *feature_columns])))
    model = fit_one_class_svm(base, feature_columns, rid, nu, kernel, n_components, iterations, seed)
    scored = reliable_checkpoint(model.score(base, [rid]))
    q = scored.agg(F.percentile_approx("anomaly_score", 1.0 - float(nu), 100000).alias("q"))
    return scored.crossJoin(F.broadcast(q)).select(
        rid, "anomaly_score", F.when(F.col("anomaly_score") > F.col("q"), "anomaly").otherwise("normal")
        .alias("predicted_label"))
