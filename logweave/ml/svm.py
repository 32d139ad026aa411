"""Support vector classification with calibrated probabilities (TRN-4, TRN-5).

All classes are fitted one against the rest in one solver run: an evaluation is one pass over the rows that gives
the loss and gradient of every class at once (squared hinge, which is smooth, so that L-BFGS needs few passes).  The ``rbf``
kernel is approximated inside the pass by random Fourier features, gamma being 1 / (columns x variance of all cells) of the
one-hot matrix; ``linear`` works on that matrix itself, one weight per column.

Probabilities come from Platt's sigmoid of the margin.  Margins of training rows would be too good, so the same run
also fits models that each leave out one fold; a row's margin for the calibration is that of the model that has not seen it.  Their
distribution is counted in narrow bins by class, which is all that the fit of the two numbers of a sigmoid needs.
Shares of more than two classes are scaled to sum up to one.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reliable_checkpoint
from .rows import Fourier, Layout, blocks, lbfgs, summed

KERNELS = ("rbf", "linear")
FOLDS = 3
#: Margins are counted in bins of 1 / RESOLUTION up to LIMIT on either side.
RESOLUTION, LIMIT = 256, 16
BINS = 2 * RESOLUTION * LIMIT + 1


class OneHot:
    """The one-hot matrix: scaled numbers, then one column per known slot; a value never seen in training has none."""

    def __init__(self, layout: Layout, slots: np.ndarray, scale: np.ndarray):
        self.slots, self.scale = np.sort(slots), scale
        self.width = len(layout.numeric) + len(slots)

    def dot(self, num: np.ndarray, cat: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = (num * self.scale) @ weights[:num.shape[1]]
        for at, known in self._places(num, cat):
            out += np.where(known[:, None], weights[at], 0.0)
        return out

    def back(self, num: np.ndarray, cat: np.ndarray, slopes: np.ndarray) -> np.ndarray:
        out = np.zeros((self.width, slopes.shape[1]))
        out[:num.shape[1]] = (num * self.scale).T @ slopes
        for at, known in self._places(num, cat):
            np.add.at(out, at[known], slopes[known])
        return out

    def _places(self, num: np.ndarray, cat: np.ndarray):
        for c in cat.T:
            at = np.minimum(np.searchsorted(self.slots, c), max(len(self.slots) - 1, 0))
            yield at + num.shape[1], (self.slots[at] == c if len(self.slots) else np.zeros(len(c), bool))


class FourierMap(Fourier):
    """Dense kernel features; those of the last block are kept for the way back."""

    def dot(self, num, cat, weights):
        self.last = self.map(num, cat)
        return self.last @ weights

    def back(self, num, cat, slopes):
        return self.last.T @ slopes


def _signs(labels: np.ndarray, classes: int) -> np.ndarray:
    """+1 / -1 per row and machine; two classes share one machine, that of the second."""
    own = np.array([1]) if classes == 2 else np.arange(classes)
    return np.where(labels[:, None] == own, 1.0, -1.0)


def sigmoid_fit(margin: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[float, float]:
    """(a, b) of P = 1 / (1 + exp(a m + b)) by Newton steps on counts per margin, with Platt's softened targets."""
    n1, n0 = positive.sum(), negative.sum()
    hi, lo = (n1 + 1.0) / (n1 + 2.0), 1.0 / (n0 + 2.0)
    total, target = positive + negative, positive * hi + negative * lo
    a, b = 0.0, float(np.log((n0 + 1.0) / (n1 + 1.0)))

    def loss(a, b):
        z = a * margin + b
        return float((target * np.logaddexp(0, z) + (total - target) * np.logaddexp(0, -z)).sum())
    now = loss(a, b)
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(np.clip(a * margin + b, -500, 500)))
        r, w = target - total * p, total * p * (1 - p)
        g = np.array([(r * margin).sum(), r.sum()])
        h = np.array([[(w * margin ** 2).sum(), (w * margin).sum()], [(w * margin).sum(), w.sum()]]) + 1e-9 * np.eye(2)
        da, db = np.linalg.solve(h, -g)
        step = 1.0
        while step > 1e-8 and loss(a + step * da, b + step * db) > now:
            step /= 2
        fresh = loss(a + step * da, b + step * db)
        if step <= 1e-8 or now - fresh < 1e-10 * max(1.0, now):
            break
        a, b, now = a + step * da, b + step * db, fresh
    return a, b


class SvmModel:
    """Weights per machine, the feature map and the sigmoid of each machine."""

    def __init__(self, layout: Layout, features, weights: np.ndarray, sigmoids: np.ndarray, labels: list[str]):
        self.layout, self.features, self.weights, self.sigmoids, self.labels = layout, features, weights, sigmoids, labels

    def probabilities(self, num: np.ndarray, cat: np.ndarray) -> np.ndarray:
        margins = self.features.dot(num, cat, self.weights[:-1]) + self.weights[-1]
        p = 1.0 / (1.0 + np.exp(np.clip(margins * self.sigmoids[:, 0] + self.sigmoids[:, 1], -500, 500)))
        if p.shape[1] == 1:
            return np.hstack([1.0 - p, p])
        total = p.sum(1, keepdims=True)
        return np.where(total > 0, p / np.maximum(total, 1e-300), 1.0 / p.shape[1])

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability`` (an array, one share per label) and ``prediction``, the index of the largest."""
        model = df.sparkSession.sparkContext.broadcast(self)
        keep = df.columns

        def run(batches):
            own = model.value
            for batch in batches:
                parts = [own.probabilities(num, cat) for _, num, cat in blocks(batch, own.layout)]
                p = np.concatenate(parts) if parts else np.zeros((0, len(own.labels)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in range(len(keep))]
                    + [pa.array(list(p), pa.list_(pa.float64())), pa.array(p.argmax(1).astype(float) if len(p) else [], pa.float64())],
                    names=[*keep, "probability", "prediction"])
        schema = T.StructType([*df.schema.fields, T.StructField("probability", T.ArrayType(T.DoubleType())),
                               T.StructField("prediction", T.DoubleType())])
        return df.select("*", *self.layout.columns()).mapInArrow(run, schema)

    def save(self, path: str) -> str:
        """TRN-15: one row of parameters as Parquet, in a new directory."""
        from pyspark.sql import SparkSession
        f = self.features
        made = {"linear": True, "slots": f.slots.tolist(), "scale": f.scale.tolist()} if isinstance(f, OneHot) else \
            {"linear": False, "gamma": float(f.scale ** 2 / 2), "size": f.size, "seed": f.seed}
        text = json.dumps({"numeric": self.layout.numeric, "text": self.layout.text, "labels": self.labels, "features": made,
                           "weights": self.weights.tolist(), "sigmoids": self.sigmoids.tolist()})
        SparkSession.getActiveSession().createDataFrame([(text,)], "model string").write.mode("errorifexists").parquet(path)
        return path

    @staticmethod
    def load(spark, path: str) -> "SvmModel":
        parts = json.loads(spark.read.parquet(path).first()[0])
        layout, made = Layout(parts["numeric"], parts["text"]), parts["features"]
        features = OneHot(layout, np.array(made["slots"], np.int64), np.array(made["scale"])) if made["linear"] else \
            FourierMap(layout, made["gamma"], made["size"], made["seed"])
        return SvmModel(layout, features, np.array(parts["weights"]), np.array(parts["sigmoids"]), parts["labels"])


def fit_svm(train: DataFrame, feature_columns: list[str], rid: str, label: str, labels: list[str], kernel: str = "rbf",
            C: float = 1.0, gamma: float | str = "scale", n_components: int = 512, seed: int = 42) -> SvmModel:
    """Fit on the rows of ``train``; ``label`` holds the index into ``labels``, ``rid`` is a unique row key (it deals the folds)."""
    if kernel not in KERNELS:
        raise ValueError(f"kernel {kernel!r}: choose from {KERNELS}")
    layout, classes = Layout.of(train, feature_columns), len(labels)
    n, width, variance = layout.one_hot_moments(train)
    rows = reliable_checkpoint(train.select(F.col(label).cast("int").alias("__y"),
                                            F.pmod(F.xxhash64(F.col(rid), F.lit(seed)), F.lit(FOLDS)).cast("int").alias("__fold"),
                                            *layout.columns())).persist(StorageLevel.MEMORY_AND_DISK)
    if kernel == "rbf":
        if gamma == "scale":
            gamma = 1.0 / (width * variance) if variance > 0 else 1.0
        features = FourierMap(layout, float(gamma), n_components, seed)
        shrink = np.ones(features.width)
    else:
        moments = rows.agg(*[F.coalesce(F.stddev_pop(F.col("__num")[k]), F.lit(0.0)) for k in range(len(layout.numeric))],
                           F.count("*")).first()
        scale = np.array([1.0 / s if s > 0 else 1.0 for s in moments[:-1]])
        slots = rows.select(F.explode("__cat").alias("s")).distinct().collect()  # a linear model has a weight for each
        features = OneHot(layout, np.array([s for s, in slots], np.int64), scale)
        shrink = np.concatenate([scale ** 2, np.ones(len(slots))])
    machines, models = (1 if classes == 2 else classes), FOLDS + 1
    shape = (features.width + 1, models, machines)
    sizes = rows.groupBy("__fold").count().collect()
    seen = np.array([n - sum(c for f, c in sizes if f == m) for m in range(FOLDS)] + [n], float)
    penalty = 1.0 / (max(float(C), 1e-9) * np.maximum(seen, 1.0))
    spark = train.sparkSession

    def evaluate(flat: np.ndarray):
        w = flat.reshape(shape)
        sent = spark.sparkContext.broadcast((features, w))

        def partial(batches):
            own, w = sent.value
            wide = w.reshape(shape[0], -1)
            grad, loss = np.zeros(wide.shape), np.zeros(models)
            for batch in batches:
                names = batch.schema.names
                y, fold = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("__y", "__fold"))
                for at, num, cat in blocks(batch, layout):
                    signs = _signs(y[at:at + len(num)], classes)[:, None, :]
                    margin = (own.dot(num, cat, wide[:-1]) + wide[-1]).reshape(-1, models, machines)
                    gap = np.maximum(0.0, 1.0 - signs * margin)
                    gap *= (fold[at:at + len(num), None] != np.arange(models))[:, :, None]
                    loss += (gap ** 2).sum((0, 2))
                    slopes = (-2.0 * signs * gap).reshape(len(num), -1)
                    grad[:-1] += own.back(num, cat, slopes)
                    grad[-1] += slopes.sum(0)
            return np.concatenate([grad.ravel(), loss])
        sums = summed(rows, partial, flat.size + models)
        sent.destroy()
        per_model = 1.0 / np.maximum(seen, 1.0)
        loss = float((sums[flat.size:] * per_model).sum())
        grad = sums[:flat.size].reshape(shape) * per_model[None, :, None]
        cost = penalty[None, :, None] * shrink[:, None, None]
        loss += 0.5 * float((cost * w[:-1] ** 2).sum())
        grad[:-1] += cost * w[:-1]
        return loss, grad.ravel()

    w = lbfgs(evaluate, np.zeros(int(np.prod(shape)))).reshape(shape)
    sent = spark.sparkContext.broadcast((features, w))

    def count(batches):
        own, w = sent.value
        wide = w.reshape(shape[0], -1)
        out = np.zeros((machines, 2, BINS))
        for batch in batches:
            names = batch.schema.names
            y, fold = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("__y", "__fold"))
            for at, num, cat in blocks(batch, layout):
                margin = (own.dot(num, cat, wide[:-1]) + wide[-1]).reshape(-1, models, machines)
                unseen = margin[np.arange(len(num)), fold[at:at + len(num)]]
                signs = _signs(y[at:at + len(num)], classes)
                place = np.clip(np.rint(unseen * RESOLUTION), -RESOLUTION * LIMIT, RESOLUTION * LIMIT).astype(int) + RESOLUTION * LIMIT
                for k in range(machines):
                    np.add.at(out[k], ((signs[:, k] < 0).astype(int), place[:, k]), 1.0)
        return out.ravel()
    counts = summed(rows, count, machines * 2 * BINS).reshape(machines, 2, BINS)
    rows.unpersist()
    margin = (np.arange(BINS) - RESOLUTION * LIMIT) / RESOLUTION
    sigmoids = np.array([sigmoid_fit(margin, c[0], c[1]) for c in counts])
    return SvmModel(layout, features, np.ascontiguousarray(w[:, -1, :]), sigmoids, labels)
