"""Kernel classifiers: shapes that no line separates, calibrated shares, more than two classes, artifacts."""
import numpy as np
import pytest

from logweave.ml import models as ml
from logweave.ml import rows as ml_rows
from logweave.ml.svm import SvmModel, sigmoid_fit


def frame(spark, x, y, extra=None):
    data = [(k, *map(float, p), str(c), *([extra[k]] if extra else [])) for k, (p, c) in enumerate(zip(x, y))]
    names = "rid long, " + ", ".join(f"x{k} double" for k in range(len(x[0]))) + ", target string" + (", word string" if extra else "")
    return spark.createDataFrame(data, names).repartition(5)


def test_xor_needs_the_kernel(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (1200, 2))
    df = frame(spark, x, (x[:, 0] * x[:, 1] > 0).astype(int))
    _, _, rbf = ml.train_supervised(df, ["x0", "x1"], "target", "svm", "rid", {"C": 10.0})
    _, _, linear = ml.train_supervised(df, ["x0", "x1"], "target", "svm", "rid", {"kernel": "linear"})
    assert rbf.first()["accuracy"] > 0.95 and linear.first()["accuracy"] < 0.7
    with pytest.raises(ValueError):
        ml.train_supervised(df, ["x0", "x1"], "target", "svm", "rid", {"kernel": "sigmoid"})


def test_shares_are_reliable(spark):
    """Labels drawn with known probability: the shares are close to them, bin by bin."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 2))
    p = 1 / (1 + np.exp(-(x[:, 0] ** 2 + x[:, 1] - 0.5) * 1.5))
    df = frame(spark, x, (rng.uniform(size=len(p)) < p).astype(int))
    _, pred, _ = ml.train_supervised(df, ["x0", "x1"], "target", "svm", "rid", {"test_size": 0.5})
    rows = pred.select("predicted_label", "actual_label", "prediction_proba").collect()
    share = np.array([r.prediction_proba for r in rows])
    right = np.array([r.predicted_label == r.actual_label for r in rows])
    bins = np.minimum(((share - 0.5) * 10).astype(int), 4)
    error = sum(abs(share[bins == b].mean() - right[bins == b].mean()) * (bins == b).mean() for b in range(5) if (bins == b).any())
    assert error < 0.05 and share.min() >= 0.5


@pytest.mark.parametrize("kernel", ["rbf", "linear"])
def test_three_classes(spark, kernel):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 600)
    x = np.array([[0, 0], [6, 0], [0, 6]])[y] + rng.normal(size=(600, 2))
    model, pred, metrics = ml.train_supervised(frame(spark, x, y), ["x0", "x1"], "target", "svm", "rid", {"kernel": kernel})
    assert metrics.first()["accuracy"] > 0.97
    rows = pred.collect()
    assert all(1 / 3 <= r.prediction_proba <= 1 for r in rows)
    assert np.mean([r.prediction_proba for r in rows]) > 0.9


def test_text_columns_of_any_width(spark, tmp_path):
    """A text column with a value of its own in most rows takes no column per value, and an artifact scores alike."""
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 900)
    x = rng.normal(size=(900, 1))
    words = [("good" if c else "bad") if k % 3 else f"only-{k}" for k, c in enumerate(y)]
    words[5] = None
    df = frame(spark, x, y, words)
    for kernel in ("rbf", "linear"):
        model, pred, metrics = ml.train_supervised(df, ["x0", "word"], "target", "svm", "rid", {"kernel": kernel})
        known = pred.where("word in ('good', 'bad')").select("predicted_label", "actual_label").collect()
        assert np.mean([r[0] == r[1] for r in known]) > 0.95
        again = SvmModel.load(spark, ml.save_model(model, str(tmp_path)))
        one, two = ({r.rid: r.probability for r in m.transform(df).collect()} for m in (model, again))
        assert all(np.allclose(one[k], two[k]) for k in one)


def test_moments_of_the_one_hot_matrix(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None), (float("nan"), "a")], "v double, w string")
    layout = ml_rows.Layout.of(df, ["v", "w"])
    m = np.array([[1, 1, 0, 0, 0], [0, 0, 1, 0, 0], [3, 0, 0, 1, 0], [0, 1, 0, 0, 0]], float)
    n, width, variance = layout.one_hot_moments(df)
    assert (n, width) == m.shape and abs(variance - m.var()) < 1e-12


def test_solver_and_sigmoid():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(30, 6))
    h = a.T @ a + np.eye(6)
    b = rng.normal(size=6)
    got = ml_rows.lbfgs(lambda x: (0.5 * x @ h @ x - b @ x, h @ x - b), np.zeros(6), tolerance=1e-14)
    assert np.allclose(got, np.linalg.solve(h, b), atol=1e-4)
    margin = np.linspace(-4, 4, 81)
    p = 1 / (1 + np.exp(-(1.7 * margin - 0.4)))
    assert np.allclose(sigmoid_fit(margin, 1e5 * p, 1e5 * (1 - p)), (-1.7, 0.4), atol=0.01)


def test_solver_passes_are_cheaper_and_as_exact():
    """Single-precision features stay within 1e-6 of the exact ones for large numbers too, in less than half the time."""
    import time

    import numpy as np

    from logweave.ml.rows import CACHED, CHUNK, Fourier, Layout
    rng = np.random.default_rng(4)
    num, cat = rng.normal(size=(20_000, 3)) * [1.0, 1e3, 1e6], rng.integers(0, 40, (20_000, 2))
    features = Fourier(Layout(["a", "b", "c"], ["d", "e"]), 0.5, 512)
    assert np.abs(features.quick(num[:999], cat[:999]) - features.map(num[:999], cat[:999])).max() < 1e-6

    def seconds(fn, step):
        start = time.process_time()
        for at in range(0, len(num), step):
            fn(num[at:at + step], cat[at:at + step])
        return time.process_time() - start
    assert min(seconds(features.quick, CACHED) for _ in range(3)) < seconds(features.map, CHUNK) / 2
