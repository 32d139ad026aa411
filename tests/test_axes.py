"""Main axes against a dense decomposition."""
import numpy as np

from logweave.ml.axes import main_axes


def dense(num, texts):
    """Variance per axis and total of the centred one-hot matrix."""
    columns = [np.asarray(num, float)]
    for t in texts:
        columns.append(np.array([[x == v for v in sorted(set(t))] for x in t], float))
    m = np.hstack(columns)
    m = m - m.mean(0)
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    return s ** 2 / len(m), (u * s)


def test_axes_equal_the_dense_ones(spark):
    rng = np.random.default_rng(1)
    n = 500
    num = rng.normal(size=(n, 12)) * np.linspace(0.2, 1.5, 12)
    kind = rng.choice(list("abcde"), n, p=[0.4, 0.3, 0.2, 0.05, 0.05])
    num[:, 11] += (kind == "a") * 2
    rows = [(k, *map(float, x), str(c), str(k % 2)) for k, (x, c) in enumerate(zip(num, kind))]
    names = "id long, " + ", ".join(f"x{j} double" for j in range(12)) + ", kind string, half string"
    df = spark.createDataFrame(rows, names).repartition(3)
    points, shares, total = main_axes(df, [f"x{j}" for j in range(12)] + ["kind", "half"], ["id"])
    want, where = dense(num, [list(kind), [str(k % 2) for k in range(n)]])
    assert np.allclose(shares, want[:2], rtol=1e-5) and abs(total - want.sum()) < 1e-9
    got = np.array([(r.p0, r.p1) for r in points.orderBy("id").collect()])
    assert np.allclose(got.var(0), want[:2], rtol=1e-5) and abs(np.corrcoef(got.T)[0, 1]) < 1e-4
    for j in range(2):
        assert abs(abs(np.corrcoef(got[:, j], where[:, j])[0, 1]) - 1) < 1e-4


def test_numeric_only_is_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3))
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(x)], "id long, a double, b double, c double")
    points, shares, total = main_axes(df, ["a", "b", "c"], ["id"])
    want, where = dense(x, [])
    got = np.array([(r.p0, r.p1) for r in points.orderBy("id").collect()])
    assert np.allclose(shares, want[:2], rtol=1e-9) and abs(total - want.sum()) < 1e-9
    assert np.allclose(abs(got), abs(where[:, :2]), atol=1e-7)
    assert main_axes(df.limit(0), ["a", "b"], ["id"])[0].count() == 0


def test_a_value_per_row(spark):
    """A text column with 100 000 values takes no column per value."""
    df = spark.range(100_000).selectExpr("id", "cast(id % 7 AS double) AS x", "concat('v', id) AS own", "cast(id % 2 AS string) AS half")
    points, shares, total = main_axes(df, ["x", "own", "half"], ["id"])
    assert points.count() == 100_000
    assert abs(shares[0] - 4.0) < 0.01 and abs(shares[1] - 0.5) < 0.01 and abs(total - (4.0 + 1.0 + 0.5)) < 0.01
