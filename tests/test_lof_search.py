"""Neighbour search of LOF: what it writes, both ways to search, and the kernel on odd numbers."""

import numpy as np
import pytest
from logweave.ml import lof


def brute(x, ids, k):
    """Distances and ids of the k nearest (itself left out; points that are not finite have and are none)."""
    d2 = np.zeros((len(x), len(x)))
    with np.errstate(all="ignore"):
        for j in range(x.shape[1]):
            d2 += (x[:, None, j] - x[None, :, j]) ** 2
        d = np.sqrt(d2)
    d[~(d < np.inf)] = np.inf
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
    return np.take_along_axis(d, order, 1), ids[order]


def frame(spark, x, ids, kind="double"):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], f"id long, v array<{kind}>")


def written(spark, work):
    """Bytes of shuffles and checkpoints that are there after ``work`` and were not before."""
    from pathlib import Path
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    points = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))

    def files():
        shuffled = {str(f.getPath()): f.length() for f in (disk.getAllFiles().apply(i) for i in range(disk.getAllFiles().size()))}
        return shuffled | {str(f): f.stat().st_size for f in points.rglob("part-*")}
    before = files()
    work()
    return sum(size for name, size in files().items() if name not in before)


def test_search_of_all_slices_writes_in_proportion(spark):
    """Where every point has to look at every block, no row is written for a point and a block."""
    x = np.random.default_rng(6).normal(size=(6000, 48))
    df = frame(spark, x, range(6000)).repartition(4)
    found = []
    out = written(spark, lambda: found.append(lof.knn(df, "id", "v", 5)) or found.append(found[0].count()))
    assert found[1] == 30_000
    assert out < 6 * x.nbytes, out / x.nbytes


@pytest.mark.parametrize("asked", [0, 1e9])
def test_both_searches_are_exact(spark, monkeypatch, asked):
    """All slices (asked 0) and blocks: the same lists, with copies, ties and a far point."""
    monkeypatch.setattr(lof, "ALL_POINTS", 0)
    monkeypatch.setattr(lof, "ASKED", asked)
    rng = np.random.default_rng(8)
    x = np.round(rng.integers(0, 4, size=(1800, 1)) * 20 + rng.normal(size=(1800, 3)), 1)
    x[300:360], x[700] = x[300], 1e9
    ids = rng.permutation(1800) * 5 - 400
    d, nbr = brute(x, ids, 6)
    got = {(r.rid, r["rank"]): (r.dist, r.nbr) for r in lof.knn(frame(spark, x, ids), "id", "v", 6, num_partitions=3).collect()}
    assert got == {(int(i), j + 1): (d[at, j], int(nbr[at, j])) for at, i in enumerate(ids) for j in range(6)}


def test_float_vectors_and_points_that_are_not_finite(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 7)).astype("f4").astype(float)
    x[3, 2], x[8, 0] = np.nan, np.inf
    d, nbr = brute(x, np.arange(400), 4)
    got = {(r.rid, r["rank"]): (r.dist, r.nbr) for r in lof.knn(frame(spark, x, range(400), "float"), "id", "v", 4).collect()}
    assert got == {(i, j + 1): (d[i, j], int(nbr[i, j])) for i in range(400) for j in range(4) if i not in (3, 8)}


@pytest.mark.parametrize("scale", [1e-200, 1e-20, 1.0, 1e20, 1e160])
@pytest.mark.parametrize("what", ["plain", "copies", "near copies", "far points"])
def test_kernel_keeps_the_exact_lists(scale, what):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(900, 33))
    if what == "copies":
        x[rng.random(900) < 0.4] = x[0]
    elif what == "near copies":
        x = x[0] + 1e-6 * x
    elif what == "far points":
        x[5], x[450], x[800] = 1e10, 1e30, 1e140
    x, ids = x * scale, rng.permutation(900) * 3
    d, nbr = brute(x, ids, 8)
    best = lof._Best(ids[:300], x[:300], 8)
    for at in (0, 600, 300):
        best.look(ids[at:at + 300], x[at:at + 300])
    assert (best.d == d[:300]).all()
    assert (best.nbr == nbr[:300])[d[:300] < np.inf].all()


def test_kernel_leaves_few_pairs_open(monkeypatch):
    rng, added, add = np.random.default_rng(11), [], lof._Best._add
    monkeypatch.setattr(lof._Best, "_add", lambda self, row, col, yid, y: added.append(len(row)) or add(self, row, col, yid, y))
    x = rng.normal(size=(4000, 64))
    x[7], x[2500] = 1e8, -1e12  # far points do not make the others open
    best = lof._Best(np.arange(500), x[:500], 10)
    for at in range(0, 4000, 500):
        best.look(np.arange(at, at + 500), x[at:at + 500])
    assert sum(added) < 0.05 * 500 * 4000


def test_labels_write_in_proportion(spark):
    """From the vectors to the labels, what is written follows the points, not points x blocks."""
    x = np.random.default_rng(12).normal(size=(6000, 48))
    df = frame(spark, x, range(6000)).repartition(4)
    out, labels = [], []

    def work():
        out.append(lof.local_outlier_factor(df, "id", "v", 5))
        labels.extend(r.predicted_label for r in out[0].collect())
    size = written(spark, work)
    assert labels.count("anomaly") == 600
    assert size < 8 * x.nbytes, size / x.nbytes


def test_labels_match_the_oracle_where_scores_are_equal_when_rounded(spark):
    """At sf0.1 the score after the quantile rounds to the same number: it is not above it."""
    import duckdb

    import __spark_entry__ as entry
    d = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{d}/embeddings.parquet')")
    want = {r[0]: r[2] for r in con.sql("SELECT vec_id, anomaly_score, predicted_label FROM (" + entry.oracle_sql()["lof_labels"] + ")").fetchall()}
    got = {r.vec_id: r.predicted_label for r in entry.queries()["lof_labels"](spark, d).collect()}
    assert got == want


@pytest.mark.parametrize("above", [0.1, 0.25, 0.0, 1.0])
def test_quantile_is_exact(spark, above):
    from pyspark.sql import functions as F
    for n, kinds in ((400_000, 1 << 40), (400_000, 7), (10, 1 << 40), (1, 5)):
        df = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(kinds)) / 8.0).alias("v"))
        want = np.sort(df.toPandas()["v"].to_numpy())[max(1, n - int(n * above)) - 1]
        assert lof._quantile(df, "v", above) == want
    assert lof._quantile(spark.createDataFrame([], "v double"), "v", 0.1) is None
