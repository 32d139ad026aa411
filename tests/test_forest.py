"""The forest: no depth limit, both phases, text columns of any width, artifacts."""
import numpy as np
import pytest

from logweave.ml import forest
from logweave.ml import models as ml
from logweave.ml.forest import ForestModel, bag_weights, descend, fit_forest, grow


def leaves(nodes, num, cat):
    columns = list(zip(*nodes))
    at = descend([np.array(columns[k]) for k in (1, 2, 3, 4, 5)], num, cat)
    return np.array(columns[6])[at]


def depth_of(nodes):
    depth = {0: 0}
    for n, _, _, _, a, b, _ in nodes:
        if a >= 0:
            depth[a] = depth[b] = depth[n] + 1
    return max(depth.values())


def test_subtree_fits_the_rows_and_goes_deep():
    """A staircase that only a chain of cuts can follow: each cut splits off one step."""
    steps = 60
    num = np.repeat(2.0 ** np.arange(steps), 2)[:, None]
    y = np.repeat(np.arange(steps) % 2, 2)
    weight = 4.0 ** np.repeat(np.arange(steps), 2)      # the largest step outweighs all below it
    nodes = grow(num, np.zeros((len(y), 0), np.int64), y, weight, 2, 1, [1])
    assert depth_of(nodes) > 30
    assert (leaves(nodes, num, np.zeros((len(y), 0), np.int64)).argmax(1) == y).all()
    assert depth_of(grow(num, np.zeros((len(y), 0), np.int64), y, weight, 2, 1, [1], 5)) == 5


def test_weights_are_poisson():
    keys = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63, 200_000)
    w = bag_weights(keys, 3, 42)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and (bag_weights(keys, 3, 42) == w).all()
    assert abs(np.corrcoef(w, bag_weights(keys, 4, 42))[0, 1]) < 0.02


def data(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, 2))
    word = rng.choice(["a", "b", "c"], n)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (word == "c")).astype(int)
    rows = [(k, *map(float, p), None if w == "b" else str(w), str(c)) for k, (p, w, c) in enumerate(zip(x, word, y))]
    return spark.createDataFrame(rows, "rid long, x double, y double, word string, target string").repartition(4)


@pytest.mark.parametrize("local_rows", [100_000, 300])
def test_both_phases_learn(spark, local_rows):
    """Two columns that matter only together, and a text column; with a small limit the first phase makes the upper levels."""
    params = {"n_estimators": 20, "local_rows": local_rows}
    model, pred, metrics = ml.train_supervised(data(spark, 2500, 2), ["x", "y", "word"], "target", "random_forest", "rid", params)
    assert metrics.first()["accuracy"] > 0.93
    assert pred.count() == 750 and pred.where("prediction_proba < 0.5 OR prediction_proba > 1").count() == 0
    subtrees = model.nodes.select("tree", "sub").distinct().count()
    assert subtrees == 20 if local_rows == 100_000 else subtrees > 60
    assert model.nodes.groupBy("tree", "sub").agg({"node": "max"}).count() == subtrees


def test_artifact_and_partitioning(spark, tmp_path):
    """A saved forest scores alike, whatever the partitions and slices; no label leaks through row order."""
    df = data(spark, 600, 3)
    labelled = df.withColumn("label", df["target"].cast("int"))
    one = fit_forest(labelled, ["x", "y", "word"], "rid", "label", ["0", "1"], trees=8, local_rows=150)
    two = fit_forest(labelled.repartition(7), ["x", "y", "word"], "rid", "label", ["0", "1"], trees=8, local_rows=150)
    again = ForestModel.load(spark, ml.save_model(one, str(tmp_path)))
    again.slice_rows = 100
    got = [{r.rid: r.probability for r in m.transform(df, "rid").collect()} for m in (one, two, again)]
    assert len(got[0]) == 600
    for k, p in got[0].items():
        assert np.allclose(p, got[2][k])
    share = np.mean([np.argmax(got[0][k]) == np.argmax(got[1][k]) for k in got[0]])
    assert share > 0.97


def test_deep_trees_through_spark(spark):
    """A label that alternates from value to value: a tree without a limit fits every row of its bag, a limited one cannot."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(4)
    rows = [(k, float(v), str(int(v) % 2)) for k, v in enumerate(rng.permutation(3000))]
    df = spark.createDataFrame(rows, "rid long, v double, target string").withColumn("label", F.col("target").cast("int"))
    model = fit_forest(df, ["v"], "rid", "label", ["0", "1"], trees=1)
    limited = fit_forest(df, ["v"], "rid", "label", ["0", "1"], trees=1, max_depth=4)
    assert model.depth() > 11 and limited.depth() == 4
    keyed = df.withColumn("key", F.xxhash64("rid", F.lit(42)))
    right = []
    for m in (model, limited):
        found = m.transform(keyed, "rid").collect()
        seen = bag_weights(np.array([r.key for r in found]), 0, 42) > 0
        assert 0.6 < seen.mean() < 0.66
        right.append(np.mean([r.prediction == r.label for r, s in zip(found, seen) if s]))
    assert right[0] == 1.0 and right[1] < 0.9


def test_subtrees_are_copied_by_their_own_rows(spark):
    """Copies of a subtree follow the rows that end in it, so that all copies together grow with the rows."""
    from pyspark.sql import functions as F

    from logweave.ml.rows import Layout
    sdf = spark.range(400).selectExpr("id AS rid", "cast(id AS double) AS x", "cast(id % 3 = 0 AS int) AS y")
    tops = forest.Tops(2)
    tops.split(0, 0, 0, 0, 99.0)
    sdf = sdf.select("*", F.array("x").alias("__num"), F.array().cast("array<bigint>").alias("__cat"))
    model = forest.ForestModel(Layout(["x"], []), tops, sdf, ["0", "1"], slice_rows=100)
    found = {(r.tree, r.sub): r.slices for r in model._slices(sdf.select("rid", "__num", "__cat"), spark.sparkContext.broadcast(tops)).collect()}
    assert found == {(0, 1): 1, (0, 2): 3, (1, 0): 4}
