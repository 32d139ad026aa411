"""Model training and scoring (TRN-1..15).

* Supervised: Spark ML classifiers on a sparse feature vector; the split is
  stratified with exact counts per class, chosen by row-id hash.
* Isolation forest: each tree is grown by ``groupBy(tree).applyInPandas`` on a
  subsample of at most ``max_samples`` rows chosen by row-id hash (the pool is
  bounded by trees x 2 x psi, never by the data), the node table (bounded by
  trees x 2 x psi nodes) is broadcast, and every row is scored in Arrow
  batches with a vectorized traversal.
* Metrics are SQL aggregates over the prediction table.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip
from ..operators.selection import feature_vectors
from ..session import ensure_checkpoint_dir, reliable_checkpoint
from .rows import Layout, blocks

# Fixed value: label texts counted as "anomalous" ground truth.
POSITIVE_LABELS = ["1", "true", "yes", "anomaly", "attack", "malicious", "abnormal"]


def binary_labels(c) -> Any:
    """TRN-11."""
    return F.lower(py_strip(F.coalesce(c.cast("string"), F.lit("None")))).isin(*POSITIVE_LABELS).cast("long")


def stratified_split(df: DataFrame, rid: str, label: str, test_size: float = 0.3, seed: int = 42) -> DataFrame:
    """TRN-1: ``__is_test`` with exact counts per class.

    Of a class with n rows, round(test_size * n) are test rows, one at least and n - 1 at most (none of a
    single row): those with the smallest hashes.  The cut-off hash of each class is found by two
    counting passes (high, then low 16 bits), which combine map-side, so a class may hold most rows."""
    from ..operators.analysis import HASH_MOD, pseudo_random_order
    integral = isinstance(df.schema[rid].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    h = pseudo_random_order(F.col(rid) + F.lit(seed)) if integral else \
        F.pmod(F.xxhash64(F.col(rid), F.lit(seed)), F.lit(HASH_MOD))
    rows = df.withColumns({"__h": h.cast("long"), "__class": F.col(label).cast("string")})
    keyed = rows.select("__class", "__h", F.shiftright("__h", 16).alias("__high"))
    counts = keyed.groupBy("__class", "__high").agg(F.count("*").alias("n"))
    wanted = counts.groupBy("__class").agg(F.sum("n").alias("total")).select("__class", F.greatest(
        F.least(F.round(F.col("total") * float(test_size)).cast("long"), F.col("total") - 1),
        F.when(F.col("total") > 1, 1).otherwise(0)).alias("want")).where("want > 0")
    upto = Window.partitionBy("__class").orderBy("__high")
    cell = counts.join(wanted, "__class").withColumn("cum", F.sum("n").over(upto)) \
        .where((F.col("cum") >= F.col("want")) & (F.col("cum") - F.col("n") < F.col("want"))) \
        .select("__class", "__high", (F.col("want") - F.col("cum") + F.col("n")).alias("need"))
    fine = keyed.join(cell, ["__class", "__high"]).groupBy("__class", "__h", "need").agg(F.count("*").alias("n")) \
        .withColumn("cum", F.sum("n").over(Window.partitionBy("__class").orderBy("__h"))).where("cum >= need")
    last = fine.groupBy("__class").agg(F.min("__h").alias("__last"))
    return rows.join(last, "__class", "left").withColumn(
        "__is_test", F.coalesce(F.col("__h") <= F.col("__last"), F.lit(False))).drop("__h", "__class", "__last")


# ------------------------------------------------------------------ supervised

def _classifier(algorithm: str, params: dict[str, Any], n_train: int):
    """TRN-2 with the penalty of the usual C parametrisation: regParam = 1 / (C * rows)."""
    from pyspark.ml.classification import LogisticRegression
    algo = algorithm.lower()
    penalty = 1.0 / (max(float(params.get("C", 1.0)), 1e-9) * max(n_train, 1))
    if algo == "logistic_regression":
        return LogisticRegression(maxIter=int(params.get("max_iter", 500)), regParam=penalty, standardization=False,
                                  featuresCol="features", labelCol="label")
    raise ValueError(f"Unsupported supervised algorithm: {algorithm}")


def _without_summary(model):
    """The fitted model as its saved form gives it back, for scoring.

    A fitted model keeps its training summary, which holds the session; once any query of the session has observed
    metrics, the session cannot be sent to tasks, and neither can a scoring function of that model."""
    path = save_model(model, ensure_checkpoint_dir(SparkSessionRef.get()), "fitted")
    again = type(model).load(path)
    if (again.coefficientMatrix, again.interceptVector) != (model.coefficientMatrix, model.interceptVector):
        raise ValueError("The saved model differs from the fitted one")
    return again


def train_supervised(df: DataFrame, feature_columns: list[str], target: str, algorithm: str, rid: str,
                     params: dict[str, Any] | None = None, context_columns: list[str] | None = None):
    """TRN-1..6/13: returns (fitted model, prediction table of the test rows, metrics row DataFrame)."""
    from pyspark.ml.feature import IndexToString, StringIndexer
    from pyspark.ml.functions import vector_to_array

    params = params or {}
    base = df.where(F.col(target).isNotNull()).withColumn("__y", F.col(target).cast("string"))
    n_classes = base.groupBy("__y").count().count()
    if n_classes < 2:
        raise ValueError("Supervised training needs at least two target classes")
    originals = list(dict.fromkeys([c for c in (context_columns or []) if c in base.columns] + feature_columns))
    mat = stratified_split(base.select(*dict.fromkeys([rid, "__y", *originals])), rid, "__y",
                           float(params.get("test_size", 0.3)))
    indexer = StringIndexer(inputCol="__y", outputCol="label", stringOrderType="alphabetAsc").fit(mat)
    data = reliable_checkpoint(feature_vectors(indexer.transform(mat), feature_columns))
    train, test = data.where(~F.col("__is_test")), data.where(F.col("__is_test"))
    if algorithm.lower() == "svm":
        from .svm import fit_svm
        model = fit_svm(train, feature_columns, rid, "label", list(indexer.labels), str(params.get("kernel", "rbf")),
                        float(params.get("C", 1.0)), params.get("gamma", "scale"), int(params.get("n_components", 512)))
        scored = model.transform(test.drop("features"))
        proba = F.array_max("probability")
    elif algorithm.lower() == "random_forest":
        from .forest import fit_forest
        depth = params.get("max_depth")
        model = fit_forest(train, feature_columns, rid, "label", list(indexer.labels), int(params.get("n_estimators", 200)),
                           int(depth) if depth else None, int(params.get("local_rows", 100_000)))
        scored = model.transform(test.drop("features"), rid)
        proba = F.array_max("probability")
    else:
        model = _without_summary(_classifier(algorithm, params, train.count()).fit(train))
        scored = model.transform(test)
        proba = F.array_max(vector_to_array(F.col("probability")))
    pred = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=indexer.labels).transform(scored)
    ctx = [c for c in (context_columns or []) if c in pred.columns]
    out = pred.select(*ctx, *[c for c in feature_columns if c in pred.columns and c not in ctx],
                      F.col(rid).cast("string").alias("source_row_id"), F.col(rid).alias("__rid"),
                      F.col("__y").alias("actual_label"), F.col("predicted_label"), proba.alias("prediction_proba"))
    metrics = classification_metrics(out).crossJoin(F.broadcast(
        data.agg(F.count_if(~F.col("__is_test")).alias("train_rows"), F.count_if(F.col("__is_test")).alias("test_rows"))))
    return model, out, metrics


def classification_metrics(pred: DataFrame, actual: str = "actual_label", predicted: str = "predicted_label") -> DataFrame:
    """TRN-6: accuracy and macro precision / recall / F1 (0 on division by zero), rounded to 4.

    The confusion counts (one row per (actual, predicted) pair) are spread to
    per-class tp / fp / fn with an explode, then averaged over the classes
    present in either column (sklearn's macro average)."""
    conf = pred.groupBy(F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p")).count()
    hit = F.col("a").eqNullSafe(F.col("p"))
    contrib = F.array(
        F.struct(F.col("a").alias("c"), F.when(hit, F.col("count")).otherwise(0).alias("tp"),
                 F.lit(0).cast("long").alias("fp"), F.when(hit, 0).otherwise(F.col("count")).alias("fn")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("tp"),
                 F.when(hit, 0).otherwise(F.col("count")).alias("fp"), F.lit(0).cast("long").alias("fn")))
    per = conf.select(F.explode(contrib).alias("x")).select("x.*").groupBy("c").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    per = per.select("tp", prec.alias("pr"), rec.alias("rc"))
    f1 = F.when(F.col("pr") + F.col("rc") > 0, 2 * F.col("pr") * F.col("rc") / (F.col("pr") + F.col("rc"))).otherwise(0.0)
    total = conf.agg(F.sum("count").alias("n"))
    return per.agg(F.sum("tp").alias("tp"), F.avg("pr").alias("p"), F.avg("rc").alias("r"), F.avg(f1).alias("f")) \
        .crossJoin(F.broadcast(total)).select(
            F.round(F.col("tp") / F.col("n"), 4).alias("accuracy"), F.round("p", 4).alias("precision_macro"),
            F.round("r", 4).alias("recall_macro"), F.round("f", 4).alias("f1_macro"))


def anomaly_metrics(pred: DataFrame, score: str = "anomaly_score", predicted: str = "predicted_label",
                    actual: str | None = "actual_label") -> DataFrame:
    """TRN-10/12: row count, anomaly count / ratio, score min / max / mean, binary P / R / F1."""
    lab = (F.col(predicted).cast("string") == "anomaly").cast("long")
    aggs = [F.count(F.lit(1)).alias("rows"), F.sum(lab).alias("anomaly_count"),
            F.round(F.avg(lab), 4).alias("anomaly_ratio"), F.round(F.min(score), 4).alias("score_min"),
            F.round(F.max(score), 4).alias("score_max"), F.round(F.avg(score), 4).alias("score_mean")]
    if actual and actual in pred.columns:
        y = binary_labels(F.col(actual))
        aggs += [F.count_if((y == 1) & (lab == 1)).alias("tp"), F.count_if((y == 0) & (lab == 1)).alias("fp"), F.count_if((y == 1) & (lab == 0)).alias("fn")]
    out = pred.agg(*aggs)
    if actual and actual in pred.columns:
        p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
        r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
        f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
        out = out.select("rows", "anomaly_count", "anomaly_ratio", "score_min", "score_max", "score_mean",
                         F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"))
    return out


# ------------------------------------------------------------ isolation forest

def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(numeric: int, psi: int, seed: int):
    """One tree of a subsample; a node's candidates are the numeric columns and the slots (0/1 columns) that vary in it."""
    depth_limit = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf):
        tree = int(pdf["__tree"].iloc[0])
        pdf = pdf.sort_values(["__h", "__rid"]).head(psi)
        num = np.array(pdf["__num"].tolist(), float).reshape(len(pdf), -1)
        cat = np.array(pdf["__cat"].tolist(), np.int64).reshape(len(pdf), -1)
        rng = np.random.default_rng([seed, tree])
        rows = []  # node_id, feature, slot, threshold, left, right, size, depth

        def build(idx, depth):
            node = len(rows)
            rows.append([node, -1, 0, 0.0, -1, -1, len(idx), depth])
            if depth >= depth_limit or len(idx) <= 1:
                return node
            lo, hi = (f(num[idx], axis=0) for f in (np.min, np.max))
            varying = [(int(f), 0) for f in np.flatnonzero(hi > lo)]
            for c in range(cat.shape[1]):
                values = np.unique(cat[idx, c])
                varying += [(numeric + c, int(v)) for v in values] if len(values) > 1 else []
            if not varying:
                return node
            f, slot = varying[int(rng.integers(len(varying)))]
            x = num[idx, f] if f < numeric else (cat[idx, f - numeric] == slot).astype(float)
            thr = float(rng.uniform(x.min(), x.max()))
            rows[node][1:4] = [f, slot, thr]
            rows[node][4] = build(idx[x < thr], depth + 1)
            rows[node][5] = build(idx[x >= thr], depth + 1)
            return node

        build(np.arange(len(pdf)), 0)
        out = pd.DataFrame(rows, columns=["node", "feature", "slot", "threshold", "left", "right", "size", "depth"])
        out.insert(0, "tree", tree)
        return out
    return grow


class IsolationForestModel:
    """Fitted forest: the node table (bounded by trees x 2 x psi rows) plus the feature layout."""

    def __init__(self, nodes: pd.DataFrame, feature_columns: list[str], layout: Layout, psi: int):
        self.nodes = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
        self.feature_columns = feature_columns
        self.layout = layout
        self.psi = psi

    def _trees(self):
        return [{k: t[k].to_numpy() for k in ("feature", "slot", "threshold", "left", "right", "depth")}
                | {"path": t["depth"].to_numpy() + np.array([_c(float(n)) for n in t["size"]])}
                for _, t in self.nodes.groupby("tree")]

    def score(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and ``anomaly_score`` of rows that have the feature columns (Arrow batches, broadcast trees)."""
        layout, numeric, c_psi = self.layout, len(self.layout.numeric), _c(self.psi)
        sent = df.sparkSession.sparkContext.broadcast(self._trees())
        rows = df.select(*keep, *layout.columns())

        def score(batches):
            forest = sent.value
            for b in batches:
                n, parts = b.num_rows, []
                for _, num, cat in blocks(b, layout, 1 << 14):
                    total, every = np.zeros(len(num)), np.arange(len(num))
                    for t in forest:
                        node = np.zeros(len(num), dtype=np.int64)
                        for _ in range(int(t["depth"].max()) + 1):
                            f = t["feature"][node]
                            internal = f >= 0
                            if not internal.any():
                                break
                            x = np.zeros(len(num))
                            isnum = internal & (f < numeric)
                            x[isnum] = num[every[isnum], f[isnum]]
                            istext = internal & (f >= numeric)
                            x[istext] = cat[every[istext], f[istext] - numeric] == t["slot"][node[istext]]
                            node = np.where(internal, np.where(x < t["threshold"][node], t["left"][node], t["right"][node]), node)
                        total += t["path"][node]
                    parts.append(np.power(2.0, -(total / max(len(forest), 1)) / c_psi) if c_psi > 0 else np.full(len(num), 0.5))
                s = np.concatenate(parts) if parts else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(s, pa.float64())], names=[*keep, "anomaly_score"])

        schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("anomaly_score", T.DoubleType())])
        return rows.mapInArrow(score, schema)

    def save(self, path: str) -> str:
        """TRN-15: the node table as Parquet plus the layout, in a new directory."""
        spark = SparkSessionRef.get()
        spark.createDataFrame(self.nodes).write.mode("errorifexists").parquet(f"{path}/nodes")
        meta = [(self.feature_columns, self.layout.numeric, self.layout.text, self.psi)]
        shape = "feature_columns array<string>, numeric array<string>, txt array<string>, psi int"
        spark.createDataFrame(meta, shape).write.mode("errorifexists").parquet(f"{path}/meta")
        return path

    @staticmethod
    def load(spark, path: str) -> "IsolationForestModel":
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        meta = spark.read.parquet(f"{path}/meta").first()
        layout = Layout(list(meta["numeric"]), list(meta["txt"]))
        return IsolationForestModel(nodes, list(meta["feature_columns"]), layout, int(meta["psi"]))


class SparkSessionRef:
    @staticmethod
    def get():
        from pyspark.sql import SparkSession
        return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _below(hash64, share: float):
    """Whether a 64-bit hash lies in the lowest ``share`` of its range."""
    return hash64 <= F.lit(max(min(int((share - 0.5) * 2.0 ** 64), (1 << 63) - 1), -(1 << 63)))


def fit_isolation_forest(df: DataFrame, rid: str, feature_columns: list[str], n_trees: int = 100,
                         max_samples: int = 256, seed: int = 42) -> IsolationForestModel:
    """Grow the trees: subsamples by row-id hash from a pool bounded by trees x 2 x psi rows."""
    layout = Layout.of(df, feature_columns)
    n = df.count()
    psi = int(min(max_samples, n))
    pool_target = min(n, 2 * psi * n_trees)
    frac = pool_target / n if n else 1.0
    pool = df.where(_below(F.xxhash64(F.col(rid), F.lit(seed)), frac))
    keep_frac = min(1.0, 2.0 * psi / max(pool_target, 1))
    per_tree = pool.select(F.col(rid).alias("__rid"), *layout.columns()) \
        .withColumn("__tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))) \
        .withColumn("__h", F.xxhash64("__rid", "__tree", F.lit(seed))) \
        .where(_below(F.col("__h"), keep_frac))
    node_schema = "tree int, node long, feature long, slot long, threshold double, left long, right long, size long, depth long"
    nodes = per_tree.groupBy("__tree").applyInPandas(_grow(len(layout.numeric), psi, seed), node_schema)
    return IsolationForestModel(nodes.toPandas(), feature_columns, layout, psi)  # bounded: trees x 2 psi rows


def isolation_forest(df: DataFrame, feature_columns: list[str], rid: str, n_trees: int = 100,
                     max_samples: int = 256, contamination: float = 0.1, seed: int = 42,
                     keep: list[str] | None = None, return_model: bool = False):
    """TRN-7: anomaly_score = 2^(-E[h(x)]/c(psi)) (the negated sklearn score_samples);
    anomalies are scores above the (1 - contamination) quantile.  A text column is one slot per value, however many."""
    kept = list(dict.fromkeys([rid, *(keep or [])]))
    base = reliable_checkpoint(df.select(*dict.fromkeys([*kept, *feature_columns])))
    model = fit_isolation_forest(base, rid, feature_columns, n_trees, max_samples, seed)
    scored = reliable_checkpoint(model.score(base, kept))
    q = scored.agg(F.percentile_approx("anomaly_score", 1.0 - float(contamination), 100000).alias("q"))
    result = scored.crossJoin(F.broadcast(q)).withColumn(
        "predicted_label", F.when(F.col("anomaly_score") > F.col("q"), "anomaly").otherwise("normal")).drop("q")
    return (result, model) if return_model else result


def save_model(model, base: str, prefix: str = "model") -> str:
    """TRN-15: persist a fitted model to a fresh directory (older artifacts are never overwritten)."""
    from ..sources.readers import new_artifact_path
    path = new_artifact_path(base, prefix)
    if hasattr(model, "write"):
        model.write().save(path)
    else:
        model.save(path)
    return path
