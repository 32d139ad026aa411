"""Random forest without a depth limit, grown in two phases (TRN-3).

Every tree sees every training row with a Poisson(1) weight, a hash of row and tree.  Nodes that hold many rows are split level by level:
a pass counts class weights per node and candidate cut (quantile edges of numeric columns, slots of text columns) and
the best cut of each node is chosen where its counts meet.  A node whose rows fit one task gets them shuffled to it and the
rest of its subtree is grown there, with exact cuts between neighbouring values and as deep as the data need.

The nodes of the first phase are few (a node is split there only while it holds more than ``local_rows`` rows) and are
broadcast; the subtrees stay a table.  Scoring routes a row through the first, then meets the rest where the subtree lies.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .rows import Layout, blocks

#: Candidate cuts of a numeric column in the first phase.
EDGES = 63
_POISSON = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320]))
NODE = "tree int, sub long, node int, feature int, slot long, cut double, left int, right int, share array<double>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def bag_weights(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) weight of each row (64-bit key) in a tree."""
    start = np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + seed & (1 << 64) - 1)
    return np.searchsorted(_POISSON, _mix(keys.view(np.uint64) + start) / 2.0 ** 64, "right")


class Tops:
    """The first phase's trees: arrays per tree; a leaf is the root of subtree number ``node``."""

    def __init__(self, trees: int):
        # node: [feature, slot, cut, left, right]; feature -1 ends the first phase
        self.trees = [[[-1, 0, 0.0, -1, -1]] for _ in range(trees)]

    def split(self, tree: int, node: int, feature: int, slot: int, cut: float) -> tuple[int, int]:
        nodes = self.trees[tree]
        left = len(nodes)
        nodes[node] = [feature, slot, cut, left, left + 1]
        nodes += [[-1, 0, 0.0, -1, -1], [-1, 0, 0.0, -1, -1]]
        return left, left + 1

    def route(self, tree: int, num: np.ndarray, cat: np.ndarray) -> np.ndarray:
        return descend(self.arrays(tree), num, cat)

    def arrays(self, tree: int):
        columns = list(zip(*self.trees[tree]))
        return [np.array(c) for c in columns]


def descend(arrays, num: np.ndarray, cat: np.ndarray) -> np.ndarray:
    """The node that each row ends in; numbers go left up to the cut, slots of a text column left if they are the node's."""
    feature, slot, cut, left, right = arrays
    at = np.zeros(len(num), np.int64)
    rows = np.arange(len(num))
    while len(rows):
        f = feature[at[rows]]
        rows, f = rows[f >= 0], f[f >= 0]
        if not len(rows):
            break
        here = at[rows]
        numeric = f < num.shape[1]
        go = np.zeros(len(rows), bool)
        go[numeric] = num[rows[numeric], f[numeric]] <= cut[here[numeric]]
        text = ~numeric
        go[text] = cat[rows[text], f[text] - num.shape[1]] == slot[here[text]]
        at[rows] = np.where(go, left[here], right[here])
    return at


def _gini_gain(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Sum of squared class weights over weight, both sides; more is better.  Rows of ``left`` are candidates."""
    right = total - left
    a, b = left.sum(1), right.sum(1)
    return (left ** 2).sum(1) / np.maximum(a, 1e-300) + (right ** 2).sum(1) / np.maximum(b, 1e-300)


def grow(num: np.ndarray, cat: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, width: int, seed: list[int],
         depth_limit: int | None = None) -> list[list]:
    """One subtree as rows [node, feature, slot, cut, left, right, shares]; depth is limited on request only.

    A node tries sqrt(width) of the columns of the one-hot matrix that vary in it, drawn at random; cuts lie halfway between
    neighbouring values."""
    rng = np.random.default_rng(seed)
    tries = max(1, int(np.sqrt(width)))
    numeric = num.shape[1]
    spread = np.eye(classes)[y] * weight[:, None]
    # per column: its values in order, and the rank of each row's value
    ranked = [np.unique(column, return_inverse=True) for column in (*num.T, *cat.T)]
    nodes: list[list] = []
    todo = [(np.arange(len(y)), 0, None, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        node = len(nodes)
        if parent is not None:
            nodes[parent][side] = node
        weights = spread[rows]
        counts = np.add.reduce(weights, 0)
        nodes.append([node, -1, 0, 0.0, -1, -1, (counts / np.add.reduce(counts)).tolist()])
        if np.count_nonzero(counts) < 2 or depth_limit is not None and depth >= depth_limit:
            continue
        # a number is one column of the one-hot matrix, a text one for each of its values
        own = [ranks[rows] for _, ranks in ranked]
        choice: list[tuple[int, np.ndarray | None]] = []
        upto = [0]
        for f, ranks in enumerate(own):
            if f < numeric:
                if ranks.min() < ranks.max():
                    choice.append((f, None))
                    upto.append(upto[-1] + 1)
            else:
                present = _present(ranks, len(ranked[f][0]))
                if len(present) > 1:
                    choice.append((f, present))
                    upto.append(upto[-1] + len(present))
        if not choice:
            continue
        best = (-1.0, None)
        for k in rng.choice(upto[-1], min(tries, upto[-1]), replace=False).tolist():
            at = bisect_right(upto, k) - 1
            f, present = choice[at]
            if present is None:
                order = own[f].argsort(kind="stable")
                ranks = own[f][order]
                cuts = np.flatnonzero(ranks[1:] > ranks[:-1])
                gains = _gini_gain(np.cumsum(weights[order], 0)[cuts], counts)
                j = int(gains.argmax())
                if gains[j] > best[0]:
                    low, high = (ranked[f][0][ranks[at]] for at in (cuts[j], cuts[j] + 1))
                    middle = low + (high - low) / 2
                    best = (float(gains[j]), (f, 0, float(middle if low <= middle < high else low), own[f] <= ranks[cuts[j]]))
            else:
                slot = present[k - upto[at]]
                inside = own[f] == slot
                gain = float(_gini_gain(np.add.reduce(weights[inside], 0)[None], counts)[0])
                if gain > best[0]:
                    best = (gain, (f, int(ranked[f][0][slot]), 0.0, inside))
        f, slot, cut, go = best[1]
        nodes[node][1:4] = [f, slot, cut]
        todo += [(rows[~go], depth + 1, node, 5), (rows[go], depth + 1, node, 4)]
    return nodes


def _present(ranks: np.ndarray, size: int) -> np.ndarray:
    """The ranks (below ``size``) that occur, ascending."""
    if size <= 64 + 4 * len(ranks):
        return np.flatnonzero(np.bincount(ranks, minlength=size))
    return np.unique(ranks)


_ROW_TYPES = [("tree", pa.int32()), ("sub", pa.int64()), ("key", pa.int64()), ("y", pa.int32()), ("w", pa.int32()),
              ("__num", pa.list_(pa.float64())), ("__cat", pa.list_(pa.int64()))]


def _arrays_of(batch: pa.RecordBatch, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    parts = [(num, cat) for _, num, cat in blocks(batch, layout, max(batch.num_rows, 1))]
    return parts[0] if parts else (np.zeros((0, len(layout.numeric))), np.zeros((0, len(layout.text)), np.int64))


class ForestModel:
    """First-phase trees, the table of subtrees and the labels."""

    def __init__(self, layout: Layout, tops: Tops, nodes: DataFrame, labels: list[str], slice_rows: int = 1 << 16):
        self.layout, self.tops, self.nodes, self.labels, self.slice_rows = layout, tops, nodes, labels, slice_rows

    def depth(self) -> int:
        """Depth of the deepest subtree (a round of a join for each level is too dear: a task walks one subtree)."""
        def walk(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("node")
            depth = np.zeros(len(pdf), int)
            for n, a, b in zip(pdf["node"], pdf["left"], pdf["right"]):
                if a >= 0:
                    depth[a] = depth[b] = depth[n] + 1
            return pd.DataFrame({"depth": [int(depth.max())]})
        return self.nodes.groupBy("tree", "sub").applyInPandas(walk, "depth int").agg(F.max("depth")).first()[0]

    def _slices(self, rows: DataFrame, sent) -> DataFrame:
        """(tree, sub, slices): a subtree is copied once for every ``slice_rows`` rows of its own, not of all rows."""
        layout = self.layout

        def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows that a task sends to each subtree."""
            arrays = [sent.value.arrays(t) for t in range(len(sent.value.trees))]
            held = [np.zeros(len(nodes), np.int64) for nodes in sent.value.trees]
            for batch in batches:
                num, cat = _arrays_of(batch, layout)
                for own, total in zip(arrays, held):
                    total += np.bincount(descend(own, num, cat), minlength=len(total))
            for tree, total in enumerate(held):
                sub = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sub), tree), pa.int32()), pa.array(sub, pa.int64()),
                                                  pa.array(total[sub], pa.int64())], names=["tree", "sub", "n"])
        return rows.mapInArrow(sizes, "tree int, sub long, n long").groupBy("tree", "sub").agg(
            F.ceil(F.sum("n") / self.slice_rows).cast("int").alias("slices"))

    def transform(self, df: DataFrame, rid: str) -> DataFrame:
        """Adds ``probability`` (mean class shares over the trees) and ``prediction``; ``rid`` is a unique row key."""
        layout, classes, tops = self.layout, len(self.labels), self.tops
        sent = df.sparkSession.sparkContext.broadcast(tops)
        rows = df.select(F.col(rid).alias("rid"), *layout.columns())

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows to every tree's subtree; one output batch per tree."""
            for batch in batches:
                num, cat = _arrays_of(batch, layout)
                for tree in range(len(sent.value.trees)):
                    sub = sent.value.route(tree, num, cat)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(num), tree), pa.int32()), pa.array(sub, pa.int64())] + list(batch.columns),
                        names=["tree", "sub", *batch.schema.names])

        def vote(key, own, nodes):
            nodes = nodes.sort_values("node")
            num = np.array(own["__num"].tolist(), float).reshape(len(own), len(layout.numeric))
            cat = np.array(own["__cat"].tolist(), np.int64).reshape(len(own), len(layout.text))
            at = descend([nodes[c].to_numpy() for c in ("feature", "slot", "cut", "left", "right")], num, cat)
            share = np.array(nodes["share"].tolist(), float)[at]
            return pd.DataFrame({"rid": own["rid"].to_numpy(), **{f"p{k}": share[:, k] for k in range(classes)}})
        kind = df.schema[rid].dataType.simpleString()
        slices = reliable_checkpoint(self._slices(rows, sent))
        placed = rows.mapInArrow(place, f"tree int, sub long, rid {kind}, __num array<double>, __cat array<bigint>") \
            .join(F.broadcast(slices), ["tree", "sub"]).withColumn("slice", F.expr("int(pmod(xxhash64(rid), slices))")).drop("slices")
        copies = self.nodes.join(F.broadcast(slices), ["tree", "sub"]).withColumn(
            "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
        by = ["tree", "sub", "slice"]
        votes = placed.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(
            vote, f"rid {kind}, " + ", ".join(f"p{k} double" for k in range(classes)))
        total = votes.groupBy("rid").agg(*[F.avg(f"p{k}").alias(f"p{k}") for k in range(classes)])
        share = F.array(*[F.col(f"p{k}") for k in range(classes)])
        best = F.array_position(share, F.array_max(share)).cast("double") - 1
        return df.join(total.select(F.col("rid").alias("__key"), share.alias("probability"), best.alias("prediction")),
                       F.col(rid) == F.col("__key"), "left").drop("__key")

    def save(self, path: str) -> str:
        spark = self.nodes.sparkSession
        self.nodes.write.mode("errorifexists").parquet(f"{path}/nodes")
        tops = [(t, n, *row) for t, nodes in enumerate(self.tops.trees) for n, row in enumerate(nodes)]
        spark.createDataFrame(tops, "tree int, node int, feature int, slot long, cut double, left int, right int") \
            .write.mode("errorifexists").parquet(f"{path}/tops")
        spark.createDataFrame([(self.layout.numeric, self.layout.text, self.labels)],
                              "num array<string>, txt array<string>, labels array<string>").write.mode("errorifexists").parquet(f"{path}/meta")
        return path

    @staticmethod
    def load(spark, path: str) -> "ForestModel":
        meta = spark.read.parquet(f"{path}/meta").first()
        found = spark.read.parquet(f"{path}/tops").orderBy("tree", "node").collect()
        tops = Tops(found[-1]["tree"] + 1)
        for t in range(len(tops.trees)):
            tops.trees[t] = [list(r)[2:] for r in found if r["tree"] == t]
        return ForestModel(Layout(list(meta["num"]), list(meta["txt"])), tops, spark.read.parquet(f"{path}/nodes"), list(meta["labels"]))


def _totals(cells: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells (numbers below ``size``) that occur, ascending, and the weight in each."""
    if size <= 1024 + 8 * len(cells):
        total = np.bincount(cells, weight, size)
        found = np.flatnonzero(total)
        return found, total[found]
    found, back = np.unique(cells, return_inverse=True)
    return found, np.bincount(back, weight, len(found))


def _first_phase(rows: DataFrame, layout: Layout, trees: int, classes: int, width: int, local_rows: int, seed: int) -> Tops:
    """Split nodes of more than ``local_rows`` rows level by level."""
    spark = rows.sparkSession
    tops, edges = Tops(trees), []
    n = rows.count()
    open_nodes = {(t, 0): 0 for t in range(trees)} if n > local_rows else {}
    if open_nodes and layout.numeric:
        steps = [(k + 1) / (EDGES + 1) for k in range(EDGES)]
        quantiles = rows.agg(*[F.percentile_approx(F.col("__num")[k], steps, 10_000) for k in range(len(layout.numeric))]).first()
        edges = [np.unique(np.array(q or [0.0], float)) for q in quantiles]
    chance = max(1.0, np.sqrt(width)) / max(width, 1)
    while open_nodes:
        sent = spark.sparkContext.broadcast((tops, sorted(open_nodes), edges))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top, wanted, cuts = sent.value
            numbers = [np.full(len(nodes), -1) for nodes in top.trees]  # of the open nodes of a tree
            opened = [[node for tree, node in wanted if tree == t] for t in range(trees)]
            for number, nodes in zip(numbers, opened):
                number[nodes] = np.arange(len(nodes))
            arrays = [top.arrays(t) if nodes else None for t, nodes in enumerate(opened)]
            for batch in batches:
                num, cat = _arrays_of(batch, layout)
                key, y = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("key", "y"))
                out = []
                coded = [(np.arange(len(e) + 1), np.searchsorted(e, num[:, k], "left")) for k, e in enumerate(cuts)]
                coded += [np.unique(column, return_inverse=True) for column in cat.T]
                for t, nodes in enumerate(opened):
                    if not nodes:
                        continue
                    w = bag_weights(key, t, seed)
                    place = numbers[t][descend(arrays[t], num, cat)]
                    own = np.flatnonzero((w > 0) & (place >= 0))
                    for f, (values, code) in enumerate(coded):
                        cells, total = _totals((place[own] * len(values) + code[own]) * classes + y[own], w[own],
                                               len(nodes) * len(values) * classes)
                        node, value = np.divmod(cells // classes, len(values))
                        out.append((np.full(len(cells), t), np.array(nodes)[node], np.full(len(cells), f), values[value],
                                    cells % classes, total))
                columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 6
                types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, types)],
                                                 names=["tree", "node", "feature", "value", "y", "w"])

        def choose(key, pdf):
            """The best cut of one node on one column: (gain, slot or edge, weight)."""
            t, node, f = (int(k) for k in key)
            values, at = np.unique(pdf["value"].to_numpy(), return_inverse=True)
            w = np.zeros((len(values), classes))
            np.add.at(w, (at, pdf["y"].to_numpy()), pdf["w"].to_numpy())
            total = w.sum(0)
            numeric = f < len(layout.numeric)
            left = np.cumsum(w, 0)[:-1] if numeric else w
            rng = np.random.default_rng([seed, t, node, f])
            ok = np.full(len(left), rng.random() < chance) if numeric else rng.random(len(left)) < chance
            ok &= len(values) > 1
            gain = np.where(ok, _gini_gain(left, total), -1.0) if len(left) else np.array([-1.0])
            spare = float(_gini_gain(left, total).max()) if len(left) and len(values) > 1 else -1.0
            k = int(np.argmax(gain)) if gain.max() >= 0 else int(np.argmax(_gini_gain(left, total))) if spare >= 0 else 0
            rows_ = float(total.sum())
            pure = float((total > 0).sum() < 2)
            lefts = float(left[k].sum()) if len(left) else 0.0
            return pd.DataFrame([[t, node, f, float(gain.max()), spare, int(values[k]) if len(values) else 0, rows_, lefts, pure]],
                                columns=["tree", "node", "feature", "gain", "spare", "value", "rows", "lefts", "pure"])
        counted = rows.mapInArrow(count, "tree int, node long, feature int, value long, y int, w double") \
            .groupBy("tree", "node", "feature", "value", "y").agg(F.sum("w").alias("w"))
        best = counted.groupBy("tree", "node", "feature").applyInPandas(
            choose, "tree int, node long, feature int, gain double, spare double, value long, rows double, lefts double, pure double")
        ranked = best.groupBy("tree", "node").agg(F.max(F.struct("gain", "spare", "feature", "value", "rows", "lefts", "pure")).alias("b"))
        fresh = {}
        for t, node, b in ranked.collect():  # one row per open node, at most rows x trees / local_rows
            if b["pure"] or b["spare"] < 0:
                continue
            f, numeric = b["feature"], b["feature"] < len(layout.numeric)
            cut = float(edges[f][min(b["value"], len(edges[f]) - 1)]) if numeric else 0.0
            sides = tops.split(t, node, f, 0 if numeric else b["value"], cut)
            for child, size in zip(sides, (b["lefts"], b["rows"] - b["lefts"])):
                if size > local_rows:
                    fresh[t, child] = 0
        sent.destroy()
        open_nodes = fresh
    return tops


def fit_forest(train: DataFrame, feature_columns: list[str], rid: str, label: str, labels: list[str], trees: int = 200,
               max_depth: int | None = None, local_rows: int = 100_000, seed: int = 42) -> ForestModel:
    """Fit on the rows of ``train``; ``label`` holds the index into ``labels``, ``rid`` is a unique row key.

    ``max_depth`` limits the subtrees of the second phase only if it is given."""
    layout, classes = Layout.of(train, feature_columns), len(labels)
    _, width, _ = layout.one_hot_moments(train)
    rows = reliable_checkpoint(train.select(F.xxhash64(F.col(rid), F.lit(seed)).alias("key"), F.col(label).cast("int").alias("y"),
                                            *layout.columns()))
    tops = _first_phase(rows, layout, trees, classes, width, local_rows, seed)
    sent = train.sparkSession.sparkContext.broadcast(tops)

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            num, cat = _arrays_of(batch, layout)
            key = batch.column(0).to_numpy()
            for t in range(trees):
                w = bag_weights(key, t, seed)
                own = np.flatnonzero(w)
                part = batch.take(pa.array(own))
                sub = sent.value.route(t, num[own], cat[own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), t), pa.int32()), pa.array(sub, pa.int64()), part.column(0), part.column(1),
                     pa.array(w[own], pa.int32()), part.column(2), part.column(3)], schema=pa.schema(_ROW_TYPES))

    def rest(key, pdf):
        pdf = pdf.sort_values("key", kind="stable")
        num = np.array(pdf["__num"].tolist(), float).reshape(len(pdf), len(layout.numeric))
        cat = np.array(pdf["__cat"].tolist(), np.int64).reshape(len(pdf), len(layout.text))
        made = grow(num, cat, pdf["y"].to_numpy(), pdf["w"].to_numpy(float), classes, width, [seed, *map(int, key)], max_depth)
        out = pd.DataFrame(made, columns=["node", "feature", "slot", "cut", "left", "right", "share"])
        out.insert(0, "sub", int(key[1]))
        out.insert(0, "tree", int(key[0]))
        return out
    placed = rows.mapInArrow(bag, "tree int, sub long, key long, y int, w int, __num array<double>, __cat array<bigint>")
    nodes = reliable_checkpoint(placed.groupBy("tree", "sub").applyInPandas(rest, NODE))
    return ForestModel(layout, tops, nodes, labels)
