"""Local outlier factor (TRN-9) on an exact distributed k-NN.

The points are dealt into slices of at most about ``SLICE`` points, packed and written once.  Then one of two searches:

* All slices.  A task holds one slice and the k nearest found so far for its points, and streams all slices past
  them, read from the one written copy: nothing else is written, and a task returns k neighbours for each of its
  points.  A product of single-precision matrices leaves open only the pairs that may be nearer than the k-th
  distance so far; those get their exact distance.  The work is quadratic, as for any exact search where distances
  concentrate (many dimensions, no clusters).
* Blocks, where a point has to look at few of them (``ASKED`` on average, counted on a few blocks before):
  1. Every point goes to the cell of its nearest pivot (``PIVOTS`` points, chosen by hash of the row id).  A cell
     is cut along the distance to its pivot into blocks of about ``BLOCK`` points, each with a range of such distances.
  2. Inside its block every point finds its k nearest; the k-th distance r bounds the true one.
  3. By the triangle inequality no point of a block can be nearer to x than the gap between d(x, pivot) and
     the block's range.  A point asks only the blocks whose gap is at most r.  The points that ask one block are cut
     into slices of about ``SLICE``, each with a copy of the block, and the answers are merged.

The merged lists give k-distance, reachability, local density and LOF as joins and averages.  Both searches are exact;
``examined_share`` tells the share of blocks that a point has to look at.
``score = LOF`` (the negated ``negative_outlier_factor``); anomalies are scores above the (1 - contamination)
quantile.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, reliable_checkpoint


PIVOTS, BLOCK = 64, 512
#: Points of a slice, and bytes of its vectors; tasks for each core where there are few points.
SLICE, SLICE_BYTES, TASKS = 4096, 1 << 22, 3
#: Up to so many points all slices are searched; beyond it too, where a point asks more blocks than ``ASKED`` on average
#: (counted on ``TRIED`` blocks), as every request carries its vector.
ALL_POINTS, ASKED, TRIED = 1 << 16, 16, 8
#: Rows and columns of distances at a time, and numbers in the exact differences made at a time.
ROWS, COLUMNS, NUMBERS = 512, 1024, 1 << 21
PACKED = "slice long, ids binary, xs binary"
NEAR = "array<struct<dist: double, nbr: bigint>>"


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _nearest(x: np.ndarray, xid: np.ndarray, y: np.ndarray, yid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the k nearest rows of y for each row of x (ties by id; itself left out).

    A matrix product gives squared distances up to a bounded rounding error; only the rows of y that may be among the k
    nearest by them get their exact distance."""
    k = min(k, len(y))
    if not len(x) or not k:
        return np.zeros((len(x), k)), np.zeros((len(x), k), np.int64)
    own = xid[:, None] == yid[None, :]
    center = y.mean(0)
    with np.errstate(all="ignore"):
        a, b = x - center, y - center
        xx, yy = (a * a).sum(1), (b * b).sum(1)
        # rounding of the products and sums, and of the shift by the center, at most per row of x
        wide = np.sqrt(xx) + np.sqrt(yy.max()) + np.abs(x).max(1) + np.abs(y).max()
        slack = 4.0 * (x.shape[1] + 4) * np.finfo(float).eps * wide * wide + np.finfo(float).tiny
        rough = a @ (-2.0 * b.T)
        rough += xx[:, None]
        rough += yy[None, :]
    if not (np.isfinite(rough).all() and np.isfinite(slack).all()):
        return _ranked(x, own, y, yid, np.ones(own.shape, bool), k)
    rough[own] = np.inf
    bound = np.partition(rough, k - 1, 1)[:, k - 1] + 2.0 * slack
    return _ranked(x, own, y, yid, (rough <= bound[:, None]) | own, k)


def _ranked(x: np.ndarray, own: np.ndarray, y: np.ndarray, yid: np.ndarray, near: np.ndarray, k: int):
    """The k nearest of the rows of y marked in ``near``, by exact distance and id; every row of x has k marked ones."""
    row, col = np.nonzero(near)
    d2 = np.zeros(len(row))
    for j in range(x.shape[1]):
        d2 += (x[row, j] - y[col, j]) ** 2
    d = np.sqrt(d2)
    d[own[row, col]] = np.inf
    order = np.lexsort((yid[col], d, row))
    start = np.searchsorted(row, np.arange(len(x)))
    pick = order[start[:, None] + np.arange(k)[None, :]]
    return d[pick], yid[col[pick]]


class _Best:
    """The k nearest found so far for the points of one slice, by distance and id; points that are not finite have none."""

    def __init__(self, xid: np.ndarray, x: np.ndarray, k: int):
        finite = np.isfinite(x).all(1)
        self.id, self.x, self.k = xid[finite], x[finite], k
        self.d = np.full((len(self.x), k), np.inf)
        self.nbr = np.full((len(self.x), k), np.iinfo(np.int64).max)
        self.center = np.median(self.x, 0) if len(self.x) else 0.0  # a few far points do not move it
        self.a, self.xx, self.far = self._moved(self.x)
        self.sides, self.room = {}, {}

    def _moved(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The points from the center, their squares, and which of them are too far for squares."""
        with np.errstate(all="ignore"):
            a = x - self.center
            xx = (a * a).sum(1)
        far = ~(xx < 1e300)
        a[far], xx[far] = 0.0, 0.0
        return a, xx, far

    def look(self, yid: np.ndarray, y: np.ndarray) -> None:
        finite = np.isfinite(y).all(1)
        y, yid = y[finite], yid[finite]
        if not len(self.x) or not len(y):
            return
        held, rows, cols = 0, [], []
        for row, col in self._open(y):
            # a k-th distance of 0 gives way to a lower id only
            use = (yid[col] != self.id[row]) & ((self.d[row, -1] > 0) | (yid[col] < self.nbr[row, -1]))
            rows.append(row[use])
            cols.append(col[use])
            held += len(rows[-1])
            if held * y.shape[1] >= NUMBERS:
                self._add(np.concatenate(rows), np.concatenate(cols), yid, y)
                held, rows, cols = 0, [], []
        if held:
            self._add(np.concatenate(rows), np.concatenate(cols), yid, y)

    def _open(self, y: np.ndarray):
        """(row, column) of all pairs that may be among the k nearest, piece by piece."""
        b, yy, far = self._moved(y)
        if far.any() or self.far.any():
            for i in range(0, len(self.x), ROWS):
                row, col = np.nonzero(self.far[i:i + ROWS, None] | far)
                yield row + i, col
            if far.all() or self.far.all():
                return
        near = np.flatnonzero(~far)
        b, yy, most = b[near], yy[near], np.sqrt(max(yy.max(), self.xx.max()))
        # single precision where it has the range, else double
        kinds = (np.float32, np.float64) if np.sqrt(yy.max()) > 1e-14 and most < 1e17 else (np.float64,)
        rights = {}
        for i in range(0, len(self.x), ROWS):
            kth = np.where(self.far[i:i + ROWS], np.nan, self.d[i:i + ROWS, -1])
            width = len(b) if np.isinf(kth).any() else COLUMNS
            for j in range(0, len(b), width):
                for kind in kinds:
                    if kind not in rights:
                        rights[kind] = _side(b, yy, kind, 1.0, False)
                        if kind not in self.sides:
                            self.sides[kind] = _side(self.a, self.xx, kind, -2.0, True)
                    at, cells = self._marked(self.sides[kind][i:i + ROWS], rights[kind][j:j + width], kth)
                    if len(at) * 32 < cells:
                        break  # few enough; else double precision tells more of them apart
                width_here = min(width, len(b) - j)
                yield at // width_here + i, near[at % width_here + j]

    def _marked(self, left: np.ndarray, right: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, int]:
        """Places (row by row) of the pairs whose squared distance is not surely above that of the k-th; number of all pairs."""
        kind, size = left.dtype, len(left) * len(right)
        if len(self.room.get(kind, ())) < size:
            self.room[kind], self.room["marks"] = np.empty(size, kind), np.zeros(size + 8, bool)
        low = np.matmul(left, right.T, out=self.room[kind][:size].reshape(len(left), len(right)))
        with np.errstate(all="ignore"):
            top = kth * kth * (1 + 1e-15) + (1e-34 if kind == np.float32 else 1e-290)
            if np.isinf(kth).any():  # one more than k, as a point may meet itself
                at = min(self.k, len(right) - 1)
                high = low + 2.0 * _slack(kind, left.shape[1] - 2) * (left[:, -1:] + right[:, -2])
                top = np.minimum(top, np.partition(high, at, 1)[:, at])
            top = np.nextafter(top.astype(kind), np.inf, dtype=kind)
        marks = self.room["marks"]
        marks[size:size + 8] = False
        np.less_equal(low, top[:, None], out=marks[:size].reshape(low.shape))
        word = np.flatnonzero(marks[:-(-size // 8) * 8].view(np.uint64))  # eight marks at a time
        at = (word[:, None] * 8 + np.arange(8)).ravel()
        return at[marks[at]], size

    def _add(self, row: np.ndarray, col: np.ndarray, yid: np.ndarray, y: np.ndarray) -> None:
        step = max(1, NUMBERS // max(1, y.shape[1]))
        for at in range(0, len(row), step):
            r, c = row[at:at + step], col[at:at + step]
            with np.errstate(all="ignore"):
                # summed from the first number to the last, as in ``_ranked``
                d = np.sqrt(np.add.reduce(np.ascontiguousarray(((self.x[r] - y[c]) ** 2).T), axis=0))
            n, kth = yid[c], self.d[r, -1]
            use = np.flatnonzero((d < kth) | ((d == kth) & (d < np.inf) & (n < self.nbr[r, -1])))
            use = use[np.argsort(r[use], kind="stable")]
            self._merge(r[use], d[use], n[use])

    def _merge(self, row: np.ndarray, d: np.ndarray, n: np.ndarray) -> None:
        """Merge candidates, sorted by row, into the lists."""
        rows, start, count = np.unique(row, return_index=True, return_counts=True)
        for at in range(0, len(rows), ROWS):
            mine, first, many = rows[at:at + ROWS], start[at:at + ROWS], count[at:at + ROWS]
            lo, hi = first[0], first[-1] + many[-1]
            line = np.repeat(np.arange(len(mine)), many)
            place = self.k + np.arange(lo, hi) - np.repeat(first, many)
            dist = np.full((len(mine), self.k + many.max()), np.inf)
            nbr = np.full(dist.shape, np.iinfo(np.int64).max)
            dist[:, :self.k], nbr[:, :self.k] = self.d[mine], self.nbr[mine]
            dist[line, place], nbr[line, place] = d[lo:hi], n[lo:hi]
            order = np.lexsort((nbr, dist), axis=1)[:, :self.k]
            self.d[mine], self.nbr[mine] = np.take_along_axis(dist, order, 1), np.take_along_axis(nbr, order, 1)


def _slack(kind, size: int) -> float:
    """Rounding of a squared distance from a product of ``kind``, as a share of the two squares: of the factors, the products
    and sums and the exact distance, at most; twice as much as that."""
    return 4.0 * (size + 8) * float(np.finfo(kind).eps)


def _side(a: np.ndarray, aa: np.ndarray, kind, factor: float, left: bool) -> np.ndarray:
    """Rows (a, square, 1) so that a product of two sides is the squared distance without its rounding: a lower bound."""
    square, one = ((1.0 - _slack(kind, a.shape[1])) * aa)[:, None], np.ones((len(a), 1))
    return np.hstack([factor * a, *((one, square) if left else (square, one))]).astype(kind)


def _pack(most: int, kind: str):
    """The points of a partition as rows (slice, ids, vectors) of ``most`` points, the last one with fewer."""
    def run(batches):
        task, made, held, ids, xs = TaskContext.get().partitionId(), 0, 0, [], []

        def row():
            nonlocal made
            made += 1
            packed = {"slice": [task << 32 | made], "ids": [np.concatenate(ids).tobytes()], "xs": [np.concatenate(xs).tobytes()]}
            return pa.RecordBatch.from_pydict(packed)
        for b in batches:
            at, x, xid = 0, _vectors(b.column(1)).astype(kind), b.column(0).to_numpy(zero_copy_only=False)
            while at < len(x):
                end = min(len(x), at + most - held)
                ids.append(xid[at:end].astype("<i8"))
                xs.append(x[at:end])
                held, at = held + end - at, end
                if held == most:
                    yield row()
                    held, ids, xs = 0, [], []
        if held:
            yield row()
    return run


def _slice(row: tuple, kind: str) -> tuple[np.ndarray, np.ndarray]:
    xid = np.frombuffer(row[1], "<i8")
    return xid, np.frombuffer(row[2], kind).reshape(len(xid), -1).astype(float)


def _each(make):
    """Batches of packed slices to batches of rows: ``make`` gives the columns for the rows of one slice."""
    def run(batches):
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                yield pa.RecordBatch.from_pydict(make(row))
    return run


def _lists_of(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _slices(points: DataFrame, rid: str, vec: str, num_partitions: int | None = None):
    """(slices, kind of their numbers, number of points): the points packed and written, about one slice a partition."""
    kind = "float" if points.select(F.col(vec)).dtypes[0][1] == "array<float>" else "double"
    base = points.select(F.col(rid).cast("long").alias("rid"), F.col(vec).cast(f"array<{kind}>").alias("x"))
    n, size = base.agg(F.count("*"), F.max(F.size("x"))).first()
    most = max(1, min(SLICE, SLICE_BYTES // (8 * max(1, size or 1))))
    cores = points.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-n // most), min(TASKS * cores, -(-n // BLOCK)), num_partitions or 1, 1)
    kind = "<f4" if kind == "float" else "<f8"
    packed = base.repartition(parts).mapInArrow(_pack(2 * most, kind), PACKED)
    # written as Python's own bytes, which tasks read again and again without a conversion
    ensure_checkpoint_dir(points.sparkSession)
    slices = packed.rdd.map(lambda r: (r["slice"], bytes(r["ids"]), bytes(r["xs"])))
    slices.checkpoint()
    points.sparkSession.sparkContext.runJob(slices, len, [])  # of no partition: only writes them
    return slices, kind, n


def _search(k: int, kind: str):
    """Pairs (slice, any slice), each slice with all of them: the ids of its points, their distances and neighbours."""
    def run(pairs):
        best = {}
        for mine, other in pairs:
            if mine[0] not in best:  # its own points first, they bound the k-th distance
                best[mine[0]] = _Best(*_slice(mine, kind), k)
                best[mine[0]].look(*_slice(mine, kind))
            if other[0] != mine[0]:
                best[mine[0]].look(*_slice(other, kind))
        for found in best.values():
            yield found.id.tobytes(), found.d.tobytes(), found.nbr.tobytes()
    return run


def _near(k: int):
    def make(row):
        xid, d, nbr = np.frombuffer(row[0], np.int64), np.frombuffer(row[1]).reshape(-1, k), np.frombuffer(row[2], np.int64)
        there = d < np.inf
        some = there.any(1)
        ends = pa.array(np.concatenate([[0], there.sum(1)[some].cumsum()]), pa.int32())
        near = pa.StructArray.from_arrays([pa.array(d[there]), pa.array(nbr[there.ravel()])], names=["dist", "nbr"])
        return {"rid": xid[some], "near": pa.ListArray.from_arrays(ends, near)}
    return _each(make)


def _first(kind: str, many: int):
    """The ``many`` points of a slice that come first by a hash of their ids."""
    def make(row):
        xid, x = _slice(row, kind)
        mixed = xid.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
        first = np.lexsort((xid, mixed))[:many]
        return {"mixed": mixed[first], "rid": xid[first], "x": _lists_of(x[first])}
    return _each(make)


def _place(pivots: np.ndarray, kind: str, vectors: bool):
    """The points of a slice with the cell of the nearest pivot and the distance to it."""
    def make(row):
        xid, x = _slice(row, kind)
        with np.errstate(all="ignore"):
            cell = ((pivots * pivots).sum(1) - 2.0 * (x @ pivots.T)).argmin(1)
            d = np.sqrt(((x - pivots[cell]) ** 2).sum(-1))
        return {"rid": xid, "cell": cell.astype(np.int32), "d": d} | ({"x": _lists_of(x)} if vectors else {})
    return _each(make)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - pivots[None, :, :]) ** 2).sum(-1))


def _radii(pivots: np.ndarray, k: int):
    """Rows of one block: the bound of the k-th distance, from nearest lists in pieces of it, and the distances to all pivots."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, xid = np.stack(pdf["x"].to_numpy()), pdf["rid"].to_numpy()
        r, to_pivot = np.full(len(x), np.inf), []
        for part in np.array_split(np.arange(len(x)), -(-len(x) // (2 * BLOCK))):
            d, _ = _nearest(x[part], xid[part], x[part], xid[part], k)
            if d.shape[1] >= k:
                r[part] = d[:, -1]
            to_pivot += list(_to_pivots(x[part], pivots))
        return pd.DataFrame({"rid": xid, "own": pdf["block"].to_numpy(), "r": r, "to_pivot": to_pivot})
    return run


def _answer(k: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"rid": [], "nbr": [], "dist": []}).astype({"rid": "int64", "nbr": "int64", "dist": "float64"})
        y, yid = np.stack(right["x"].to_numpy()), right["rid"].to_numpy()
        out = []
        for at in range(0, len(left), BLOCK):
            part = left.iloc[at:at + BLOCK]
            x, xid = np.stack(part["x"].to_numpy()), part["rid"].to_numpy()
            for some in np.array_split(np.arange(len(y)), -(-len(y) // (4 * BLOCK))):
                d, n = _nearest(x, xid, y[some], yid[some], k)
                out.append(pd.DataFrame({"rid": np.repeat(xid, d.shape[1]), "nbr": n.ravel(), "dist": d.ravel()}))
        return pd.concat(out).query("dist < inf")
    return run


def _blocks(spark: SparkSession, slices: RDD, kind: str, n: int):
    """(points in blocks, blocks with their cell and range, pivots)."""
    packed = spark.createDataFrame(slices, PACKED, verifySchema=False)
    # the pivots: one for every BLOCK points, PIVOTS at most
    many = min(PIVOTS, -(-n // BLOCK))
    first = packed.mapInArrow(_first(kind, many), "mixed long, rid long, x array<double>").orderBy("mixed", "rid").limit(many).collect()
    pivots = np.array([r["x"] for r in first], dtype=float)
    placed = packed.mapInArrow(_place(pivots, kind, False), "rid long, cell int, d double")
    parts = reliable_checkpoint(placed.groupBy("cell").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"),
        F.percentile_approx("d", F.lit([i / 256 for i in range(257)])).alias("q")))
    # rings of a cell: its distances cut at quantiles, and points of equal rank spread by hash beyond them
    ring = F.expr("int(least(parts - 1, floor(size(filter(q, v -> v <= d)) * parts / 258D)))")
    spread = F.expr("int(pmod(xxhash64(rid), greatest(1, int(ceil(parts / 256D)))))")
    block = F.col("cell").cast("long") * (1 << 40) + ring.cast("long") * (1 << 12) + spread

    def blocked(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(parts), "cell").withColumn("block", block).drop("parts", "q")
    blocks = blocked(placed).groupBy("block").agg(F.first("cell").alias("cell"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    full = packed.mapInArrow(_place(pivots, kind, True), "rid long, cell int, d double, x array<double>")
    return blocked(full), reliable_checkpoint(blocks), pivots


def _pairs(blocked: DataFrame, blocks: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """(rid, to): which blocks the points of ``blocked`` have to look at.  There is a block for about BLOCK points, so
    that their ranges go to every task, and the distances to the pivots are not dealt anew."""
    radii = blocked.select("rid", "x", "block").groupBy("block").applyInPandas(
        _radii(pivots, k), "rid long, own long, r double, to_pivot array<double>")
    asking = radii.select("rid", "own", "r", F.posexplode("to_pivot").alias("cell", "at"))
    gap = F.greatest(F.col("at") - F.col("hi"), F.col("lo") - F.col("at"), F.lit(0.0))
    return asking.join(F.broadcast(blocks), "cell").where(
        (gap <= F.col("r") * (1 + 1e-12) + 1e-12) | (F.col("block") == F.col("own"))).select("rid", F.col("block").alias("to"))


def _asked(blocked: DataFrame, blocks: DataFrame, pivots: np.ndarray, k: int) -> float:
    """Number of blocks that a point has to look at, on average over the points of a few blocks."""
    few = [r["block"] for r in blocks.orderBy(F.xxhash64("block")).limit(TRIED).collect()]
    some = reliable_checkpoint(blocked.where(F.col("block").isin(few)))
    return _pairs(some, blocks, pivots, k).count() / max(some.count(), 1)


def _request_rows(blocked: DataFrame, blocks: DataFrame, pivots: np.ndarray, k: int) -> tuple[DataFrame, DataFrame]:
    """(blocks in copies, requests): rows (rid, x, to, slice); each slice of a block's requests has its copy of the block."""
    blocked = reliable_checkpoint(blocked)
    pairs = reliable_checkpoint(_pairs(blocked, blocks, pivots, k))
    slices = pairs.groupBy("to").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    requests = pairs.join(slices, "to").withColumn("slice", F.expr("int(pmod(xxhash64(rid), slices))")) \
        .join(blocked.select("rid", "x"), "rid").select("rid", "x", "to", "slice")
    # both sides of the later cogroup come from ``blocked``: fresh columns keep them apart
    copies = blocked.join(slices, blocked["block"] == slices["to"]).select(
        F.col("rid").alias("rid"), F.col("x").alias("x"), F.col("block").alias("to"),
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    return copies, requests


def _requests(points: DataFrame, rid: str, vec: str, k: int, num_partitions: int | None = None):
    """(blocks in copies, requests, number of points, number of blocks): which blocks each point has to look at."""
    slices, kind, n = _slices(points, rid, vec, num_partitions)
    blocked, blocks, pivots = _blocks(points.sparkSession, slices, kind, n)
    return *_request_rows(blocked, blocks, pivots, k), n, blocks.count()


def _lists(points: DataFrame, rid: str, vec: str, k: int, num_partitions: int | None = None) -> DataFrame:
    """Exact k nearest neighbours (self excluded): rows (rid, near), near by distance and id."""
    spark = points.sparkSession
    slices, kind, n = _slices(points, rid, vec, num_partitions)
    kk = int(min(k, max(n - 1, 0)))
    if kk == 0:
        return spark.createDataFrame([], f"rid long, near {NEAR}")
    if n > ALL_POINTS:
        blocked, blocks, pivots = _blocks(points.sparkSession, slices, kind, n)
        if _asked(blocked, blocks, pivots, kk) <= ASKED:
            copies, requests = _request_rows(blocked, blocks, pivots, kk)
            found = requests.groupBy("to", "slice").cogroup(copies.groupBy("to", "slice")).applyInPandas(
                _answer(kk), "rid long, nbr long, dist double")
            near = F.slice(F.array_sort(F.collect_list(F.struct("dist", "nbr"))), 1, kk)
            return found.groupBy("rid").agg(near.alias("near"))
    # one partition on the right, read in turn: a task streams it and keeps only its lists
    found = slices.cartesian(slices.coalesce(1)).mapPartitions(_search(kk, kind))
    found = spark.createDataFrame(found, "ids binary, d binary, nbr binary", verifySchema=False)
    return found.mapInArrow(_near(kk), f"rid long, near {NEAR}")


def knn(points: DataFrame, rid: str, vec: str, k: int, num_partitions: int | None = None) -> DataFrame:
    """Exact k nearest neighbours (self excluded): rows (rid, nbr, dist, rank); ties by id."""
    return _lists(points, rid, vec, k, num_partitions).select("rid", F.posexplode("near").alias("at", "to")).select(
        "rid", "to.nbr", "to.dist", (F.col("at") + 1).alias("rank"))


def examined_share(points: DataFrame, rid: str, vec: str, k: int) -> float:
    """Share of the (point, block) combinations that a search by blocks has to examine."""
    slices, kind, n = _slices(points, rid, vec)
    blocked, blocks, pivots = _blocks(points.sparkSession, slices, kind, n)
    return _pairs(blocked, blocks, pivots, k).count() / max(n * blocks.count(), 1)


def _quantile(scores: DataFrame, name: str, above: float) -> float | None:
    """The least value that at most the share ``above`` of the rows exceed (SQL's discrete quantile), exact for any number of
    rows: two approximate ones bound it, and only the values between them are counted one by one."""
    margin, at = 2e-5, F.col(name)
    while True:
        ends = [max(0.0, 1.0 - above - margin), min(1.0, 1.0 - above + margin)]
        n, bounds = scores.agg(F.count(name), F.percentile_approx(name, F.lit(ends), 100000)).first()
        if not n:
            return None
        rank, seen = max(1, n - int(Decimal(str(above)) * n)), 0
        counts = scores.where(at <= bounds[1]).groupBy(F.when(at >= bounds[0], at).alias("v")).count()
        for r in counts.orderBy(F.col("v").asc_nulls_first()).collect():
            seen += r["count"]
            if seen >= rank and r["v"] is not None:
                return r["v"]
            if seen >= rank:
                break  # it is below the bounds
        margin *= 50


def local_outlier_factor(df: DataFrame, rid: str, vec: str, n_neighbors: int = 20, contamination: float = 0.1,
                         num_partitions: int | None = None, digits: int | None = None) -> DataFrame:
    """(rid, anomaly_score = LOF, predicted_label).  With ``digits`` scores are rounded before they are compared."""
    lists = reliable_checkpoint(_lists(df, rid, vec, n_neighbors, num_partitions))
    nn = lists.select("rid", F.inline("near"))
    kdist = lists.select(F.col("rid").alias("nbr"), F.element_at("near", -1)["dist"].alias("nbr_kdist"))
    reach = nn.join(kdist, "nbr").select("rid", "nbr", F.greatest("dist", "nbr_kdist").alias("reach"))
    lrd = reach.groupBy("rid").agg((1.0 / (F.avg("reach") + 1e-10)).alias("lrd"))
    score = F.col("avg_nbr_lrd") / F.col("lrd")
    if digits is not None:
        score = F.round(score * 10.0 ** digits, 0) / 10.0 ** digits
    lof = reliable_checkpoint(
        nn.join(lrd.select(F.col("rid").alias("nbr"), F.col("lrd").alias("nbr_lrd")), "nbr")
        .groupBy("rid").agg(F.avg("nbr_lrd").alias("avg_nbr_lrd"))
        .join(lrd, "rid").select("rid", score.alias("anomaly_score")))
    q = _quantile(lof, "anomaly_score", float(contamination))
    return lof.select(F.col("rid").alias(rid), "anomaly_score",
                      F.when(F.col("anomaly_score") > F.lit(q), "anomaly").otherwise("normal").alias("predicted_label"))
