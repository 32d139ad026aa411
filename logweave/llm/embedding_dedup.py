"""Near-duplicate embeddings: randomised-rotation binary codes with stored correction factors.

A unit vector o is rotated by a random orthogonal matrix; its code is the signs of the rotated vector
o' and x = signs / sqrt(D) is the nearest corner of the cube.  With the stored factor f = <x, o'>,
<x, q'> / f is an unbiased estimate of <o, q> for a rotated unit vector q', and its error is at most
``SIGMAS`` * sqrt((1 - f^2) / f^2 / (D - 1)) up to a probability below 1e-5.  Pairs whose upper bound
stays under the threshold are dropped; all others are recomputed in double precision.

Candidates come from bands of sign bits of such rotations: a pair at the threshold agrees on one bit
with probability 1 - acos(t) / pi, and the number of bands makes the chance that it agrees on no band
less than ``MISS``; closer pairs are safer.  The bits per band grow with the logarithm of the largest label, so
buckets stay small as the data grow.  A bucket is compared in blocks and pairs of blocks; a pair
counts in its first common band only, and tasks return sums of links and spanning edges, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .components import connected_components
from .row_keys import decide_per_row
from .tables import stored
from .textops import mix64, sorted_groups

SIGMAS = 4.5
MISS = 1e-5
BUCKET, BLOCK = 64, 512


def rotations(dim: int, bits: int, seed: int = 20) -> np.ndarray:
    """Rows of random orthogonal matrices of size ``dim``, at least ``bits`` of them (a whole matrix
    first, whose signs are the code)."""
    rng = np.random.default_rng([seed, dim])
    parts = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-max(bits, dim) // dim))]
    return np.concatenate(parts)


def plan_bands(largest: int, threshold: float) -> tuple[int, int]:
    """(bits per band, bands) for a label of ``largest`` vectors."""
    bits = min(28, max(8, math.ceil(math.log2(max(largest, 1) / BUCKET + 1))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-agree))


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat doubles, offsets and whether a row is usable (not null, not empty, finite, not zero)."""
    n = len(column)
    usable = ~column.is_null().to_numpy(zero_copy_only=False)
    lengths = np.where(usable, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    full = np.flatnonzero(lengths > 0)
    usable &= lengths > 0
    if len(full):
        at = offsets[:-1][full]
        usable[full] &= np.logical_and.reduceat(np.isfinite(flat), at) & np.logical_or.reduceat(flat != 0, at)
    return flat, offsets, usable


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, offsets, usable = _vectors(batch.column(2))
        usable &= ~batch.column(1).is_null().to_numpy(zero_copy_only=False)
        usable &= ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
        raw = flat + 0.0
        vec = [raw[a:b].tobytes() if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], usable)]
        dim = np.where(usable, np.diff(offsets), 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dim, pa.int32()),
                                          pa.array(vec, pa.binary())], names=["id", "label", "dim", "vec"])


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codes(bits: int, bands: int):
    """Per node: packed sign bits of all bands and the correction factor of the first rotation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            code, factor = [b""] * len(dims), np.zeros(len(dims), np.float64)
            vec = batch.column(2).to_pylist()
            for dim in np.unique(dims).tolist():
                turn.setdefault(dim, rotations(dim, bits * bands))
                rows = np.flatnonzero(dims == dim)
                turned = _unit([vec[k] for k in rows], dim) @ turn[dim].T
                factor[rows] = np.abs(turned[:, :dim]).sum(1) / math.sqrt(dim)
                for k, cells in zip(rows.tolist(), np.packbits(turned >= 0, axis=1)):
                    code[k] = cells.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code, pa.binary()), pa.array(factor)],
                                             names=["node", "code", "factor"])
    return run


def _band_keys(code: np.ndarray, bits: int, bands: int) -> np.ndarray:
    cells = np.unpackbits(code, axis=1, count=bits * bands).reshape(len(code), bands, bits)
    return cells.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def _spread(bits: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            group, node = (batch.column(k).to_numpy() for k in (0, 1))
            code = batch.column(2).to_pylist()
            width = max(map(len, code))
            code = np.frombuffer(b"".join(c.ljust(width, b"\0") for c in code), np.uint8).reshape(n, width)
            keys = _band_keys(code, bits, bands)
            band = np.tile(np.arange(bands, dtype=np.int64), n)
            bucket = mix64(np.repeat(group, bands).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                           + (band.astype(np.uint64) << np.uint64(32)) + keys.reshape(-1).astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(group, bands)), pa.array(band), pa.array(keys.reshape(-1)),
                 pa.array(bucket.view(np.int64)), pa.array(np.repeat(node, bands))],
                names=["grp", "band", "key", "bucket", "node"])
    return run


def _compare(bits: int, bands: int, threshold: float):
    """Rows of one (group, band, key, i, j) at a time: links per node and spanning edges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: dict[int, np.ndarray] = {}
        for rows in sorted_groups(batches, 5):
            band, i, j = (rows.column(k)[0].as_py() for k in (1, 3, 4))
            side, node, many, dim = (rows.column(k).to_numpy() for k in (5, 6, 7, 8))
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            d = int(dim[0])
            turn.setdefault(d, rotations(d, bits * bands))
            unit = _unit(rows.column(9).to_pylist(), d)
            code = rows.column(10).to_pylist()
            code = np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1)
            factor = rows.column(11).to_numpy()
            signs = np.unpackbits(code[left], axis=1, count=d).astype(np.float32) * 2 - 1
            turned = (unit[right] @ turn[d][:d].T).astype(np.float32)
            estimate = signs @ turned.T / (math.sqrt(d) * factor[left, None])
            error = SIGMAS * np.sqrt(np.maximum(1 - factor[left] ** 2, 0) / max(d - 1, 1)) / factor[left]
            open_ = estimate >= threshold - error[:, None] - 1e-5
            if i == j:
                open_ &= node[right][None, :] > node[left][:, None]
            x, y = np.nonzero(open_)
            x, y = left[x], right[y]
            if band:
                keys = _band_keys(code, bits, bands)[:, :band]
                first = np.ones(len(x), bool)
                for at in range(0, len(x), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    first[part] = ~(keys[x[part]] == keys[y[part]]).any(1)
                x, y = x[first], y[first]
            near = np.zeros(len(x), bool)
            for at in range(0, len(x), 1 << 16):
                part = slice(at, at + (1 << 16))
                near[part] = np.einsum("ij,ij->i", unit[x[part]], unit[y[part]]) >= threshold
            x, y = x[near], y[near]
            if not len(x):
                continue
            links = np.bincount(x, many[y], len(side)) + np.bincount(y, many[x], len(side))
            got = np.flatnonzero(links > 0)
            root = np.arange(len(side))

            def find(k):
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k
            for p, q in zip(x.tolist(), y.tolist()):
                p, q = find(p), find(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
            top = np.array([node[find(k)] for k in got.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node[got]), pa.array(links[got].astype(np.int64)), pa.array(top)],
                                             names=["node", "links", "other"])
    return run


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                           label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``.

    Two vectors are linked when their labels are equal and not null, they have the same length and
    their cosine in double precision is at least ``threshold``.  Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing.  Equal vectors of a label are one node with a
    multiplicity, so a vector that occurs very often costs one row.  Ids are integers; rows with a repeated or
    null id are vectors of their own, and one row of a component is kept (see ``decide_per_row``).  Other columns are ignored.
    """
    ship_package(vectors.sparkSession)
    label = F.col(label_col).cast("string")
    values = F.transform(F.col(vector_col), lambda x: F.coalesce(x.cast("double"), F.lit(float("nan"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), values.alias("vec"))
    return decide_per_row(rows, lambda own: _components(own, threshold)).withColumnRenamed("id", id_col)


def _components(vectors: DataFrame, threshold: float) -> DataFrame:
    """(id, n_links, component_id, kept) of (id, label, vec) with unique ids."""
    rows = stored(vectors.select("id", "label", "vec")
                  .mapInArrow(_clean, "id long, label string, dim int, vec binary"))
    same = ["label", "dim", "vec"]
    counted = rows.filter("vec is not null").groupBy(*same).agg(F.min("id").alias("node"), F.count("*").alias("many"))
    nodes = stored(counted.withColumn("grp", F.xxhash64("label", "dim")))
    largest = nodes.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, bands = plan_bands(largest, threshold)
    coded = stored(nodes.select("node", "dim", "vec").mapInArrow(_codes(bits, bands),
                                                                 "node long, code binary, factor double")
                   .join(nodes, "node"))
    spread = coded.select("grp", "node", "code").mapInArrow(
        _spread(bits, bands), "grp long, band long, key long, bucket long, node long")
    place = F.explode(F.expr("""concat(
        transform(sequence(block, blocks - 1), j -> struct(block as i, j as j, 0 as side)),
        transform(sequence(0, block), i -> struct(i as i, block as j, 1 as side)))"""))
    full = spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1") \
        .select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    laid = (spread.join(full, "bucket").withColumn("block", F.expr("int(pmod(xxhash64(node, 7), blocks))"))
            .select("grp", "band", "key", place.alias("p"), "node")
            .join(coded.select("node", "many", "dim", "vec", "code", "factor"), "node")
            .select("grp", "band", "key", "p.i", "p.j", "p.side", "node", "many", "dim", "vec", "code", "factor"))
    order = ["grp", "band", "key", "i", "j"]
    found = stored(laid.repartition(*order).sortWithinPartitions(*order)
                   .mapInArrow(_compare(bits, bands, threshold), "node long, links long, other long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = connected_components(found, "node", "other")
    named = (nodes.join(links, "node", "left").join(component, "node", "left")
             .select(*same, (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "node").alias("c")))
    out = rows.join(named, same, "left")
    component_id = F.coalesce("c", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component_id.alias("component_id"), (component_id == F.col("id")).alias("kept"))
