"""Near-duplicate documents: b-bit MinHash signatures and a multi-index Hamming join.

A signature is 48 positions of 16 bits (the low bits of 48 MinHash values of the shingle set).  It
is split into 12 chunks of 4 positions.  By the pigeonhole principle two signatures that differ in at
most 23 = 12 * (1 + 1) - 1 positions agree in some chunk up to one position, so enumerating, per chunk,
the four keys that leave one position out finds every pair under that distance.  A pair with
similarity 0.8 differs in 9.6 positions on average (standard deviation 2.8): more than 23 has a
probability below 1e-5, and even such a pair is found unless all twelve chunks miss.

Links are confirmed on the full shingle sets.  Documents with equal sets are one node.  Within a key,
nodes are linked to the smallest one, the pivot, first (a star, not all pairs).  Partners of one pivot that still
lie in several components are then compared in blocks; pairs are tested where they lie and only links
leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .components import connected_components
from .row_keys import decide_per_row, ids_are_keys, keyed
from .tables import stored
from .textops import flat_texts, lower_ascii, mix64, segment_hashes, slices, sorted_groups, words

CHUNKS, WIDTH = 12, 4
POSITIONS = CHUNKS * WIDTH
#: Largest number of differing positions that the index guarantees to find.
DISTANCE = 2 * CHUNKS - 1
_MULTIPLIERS = mix64(np.arange(1001, 1001 + POSITIONS, dtype=np.uint64)) | np.uint64(1)
#: Partners of a pivot in one block, and partners per pivot checked in one go.
BLOCK, CHECK_BLOCK = 256, 64
SALTS = 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document, flat, with offsets."""
    data = lower_ascii(data)
    starts, ends, first = words(data, offsets)
    h = segment_hashes(data, starts, ends)
    counts = np.diff(first)
    n_shingles = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    doc = np.repeat(np.arange(len(counts)), n_shingles)
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(n_shingles, out=out[1:])
    at = np.repeat(first[:-1] - out[:-1], n_shingles) + np.arange(out[-1])
    last = np.repeat(first[1:], n_shingles)
    value = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = at + k < last
        term = h[np.minimum(at + k, max(len(h) - 1, 0))] + np.uint64(k + 1)
        value = mix64(value * np.uint64(0x9FB21C651E98DF25) + np.where(inside, term, np.uint64(0)))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(counts) + 1))


def signatures(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """16-bit MinHash signature per non-empty set (rows of POSITIONS)."""
    filled = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(filled), POSITIONS), np.uint16)
    if not len(filled):
        return out
    at = offsets[:-1][filled]
    work = np.empty_like(value)
    for k in range(POSITIONS):
        np.multiply(value, _MULTIPLIERS[k], out=work)
        out[:, k] = (mix64(np.minimum.reduceat(work, at)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            value, offsets = shingle_sets(*flat_texts(batch.column(1)), size)
            counts = np.diff(offsets)
            keep = counts > 0
            at = offsets[:-1][keep]
            total = np.add.reduceat(value, at) if len(at) else np.zeros(0, np.uint64)
            cross = np.add.reduceat(mix64(value), at) if len(at) else np.zeros(0, np.uint64)
            high, low = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
            high[keep], low[keep] = total.view(np.int64), cross.view(np.int64)
            sig = signatures(value, offsets)
            cells = iter(sig)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts.astype(np.int64)), pa.array(high), pa.array(low),
                 pa.array([next(cells).tobytes() if k else b"" for k in keep], pa.binary())],
                names=["id", "n_shingles", "set_a", "set_b", "sig"])
    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, POSITIONS)
            sig = sig.astype(np.int64)
            node = part.column(0).to_numpy(zero_copy_only=False)
            keys = []
            for c in range(CHUNKS):
                own = sig[:, c * WIDTH:(c + 1) * WIDTH]
                for out in range(WIDTH):
                    a, b, d = (own[:, k] for k in range(WIDTH) if k != out)
                    keys.append(((c * WIDTH + out) << 48) | (a << 32) | (b << 16) | d)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(node, len(keys)))],
                                             names=["key", "node"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep pairs whose signatures differ in at most DISTANCE positions."""
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            a, b = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint16).reshape(-1, POSITIONS)
                    for k in (2, 3))
            near = pa.array((a != b).sum(1) <= DISTANCE)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(near), part.column(1).filter(near)],
                                             names=["a", "b"])


def _check(size: int, percent: int):
    """Rows sorted by (pivot, block, role): the pivot's text, then the texts to compare with it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, np.zeros(0, np.uint64)
        for batch in slices(batches, "text"):
            value, offsets = shingle_sets(*flat_texts(batch.column(4)), size)
            pivots, blocks, roles, nodes = (batch.column(k).to_pylist() for k in range(4))
            a, b = [], []
            for k in range(batch.num_rows):
                other = value[offsets[k]:offsets[k + 1]]
                if roles[k] == 0:
                    group, own = (pivots[k], blocks[k]), other
                elif (pivots[k], blocks[k]) == group:
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * common >= percent * (len(own) + len(other) - common):
                        a.append(pivots[k])
                        b.append(nodes[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _salt(column: str):
    return F.expr(f"int(pmod(xxhash64({column}, 3), {SALTS}))")


def _salted(per_pivot: DataFrame) -> DataFrame:
    """One row per pivot and salt, so that a pivot with very many partners is joined in many tasks."""
    return per_pivot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the similarity.

    Each text goes once to every block of pairs it takes part in; a task holds one pivot's set and one
    slice of partners, however many partners a pivot has.
    """
    many = _salted(pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > CHECK_BLOCK)
                   .select("a", F.ceil(F.col("n") / CHECK_BLOCK).cast("int").alias("blocks")))
    placed = (pairs.withColumn("salt", _salt("b")).join(many, ["a", "salt"], "left")
              .select("a", F.expr("int(pmod(xxhash64(b), coalesce(blocks, 1)))").alias("block"), "b"))
    wanted = (placed.select("a", "block", F.lit(0).alias("role"), F.col("a").alias("node")).distinct()
              .unionByName(placed.select("a", "block", F.lit(1).alias("role"), F.col("b").alias("node"))))
    loaded = wanted.join(texts.select(F.col("id").alias("node"), "text"), "node") \
        .select("a", "block", "role", "node", "text")
    return (loaded.repartition("a", "block").sortWithinPartitions("a", "block", "role")
            .mapInArrow(_check(size, percent), "a long, b long"))


def _compare_block(size: int, percent: int):
    """Rows sorted by (pivot, i, j): links between members of different components in a pair of blocks.

    A pair is tested on the full sets only while its two sides are still in different components, their
    signatures are under the distance and their sizes allow the similarity.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, 3):
            value, offsets = shingle_sets(*flat_texts(rows.column(7)), size)
            side = rows.column(3).to_numpy(zero_copy_only=False)
            node = rows.column(4).to_numpy(zero_copy_only=False)
            comp = rows.column(5).to_numpy(zero_copy_only=False).copy()
            sig = np.frombuffer(b"".join(rows.column(6).to_pylist()), np.uint16).reshape(-1, POSITIONS)
            n = np.diff(offsets)
            right = np.flatnonzero(side == 1)
            once = rows.column(1)[0] == rows.column(2)[0]
            a, b = [], []
            for x in np.flatnonzero(side == 0).tolist():
                fits = percent * np.maximum(n[right], n[x]) <= 100 * np.minimum(n[right], n[x])
                if once:
                    fits &= node[right] > node[x]
                near = right[fits & (comp[right] != comp[x])]
                near = near[(sig[near] != sig[x]).sum(1) <= DISTANCE]
                own = value[offsets[x]:offsets[x + 1]]
                for y in near.tolist():
                    if comp[y] == comp[x]:
                        continue
                    common = len(np.intersect1d(own, value[offsets[y]:offsets[y + 1]], assume_unique=True))
                    if 100 * common >= percent * (n[x] + n[y] - common):
                        a.append(node[x])
                        b.append(node[y])
                        comp[comp == comp[y]] = comp[x]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _missed_links(star: DataFrame, label: DataFrame, nodes: DataFrame, texts: DataFrame, size: int,
                  percent: int) -> DataFrame:
    """Links that the stars left out.

    Two nodes that share a key also share its pivot, so every such pair lies among the partners of one
    pivot.  Only pivots whose partners are in several components are opened; their partners are laid out
    in blocks and pairs of blocks, and a task holds one pair of blocks.
    """
    named = stored(star.join(label, F.col("b") == F.col("node"), "left")
                   .select("a", "b", F.coalesce("component", "b").alias("comp")))
    opened = named.groupBy("a").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")) \
        .filter("lo <> hi").select("a", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    opened = _salted(opened)
    place = F.explode(F.expr("""concat(
        transform(sequence(block, blocks - 1), j -> struct(block as i, j as j, 0 as side)),
        transform(sequence(0, block), i -> struct(i as i, block as j, 1 as side)))"""))
    rows = (named.withColumn("salt", _salt("b")).join(opened, ["a", "salt"]).withColumn("block", F.expr("int(pmod(xxhash64(b), blocks))"))
            .join(nodes.select(F.col("node").alias("b"), "sig"), "b")
            .join(texts.select(F.col("id").alias("b"), "text"), "b")
            .select("a", place.alias("p"), "b", "comp", "sig", "text")
            .select("a", "p.i", "p.j", "p.side", "b", "comp", "sig", "text"))
    return (rows.repartition("a", "i", "j").sortWithinPartitions("a", "i", "j")
            .mapInArrow(_compare_block(size, percent), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4,
                    percent: int = 80) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``, ``kept``.

    Shingles are runs of ``shingle_words`` words of the text with A-Z in lower case; a shorter text is
    one shingle; a null text or one without words has none and links with nothing.  Two documents
    are linked when 100 * intersection >= percent * union of their shingle sets.  ``component_id`` is
    the smallest id reachable by links.  Ids are integers; rows with a repeated or null id are documents of their own,
    and one row of a component is kept (see ``decide_per_row``).  Other columns of ``docs`` are ignored, so their
    names cannot clash.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return decide_per_row(texts, lambda rows: _components(rows, shingle_words, percent)).withColumnRenamed("id", id_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                         percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, with all columns: the one with the smallest id, nulls last.

    Rows with a repeated or null id are told apart; a column may have any name."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("_doc"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if not ids_are_keys(rows.select("id")):
        rows = keyed(rows).drop("id").withColumnRenamed("key", "id")
    gone = _components(rows.select("id", "text"), shingle_words, percent).filter("NOT kept").select("id")
    return rows.select("id", "_doc").join(gone, "id", "left_anti").select("_doc.*")


def _components(texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """(id, n_shingles, component_id, kept) of (id, text) with unique ids."""
    texts = texts.select("id", "text")
    described = stored(texts.mapInArrow(
        _describe(shingle_words), "id long, n_shingles long, set_a long, set_b long, sig binary"))
    same = ["n_shingles", "set_a", "set_b"]
    filled = described.filter("n_shingles > 0")
    nodes = stored(filled.groupBy(*same).agg(F.min("id").alias("node"), F.first("sig").alias("sig")))
    keys = nodes.select("node", "sig").mapInArrow(_keys, "key long, node long")
    sizes = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    star = stored(keys.join(sizes, "key").filter("node <> pivot")
                  .select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    sig = nodes.select("node", "sig", "n_shingles")
    near = (star.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na")), "a")
            .join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb")), "b")
            .filter(percent * F.greatest("na", "nb") <= 100 * F.least("na", "nb"))
            .select("a", "b", "sa", "sb").mapInArrow(_near, "a long, b long"))
    links = stored(_confirm(near, texts, shingle_words, percent))
    label = connected_components(links, "a", "b")
    more = stored(_missed_links(star, label, nodes, texts, shingle_words, percent))
    if not more.isEmpty():
        label = connected_components(links.unionByName(more), "a", "b")
    placed = nodes.join(label, "node", "left").select(*same, F.coalesce("component", "node").alias("c"))
    out = described.join(placed, same, "left")
    component = F.coalesce("c", "id")
    return out.select("id", "n_shingles", component.alias("component_id"), (component == F.col("id")).alias("kept"))
