"""Best-fit packing of documents into fixed-length sequences by hierarchical residual packing.

Pieces are spread over groups of about ``GROUP`` pieces.  Each group packs best fit, longest first, and
emits its nearly full sequences.  The others become items that are packed again, best fit, after
``FAN_IN`` groups have been merged, and so on up a tree until one group is left.

Within one best-fit group no two sequences fit together, so at most one of them is half empty or more
and any later gain comes from putting such a one into another group's gap.  A group therefore passes on its
``CARRY`` emptiest sequences and emits the rest: every task of the tree is bounded, whatever the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .tables import stored
from .textops import flat_texts, slices
from .tokenizer_ids import tokenizer_coder

CAPACITY = 4096
GROUP, FAN_IN, CARRY = 4000, 8, 256


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: bin and offset of each item, and the fill of each bin.

    Bit r of one integer tells whether some bin has r free places, so the tightest bin that takes an
    item is its lowest set bit from the item's size upwards.
    """
    order = np.argsort(-sizes, kind="stable")
    place, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            own, room = len(fill), capacity
            fill.append(0)
        place[item], offset[item] = own, fill[own]
        fill[own] += size
        left = room - size
        by_room.setdefault(left, []).append(own)
        rooms |= 1 << left
    return place, offset, np.array(fill, np.int64)


def _pieces(spec, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer_coder(spec.value, added_as_text=False)
        for batch in slices(batches, "text"):
            ids, offsets = coder(*flat_texts(batch.column(1)))
            out: list[tuple] = []
            for k, doc in enumerate(batch.column(0).to_pylist()):
                own = np.append(ids[offsets[k]:offsets[k + 1]], np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start:start + capacity]
                    out.append((doc, piece, start, len(part), zlib.crc32(part.tobytes())))
            doc, piece, start, length, crc = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32"])
    return run


def _round(level: int, capacity: int, slack: int, last: bool):
    """Pack one group; a bin's key is level, group and number in the group."""
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("item", kind="stable")
        place, offset, fill = best_fit(items["size"].to_numpy(), capacity)
        key = (level << 58) | (int(items["grp"].iloc[0]) << 24) | place
        up = np.zeros(len(fill), bool)
        if not last:
            up[np.argsort(fill, kind="stable")[:CARRY]] = True
            up &= fill < capacity - slack
        return pd.DataFrame({"item": items["item"].to_numpy(), "bin": key, "at": offset, "fill": fill[place],
                             "up": up[place], "grp": items["grp"].to_numpy()})
    return run


PLACED = "item long, bin long, at long, fill long, up boolean, grp long"


def pack(pieces: DataFrame, item: str, size: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(item, sequence_id, offset) for every row of ``pieces``; ``item`` is a unique long, ``size`` is
    between 1 and ``capacity``.  Sizes in a sequence sum to at most ``capacity``; offsets are gapless."""
    slack = capacity // 256
    rows = stored(pieces.select(F.col(item).alias("item"), F.col(size).alias("size")))
    groups = max(1, -(-rows.count() // group))
    now = rows.withColumn("grp", F.pmod(F.xxhash64("item"), F.lit(groups)))
    levels, level = [], 0
    while True:
        placed = stored(now.groupBy("grp").applyInPandas(_round(level, capacity, slack, groups == 1), PLACED))
        levels.append(placed)
        if groups == 1:
            break
        groups, level = -(-groups // FAN_IN), level + 1
        now = placed.filter("up").groupBy("bin").agg(F.first("fill").alias("size"), F.first("grp").alias("g")) \
            .select(F.col("bin").alias("item"), "size", F.expr(f"g div {FAN_IN}").alias("grp"))
    final = None
    for placed in reversed(levels):
        own = placed.select("item", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
        if final is not None:
            above = final.select(F.col("item").alias("sequence_id"), F.col("sequence_id").alias("higher"),
                                 F.col("offset").alias("shift"))
            own = own.join(above, "sequence_id", "left").select(
                "item", F.coalesce("higher", "sequence_id").alias("sequence_id"),
                (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
        final = own
    return final


def pack_documents(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
                   capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text (null: empty) and ``end_id``; only documents longer than
    ``capacity`` are cut, every ``capacity`` ids.  Whole-capacity pieces are sequences of their own.  Repeated
    ids are packed row by row; null ids stay null.  Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = stored(rows.mapInArrow(_pieces(spark.sparkContext.broadcast(spec), end_id, capacity),
                                    "id long, piece int, start long, length long, ids_crc32 long")
                    .withColumn("item", F.monotonically_increasing_id()))
    whole = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("item")) \
        .withColumn("offset", F.lit(0).cast("long"))
    part = pieces.filter(F.col("length") < capacity)
    placed = part.join(pack(part, "item", "length", capacity), "item")
    cols = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return whole.select(*cols).unionByName(placed.select(*cols))
