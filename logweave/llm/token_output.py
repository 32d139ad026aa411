"""Token-id files: fixed-size id blocks, transposed into byte or bit planes, compressed plane by plane.

File layout (little endian)::

    magic 8 bytes | zstandard frames, plane by plane, block by block | index frame | tail

The index frame (zstandard) is the chunk index: per block its number of ids and, per plane, offset
and length of the frame; then the id of each document and its number of ids, in file order.  The tail is
(index offset, index length, bits per id, planes per block, magic).  Any block can be read alone.

Documents are range-partitioned by id and sorted, so shard k holds smaller ids than shard k + 1.  A
task writes its shard under a fresh name and returns its name and totals; only names returned by tasks
that succeeded are read, so a lost or repeated task leaves at most an unused file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .tables import open_folder, scratch, stored
from .textops import flat_texts, slices
from .tokenizer_ids import tokenizer_coder

MAGIC = b"IDPLANE1"
TAIL = struct.Struct("<QQBB8s")
BLOCK_IDS = 1 << 16
#: The number that stands for a null id in the chunk index; no document may have it.
NO_ID = -(1 << 63)
#: Ids after which a task starts another file.
FILE_IDS = 1 << 26


def split_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of one block of 32-bit ids: 4 byte planes, or 32 bit planes."""
    bytes_ = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(bytes_[:, k]).tobytes() for k in range(4)]
    cells = np.unpackbits(bytes_, axis=1, bitorder="little")
    return [np.packbits(cells[:, k], bitorder="little").tobytes() for k in range(32)]


def join_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The inverse of ``split_planes`` for a block of ``n`` ids."""
    if not bits:
        out = np.empty((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            out[:, k] = np.frombuffer(plane, np.uint8)
    else:
        cells = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], 1)
        out = np.packbits(cells, axis=1, bitorder="little")
    return np.ascontiguousarray(out).view("<u4").reshape(-1)


class PlaneWriter:
    """Stream documents into one file."""

    def __init__(self, stream, bits: bool = False, block: int = BLOCK_IDS, level: int = 3):
        import zstandard
        self.stream, self.bits, self.block = stream, bits, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.at = self.stream.write(MAGIC) or len(MAGIC)
        self.blocks: list[list[int]] = []
        self.docs: list[int] = []
        self.counts: list[int] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        entry = [len(ids)]
        for plane in split_planes(ids, self.bits):
            frame = self.pack(plane)
            entry += [self.at, len(frame)]
            self._write(frame)
        self.blocks.append(entry)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block:
            flat = np.concatenate(self.held)
            full = len(flat) // self.block * self.block
            for k in range(0, full, self.block):
                self._block(flat[k:k + self.block])
            self.held, self.n_held = [flat[full:]], len(flat) - full

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        index = b"".join([np.array([len(self.blocks), len(self.docs)], "<i8").tobytes(),
                          np.array(self.blocks, "<i8").tobytes(), np.array(self.docs, "<i8").tobytes(),
                          np.array(self.counts, "<i8").tobytes()])
        frame, at, planes = self.pack(index), self.at, 32 if self.bits else 4
        self._write(frame)
        self._write(TAIL.pack(at, len(frame), 32, planes, MAGIC))


class PlaneReader:
    """Random access to one file: the chunk index, single blocks, documents in order."""

    def __init__(self, file):
        import zstandard
        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        size = file.size()
        at, length, _, self.planes, magic = TAIL.unpack(self._read(size - TAIL.size, TAIL.size))
        if magic != MAGIC or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a plane file")
        index = np.frombuffer(self.unpack(self._read(at, length)), "<i8")
        n_blocks, n_docs = index[:2].tolist()
        width = 1 + 2 * self.planes
        self.blocks = index[2:2 + n_blocks * width].reshape(n_blocks, width)
        self.docs, self.counts = index[2 + n_blocks * width:].reshape(2, n_docs)

    def _read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def block(self, k: int) -> np.ndarray:
        n, *places = self.blocks[k].tolist()
        first, last = places[0], places[-2] + places[-1]
        raw = self._read(first, last - first)
        planes = [self.unpack(raw[a - first:a - first + c]) for a, c in zip(places[::2], places[1::2])]
        return join_planes(planes, n, self.planes == 32)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        held, at = np.zeros(0, np.uint32), 0
        for doc, count in zip(self.docs.tolist(), self.counts.tolist()):
            parts = [held]
            have = len(held)
            while have < count:
                parts.append(self.block(at))
                have += len(parts[-1])
                at += 1
            if len(parts) > 1:
                held = np.concatenate(parts)
            yield None if doc == NO_ID else doc, held[:count]
            held = held[count:]


def _write_shards(spec, folder: str, end_id: int, bits: bool, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, shard = TaskContext.get().partitionId(), 0
        store, path = open_folder(folder)
        coder = tokenizer_coder(spec.value, added_as_text=False)
        writer = name = None

        def close():
            writer.close()
            writer.stream.close()
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "name": name, "n_docs": len(writer.docs),
                                                "n_ids": writer.n_ids}])

        for batch in slices(batches, "text"):
            ids, offsets = coder(*flat_texts(batch.column(1)))
            for k, doc in enumerate(batch.column(0).to_pylist()):
                if writer is None:
                    name = f"{part:06d}-{shard:04d}-{uuid.uuid4().hex}.idp"
                    store.create_dir(path, recursive=True)
                    writer = PlaneWriter(store.open_output_stream(f"{path}/{name}"), bits, block)
                own = ids[offsets[k]:offsets[k + 1]]
                writer.add(doc, np.append(own, np.uint32(end_id)))
                if writer.n_ids >= FILE_IDS:
                    yield close()
                    writer, shard = None, shard + 1
        if writer is not None:
            yield close()
    return run


MANIFEST = "part long, shard long, name string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, folder: str, spec: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = 0, bits: bool = False, block: int = BLOCK_IDS) -> DataFrame:
    """Write the token ids of every text (null: empty) into ``folder``, in ascending id order; returns
    the manifest: one row per file (part, shard, name, n_docs, n_ids).  ``end_id`` follows each
    document.  Rows with a null id come last; repeated and null ids are kept, in any order among themselves.  Other
    columns are ignored."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("id").asc_nulls_last()
    laid = rows.repartitionByRange(parts, order).sortWithinPartitions(order)
    return stored(laid.mapInArrow(_write_shards(spark.sparkContext.broadcast(spec), folder, end_id, bits, block),
                                  MANIFEST))


def _read_shards(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_folder(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{path}/{name}") as file:
                    rows: list[tuple] = []
                    for doc, ids in PlaneReader(file).documents():
                        rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)
    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                      names=["id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Read the files of a manifest: per document id, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids_crc32``.  Starts come from running totals over one row per file."""
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    named = manifest.select("name", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("start"))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (named.repartition(parts, "name")
            .mapInArrow(_read_shards(folder), "id long, start long, n_tokens long, ids_crc32 long")
            .withColumnRenamed("id", id_col))


def token_files(docs: DataFrame, spec: str, **options) -> DataFrame:
    """Write the files of ``docs`` to a fresh folder of the session's shared store and read them back."""
    folder = scratch(docs.sparkSession)
    return read_token_files(write_token_files(docs, folder, spec, **options), folder,
                            options.get("id_col", "doc_id"))
