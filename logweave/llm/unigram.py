"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces.

The pieces and their scores come from a public model file.  A text gets the dummy blank in front (if the
model asks for it) and blanks become the white-space marker U+2581.  The best segmentation has the
largest sum of scores; a character that no piece covers costs the smallest score minus 10 and is written as
its UTF-8 bytes (byte fallback).  No piece holds the marker after another character, so a text
can be cut before each run of blanks and each distinct cut is segmented once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .textops import ChunkCoder, expand, flat_texts, ragged, slices

MARK = "▁".encode()
#: Fixed value of the format: what an unknown character costs below the smallest score.
UNKNOWN_PENALTY = 10.0


class DoubleArray:
    """A trie in two arrays: the child of state s by byte c is t = base[s] + c if check[t] == s."""

    def __init__(self, words: list[bytes]):
        size = 1 << 17
        base, check, value = (np.full(size, fill, np.int32) for fill in (0, -1, -1))
        check[0] = 0
        first = 1
        tree: dict = {}
        for k, word in enumerate(words):
            node = tree
            for c in word:
                node = node.setdefault(c, {})
            node[-1] = k
        queue = [(0, tree)]
        for state, node in queue:
            labels = np.array(sorted(c for c in node if c >= 0), np.int64)
            value[state] = node.get(-1, -1)
            if not len(labels):
                continue
            while check[first] >= 0:
                first += 1
            at, place = first, None
            while place is None:
                if at + 8192 + 512 > len(check):
                    base, check, value = (np.concatenate([x, np.full(size, fill, np.int32)])
                                          for x, fill in ((base, 0), (check, -1), (value, -1)))
                starts = at + np.flatnonzero(check[at:at + 8192] < 0) - labels[0]
                starts = starts[starts > 0]
                fits = starts[(check[starts[:, None] + labels] < 0).all(1)]
                place = int(fits[0]) if len(fits) else None
                at += 8192
            base[state] = place
            check[place + labels] = state
            queue += [(place + c, node[c]) for c in labels.tolist()]
        pad = np.full(512, -1, np.int32)
        self.base, self.check, self.value = (np.concatenate([x, pad]).tolist() for x in (base, check, value))

    def prefixes(self, text: bytes, at: int) -> Iterator[tuple[int, int]]:
        """(end, word) of the words that start at ``at``."""
        base, check, value = self.base, self.check, self.value
        state = 0
        for end in range(at, len(text)):
            to = base[state] + text[end]
            if check[to] != state or not to:
                return
            state = to
            if value[state] >= 0:
                yield end + 1, value[state]


class UnigramModel:
    """Pieces and scores of a model file, with what encoding and decoding need."""

    def __init__(self, proto: bytes):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(k).encode() for k in range(n)]
        self.scores = [sp.get_score(k) for k in range(n)]
        self.unknown = sp.unk_id()
        special = [sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k) or sp.is_byte(k) for k in range(n)]
        normal = [k for k in range(n) if not special[k]]
        self.bytes = {int(self.pieces[k][3:5], 16): k for k in range(n) if sp.is_byte(k)}
        self.dummy = self.decodes_dummy(sp)
        if any(MARK in _after_marks(self.pieces[k]) for k in normal):
            raise ValueError("a piece holds the white-space marker after another character")
        self.normal = normal
        self.trie = DoubleArray([self.pieces[k] for k in normal])
        self.lowest = min(self.scores[k] for k in normal) - UNKNOWN_PENALTY
        back = [b""] * n
        for k in normal:
            back[k] = self.pieces[k].replace(MARK, b" ")
        for value, k in self.bytes.items():
            back[k] = bytes([value])
        self.back = np.frombuffer(b"".join(back), np.uint8)
        self.back_offsets = np.zeros(n + 1, np.int64)
        np.cumsum([len(b) for b in back], out=self.back_offsets[1:])
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.bytes.values())] = True
        self.score_array = np.array(self.scores)
        self.score_array[self.is_byte] = 0.0

    @staticmethod
    def decodes_dummy(sp) -> bool:
        return sp.encode("a", out_type=str)[0].startswith("▁")

    def segment(self, text: bytes) -> list[int]:
        """Best ids of one text whose blanks are already markers (Viterbi, ties to the shorter last
        piece seen first)."""
        n = len(text)
        best, back = [None] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        scores, normal = self.scores, self.normal
        at = 0
        while at < n:
            here = best[at]
            lead = text[at]
            step = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            single = False
            for end, word in self.trie.prefixes(text, at):
                piece = normal[word]
                total = here + scores[piece]
                if best[end] is None or total > best[end]:
                    best[end], back[end] = total, (at, piece)
                single |= end == at + step
            if not single:
                total = here + self.lowest
                end = at + step
                if best[end] is None or total > best[end]:
                    best[end], back[end] = total, (at, self.unknown)
            at += step
        ids: list[int] = []
        end = n
        while end:
            at, piece = back[end]
            if piece == self.unknown and self.bytes:
                ids += [self.bytes[c] for c in reversed(text[at:end])]
            else:
                ids.append(piece)
            end = at
        return ids[::-1]

    def coder(self) -> ChunkCoder:
        return ChunkCoder(lambda chunks: ragged([self.segment(c.replace(b" ", MARK)) for c in chunks]), blank_chunks)

    def prepare(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put the dummy blank before every text that is not empty."""
        if not self.dummy:
            return data, offsets
        filled = np.diff(offsets) > 0
        shift = np.zeros(len(offsets), np.int64)
        np.cumsum(filled, out=shift[1:])
        return np.insert(data, offsets[:-1][filled], 0x20), offsets + shift

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts of ids, without the dummy blank."""
        data, ends = expand(self.back, self.back_offsets, ids.astype(np.int64))
        offsets = ends[offsets]
        if self.dummy:
            drop = (np.diff(offsets) > 0) & (data[np.minimum(offsets[:-1], max(len(data) - 1, 0))] == 0x20) \
                if len(data) else np.zeros(len(offsets) - 1, bool)
            data = np.delete(data, offsets[:-1][drop])
            shift = np.zeros(len(offsets), np.int64)
            np.cumsum(drop, out=shift[1:])
            offsets = offsets - shift
        return data, offsets


def _after_marks(piece: bytes) -> bytes:
    while piece.startswith(MARK):
        piece = piece[len(MARK):]
    return piece


def blank_chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks that start at each run of blanks, and at each document."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = data == 0x20
    cut[1:] &= data[:-1] != 0x20
    cut[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


def _encode(model_of, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        coder = model.coder()
        for batch in slices(batches, "text"):
            data, offsets = flat_texts(batch.column(1))
            ids, at = coder(*model.prepare(data, offsets))
            back, ends = model.decode(ids, at)
            lengths = np.diff(at)
            whole = np.zeros(len(lengths), bool)
            same = np.diff(ends) == np.diff(offsets)
            for k in np.flatnonzero(same).tolist():
                whole[k] = np.array_equal(back[ends[k]:ends[k + 1]], data[offsets[k]:offsets[k + 1]])
            total = np.zeros(len(ids) + 1)
            np.cumsum(model.score_array[ids], out=total[1:])
            count = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(model.is_byte[ids], out=count[1:])
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:])]
            columns = [batch.column(0), pa.array(lengths, pa.int64()), pa.array(count[at[1:]] - count[at[:-1]]),
                       pa.array(crc, pa.int64()), pa.array(total[at[1:]] - total[at[:-1]]), pa.array(whole)]
            names = ["id", "n_tokens", "n_byte_tokens", "ids_crc32", "score", "round_trip"]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, proto: bytes, id_col: str = "doc_id", text_col: str = "text",
           keep_ids: bool = True) -> DataFrame:
    """Per row: id, n_tokens, n_byte_tokens (from byte fallback), ids_crc32 (ids as little-endian 32
    bits), score (sum over pieces, bytes count 0), round_trip (decoding gives the text back) and, on
    request, ids.  A null text is empty and has no ids; ids of rows may repeat or be null.  A literal
    marker character decodes as a blank, so such a text does not round-trip.  Other columns are ignored."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, n_tokens long, n_byte_tokens long, ids_crc32 long, score double, round_trip boolean"
    return rows.mapInArrow(_encode(docs.sparkSession.sparkContext.broadcast(UnigramModel(proto)), keep_ids),
                           schema + ", ids array<int>" * keep_ids).withColumnRenamed("id", id_col)


def _decode(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.zeros(batch.num_rows + 1, np.int64)
            np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out=offsets[1:])
            data, ends = model.decode(ids, offsets)
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])
    return run


def decode(tokens: DataFrame, proto: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id lists: markers become blanks, byte pieces bytes, invalid UTF-8 the replacement
    character.  A null list is empty."""
    ship_package(tokens.sparkSession)
    rows = tokens.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(tokens.sparkSession.sparkContext.broadcast(UnigramModel(proto))), "id long, text string") \
        .withColumnRenamed("id", id_col)
