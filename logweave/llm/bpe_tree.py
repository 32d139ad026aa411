"""Byte-level BPE encoding and decoding; long unsplit texts by tree concatenation.

A text of more than ``leaf`` characters is cut into leaves wherever the count falls.  Leaves are encoded in parallel,
each as a text of its own, and neighbours are joined pairwise up a tree.  A join re-encodes a window around the
cut and lets it grow until both sides agree exactly:

* Pre-tokens.  The pattern reads from left to right and looks at most three bytes ahead of a start and one character
  behind an end, so that a boundary of the left side is final once the pre-token before it starts three
  bytes or more before the cut.  The window runs from the last final boundary into the right side until it meets a
  boundary that the right side has as well; from there on the right side's tokens hold.
* Tokens.  A pre-token that crosses the cut and is the left side's last and the right side's first one put
  together is not encoded anew.  A sequence of tokens is the encoding of its text exactly if every two neighbours are
  the encoding of theirs; so a window of tokens around the cut is re-encoded, and the sides agree as soon as its first
  and last token are the ones that stood there.  Otherwise the side that disagrees gives twice as many tokens.

Strings of added tokens (such as an end-of-text marker) cut a text first, as in the library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .tables import stored
from .textops import expand, flat_texts, ragged, slices, sorted_groups
from .tokenizer_ids import tokenizer_coder

#: Characters of a leaf, and neighbouring nodes that one task joins in a round.
LEAF, FAN = 1 << 15, 16


class Node(NamedTuple):
    """Token ids of a stretch of text, and which of them start a pre-token."""
    ids: np.ndarray
    first: np.ndarray


def _byte_chars() -> dict[str, int]:
    """The byte for each character of the byte-level alphabet: printable Latin-1 stands for itself, others follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenBytes:
    """The bytes of every token of a tokenizer file (its JSON text), without the tokenizer itself."""

    def __init__(self, spec: str):
        parts = json.loads(spec)
        names = parts["model"]["vocab"] | {a["content"]: a["id"] for a in parts["added_tokens"]}
        chars = _byte_chars()
        self.text = [""] * (max(names.values(), default=-1) + 1)
        for text, k in names.items():
            self.text[k] = text
        tokens = [bytes(chars[c] for c in t) if all(c in chars for c in t) else t.encode() for t in self.text]
        self.bytes, self.lengths = ragged(tokens)
        self.bytes, self.offsets = self.bytes.astype(np.uint8), np.concatenate([[0], np.cumsum(self.lengths)])

    def raw(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens; ids without a token have none."""
        ids = ids[ids < len(self.text)]
        return expand(self.bytes, self.offsets, ids.astype(np.int64))[0].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        return self.raw(ids).decode("utf-8", "replace")


class TreeCoder(TokenBytes):
    """Leaves and joins with one tokenizer file (its JSON text)."""

    def __init__(self, spec: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers
        self.tokenizer = t = Tokenizer.from_str(spec)
        t.no_truncation()
        t.no_padding()
        if not isinstance(t.model, models.BPE) or not isinstance(t.pre_tokenizer, pre_tokenizers.ByteLevel) or t.normalizer:
            raise ValueError("a byte-level BPE tokenizer without normaliser is needed")
        if t.pre_tokenizer.add_prefix_space or not t.pre_tokenizer.use_regex or t.model.dropout:
            raise ValueError("leaves need the plain byte-level pattern and merges without dropout")
        self.split, self.model = t.pre_tokenizer.pre_tokenize_str, t.model
        added = t.get_added_tokens_decoder()
        if any(a.lstrip or a.rstrip or a.single_word or a.normalized for a in added.values()):
            raise ValueError("an added token looks at its neighbours")
        names = sorted((a.content for a in added.values()), key=len, reverse=True)
        self.added = re.compile(f"({'|'.join(map(re.escape, names))})") if names else None
        super().__init__(spec)

    def segments(self, text: str) -> list[str]:
        """The texts between added tokens, and these, in order."""
        return [s for s in self.added.split(text) if s] if self.added else [text] if text else []

    def leaf(self, text: str) -> Node:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        word = np.array(e.word_ids, np.int64)
        first = np.ones(len(word), bool)
        first[1:] = word[1:] != word[:-1]
        return Node(np.array(e.ids, np.uint32), first)

    def _merge(self, piece: str) -> np.ndarray:
        return np.array([t.id for t in self.model.tokenize(piece)], np.uint32)

    def grow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Tokens of one pre-token from the exact tokens of its two parts."""
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = np.concatenate([left[len(left) - i:], right[:j]])
            ids = self._merge("".join([self.text[k] for k in window.tolist()]))
            left_agrees = i == len(left) or ids[0] == left[-i]
            right_agrees = j == len(right) or ids[-1] == right[j - 1]
            if left_agrees and right_agrees:
                return np.concatenate([left[:len(left) - i], ids, right[j:]])
            i, j = i if left_agrees else 2 * i, j if right_agrees else 2 * j

    def join(self, a: Node, b: Node) -> Node:
        """The node of the two texts put together; equal to ``leaf`` of the whole text."""
        if not len(a.ids) or not len(b.ids):
            return b if not len(a.ids) else a
        a_at, b_at = np.flatnonzero(a.first), np.flatnonzero(b.first)
        a_ends, b_ends = np.cumsum(self.lengths[a.ids]), np.cumsum(self.lengths[b.ids])
        a_pos, b_pos = (np.append(ends[at] - self.lengths[n.ids[at]], ends[-1])
                        for n, at, ends in ((a, a_at, a_ends), (b, b_at, b_ends)))
        a_at, b_at = np.append(a_at, len(a.ids)), np.append(b_at, len(b.ids))
        final = int(np.searchsorted(a_pos[:-1], a_pos[-1] - 3, "right"))  # pre-tokens that start early enough
        k = min(final, len(a_pos) - 2)
        tail = self.raw(a.ids[a_at[k]:])
        take = 4
        while True:
            take = min(take, len(b_pos) - 1)
            whole = take == len(b_pos) - 1
            text = (tail + self.raw(b.ids[:b_at[take]])).decode("utf-8")
            pieces = [p for p, _ in self.split(text)]
            cuts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]) - len(tail)
            met = np.isin(cuts[:-1], b_pos[:take]) & (cuts[:-1] >= 0)
            if not whole:
                met[1:] &= cuts[:-2] + 3 <= cuts[-1]
                met[0] = False
            m = int(np.argmax(met)) if met.any() else len(pieces)
            if whole or met.any():
                break
            take *= 2
        ids, first = [a.ids[:a_at[k]]], [a.first[:a_at[k]]]
        for piece, at, end in zip(pieces[:m], cuts[:m].tolist(), cuts[1:m + 1].tolist()):
            if at + a_pos[-1] == a_pos[-2] and at < 0 < end == b_pos[1]:
                own = self.grow(a.ids[a_at[-2]:], b.ids[:b_at[1]])
            else:
                own = self._merge(piece)
            ids.append(own)
            first.append(np.arange(len(own)) == 0)
        rest = b_at[int(np.searchsorted(b_pos, cuts[m]))]
        return Node(np.concatenate([*ids, b.ids[rest:]]), np.concatenate([*first, b.first[rest:]]))

    def tree(self, nodes: list[Node]) -> Node:
        """Join neighbours pairwise, level by level."""
        while len(nodes) > 1:
            nodes = [self.join(*nodes[k:k + 2]) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
        return nodes[0]


_CODERS: dict[tuple[type, str], TokenBytes] = {}


def tree_coder(spec: str, kind: type = TreeCoder):
    """The coder of a file, one per worker process; ``TokenBytes`` is enough for decoding."""
    if (kind, spec) not in _CODERS:
        _CODERS.clear()
        _CODERS[kind, spec] = kind(spec)
    return _CODERS[kind, spec]


def _whole(spec):
    """Texts of one leaf or less, through their distinct chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer_coder(spec.value, added_as_text=False)
        for batch in slices(batches, "text"):
            ids, offsets = coder(*flat_texts(batch.column(1)))
            raw = ids.astype("<u4").tobytes()
            cells = [raw[4 * a:4 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], names=["id", "ids"])
    return run


def _cut(spec, leaf: int):
    """(row, id, text) into (row, id, segment, node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tree_coder(spec.value)
        for batch in slices(batches, "text"):
            rows = [(row, key, s, k, part[at:at + leaf])
                    for row, key, text in zip(*(batch.column(c).to_pylist() for c in range(3)))
                    for s, part in enumerate(coder.segments(text))
                    for k, at in enumerate(range(0, len(part), leaf))]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.string())],
                                             names=["row", "id", "segment", "node", "text"])
    return run


NODE = "row long, id long, segment long, node long, ids binary, first binary"


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns[:4]]
        + [pa.array([n.ids.astype("<u4").tobytes() for n in columns[4]], pa.binary()),
           pa.array([np.packbits(n.first).tobytes() for n in columns[4]], pa.binary())],
        names=["row", "id", "segment", "node", "ids", "first"])


def _nodes(batch: pa.RecordBatch) -> list[Node]:
    out = []
    for ids, first in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
        own = np.frombuffer(ids, "<u4").astype(np.uint32)
        out.append(Node(own, np.unpackbits(np.frombuffer(first, np.uint8), count=len(own)).astype(bool)))
    return out


def _leaves(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tree_coder(spec.value)
        for batch in slices(batches, "text"):
            keys = zip(*(batch.column(c).to_pylist() for c in range(4)))
            yield _node_batch([(*key, coder.leaf(text)) for key, text in zip(keys, batch.column(4).to_pylist())])
    return run


def _round(spec):
    """Rows sorted by (row, segment, parent, node): one node for each parent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tree_coder(spec.value)
        for rows in sorted_groups(batches, 3):
            row, segment, parent = (rows.column(c)[0].as_py() for c in range(3))
            rest = rows.select(["row", "id", "segment", "node", "ids", "first"])
            yield _node_batch([(row, rows.column(3)[0].as_py(), segment, parent, coder.tree(_nodes(rest)))])
    return run


def _last(spec):
    """Rows sorted by (row, segment, node): the ids of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tree_coder(spec.value)
        for rows in sorted_groups(batches, 1):
            nodes, segment = _nodes(rows), rows.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(segment[1:] != segment[:-1]) + 1).tolist(), len(nodes)]
            ids = np.concatenate([coder.tree(nodes[a:b]).ids for a, b in zip(cuts, cuts[1:])])
            yield pa.RecordBatch.from_arrays([rows.column(1)[:1], pa.array([ids.astype("<u4").tobytes()], pa.binary())],
                                             names=["id", "ids"])
    return run


def encode_texts(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF,
                 fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: id and ``ids``, the token ids as little-endian unsigned 32-bit integers.

    The ids are those of the library for the whole text, added tokens recognised, no special tokens added.  A null or
    empty text has none.  Ids of rows may repeat or be null: every row is coded for itself.  Other columns are ignored.
    A round of joins takes ``fan`` neighbours together; the number of rounds is the logarithm of the longest text.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shipped = spark.sparkContext.broadcast(spec)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    long = F.coalesce(F.length("text") > leaf, F.lit(False))
    short = rows.filter(~long).mapInArrow(_whole(shipped), "id long, ids binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = (rows.filter(long).select(F.monotonically_increasing_id().alias("row"), "id", "text")
           .mapInArrow(_cut(shipped, leaf), "row long, id long, segment long, node long, text string"))
    nodes = stored(cut.repartition(parts, "row", "segment", "node").mapInArrow(_leaves(shipped), NODE))
    while (nodes.agg(F.max("node")).first()[0] or 0) >= fan:
        laid = (nodes.withColumn("parent", F.expr(f"node div {fan}")).select("row", "segment", "parent", "id", "node", "ids", "first")
                .repartition(parts, "row", "segment", "parent").sortWithinPartitions("row", "segment", "parent", "node"))
        nodes = stored(laid.mapInArrow(_round(shipped), NODE))
    joined = (nodes.repartition(parts, "row").sortWithinPartitions("row", "segment", "node")
              .mapInArrow(_last(shipped), "id long, ids binary"))
    return short.unionByName(joined).withColumnRenamed("id", id_col)


def _decode(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tree_coder(spec.value, TokenBytes)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [coder.decode(np.frombuffer(x or b"", "<u4")) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())],
                                                 names=["id", "ids", "text"])
    return run


def decode_ids(coded: DataFrame, spec: str, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``coded`` (id, ``ids`` as ``encode_texts`` gives them; null: none): id, ids, text."""
    spark = coded.sparkSession
    ship_package(spark)
    rows = coded.select(F.col(id_col).cast("long").alias("id"), "ids")
    return rows.mapInArrow(_decode(spark.sparkContext.broadcast(spec)), "id long, ids binary, text string") \
        .withColumnRenamed("id", id_col)


def code_digest(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``decode_ids``: id, number of tokens, digests of the ids and of the text."""
    return decoded.selectExpr(f"`{id_col}`", "cast(octet_length(ids) div 4 AS long) AS n_tokens",
                              "sha2(ids, 256) AS ids_sha256", "sha2(text, 256) AS decoded_sha256")
