"""Vectorised byte-level text helpers for Arrow batches (NumPy only, no per-character Python).

Texts of a batch are handled as one flat UTF-8 buffer with document offsets.  Segments (words,
chunks) are identified by a 64-bit polynomial hash taken from prefix sums, so every step is a
handful of array passes whatever the length of a single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Most text bytes handled at once inside a task; longer single texts are handled alone.
SLICE_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), applied to a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        for k, step in enumerate((_BASE, inverse)):
            run = np.full(size, step, np.uint64)
            run[0] = 1
            _POWERS[k] = np.cumprod(run)
    return _POWERS[0], _POWERS[1]


def flat_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of text (one text at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat_texts(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range ``data[start:end]`` (equal bytes, equal hash)."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(n + 1)
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(_BYTE_VALUES[data] * power[:n], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of characters other than space and tab..CR, and the index of the
    first word of each document (length documents + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~solid[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~solid[1:]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Lead bytes of characters that can be white space outside ASCII.
_WIDE_SPACE_LEADS = np.zeros(256, bool)
_WIDE_SPACE_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".,;:!?")] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
#: Second bytes of the letters U+00C0 to U+00FF.
_LATIN_TAILS = np.zeros(256, bool)
_LATIN_TAILS[[k for k in range(0x80, 0xC0) if k not in (0x97, 0xB7)]] = True


def word_chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks that a tokenizer codes alike whether alone or in the whole text.

    Cuts lie where no pre-tokenizer joins characters or looks across: before a single blank, and before and
    after a single line break, that stands between two characters that are surely no white space; and between
    a Latin letter and one of ``.,;:!?``.  Chunks tile each document.  Returns starts, ends and the
    first chunk per document.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    lead = _WIDE_SPACE_LEADS[data]
    alone = np.zeros(n, bool)
    if n > 2:
        # solid before (no wide white space, whose lead is two or three bytes back) and solid after
        alone[1:-1] = solid[:-2] & solid[2:] & ~lead[2:]
        alone[2:] &= ~lead[:-2]
        alone[3:] &= ~(lead[:-3] & (data[:-3] != 0xC2))
    line = alone & (data == 10)
    cut = (alone & (data == 0x20)) | line
    cut[1:] |= line[:-1]
    letter = _LETTERS[data]
    letter[1:] |= _LATIN_TAILS[data[1:]] & (data[:-1] == 0xC3)
    cut[1:] |= letter[:-1] & _STOPS[data[1:]]
    cut[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(starts, offsets)


def expand(values: np.ndarray, value_offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the ragged rows ``pick`` of (values, value_offsets); also the new offsets."""
    lengths = (value_offsets[1:] - value_offsets[:-1])[pick]
    out = np.zeros(len(pick) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    at = np.repeat(value_offsets[:-1][pick] - out[:-1], lengths) + np.arange(out[-1])
    return values[at], out


def ragged(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, lengths) of a list of id sequences."""
    lengths = np.fromiter((len(x) for x in rows), np.int64, len(rows))
    return np.fromiter((i for x in rows for i in x), np.uint32, int(lengths.sum())), lengths


class ChunkCoder:
    """Encode documents through their distinct chunks.

    ``encode(list_of_bytes) -> (flat ids, number of ids of each)`` is called for the distinct chunks of a
    slice that are not in the store.  The store holds at most ``keep`` chunks and is emptied when it is full,
    so memory is bounded whatever the number of distinct chunks; it only saves time.
    """

    def __init__(self, encode, chunks=word_chunks, keep: int = 600_000):
        self.encode, self.chunks, self.keep = encode, chunks, keep
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.row = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.offsets = np.zeros(1, np.int64)

    def _add(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        fresh, lengths = self.encode(pieces)
        rows = np.arange(len(self.offsets) - 1, len(self.offsets) - 1 + len(pieces))
        self.ids = np.concatenate([self.ids, fresh])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
        at = np.searchsorted(self.known, hashes)
        self.known, self.row = np.insert(self.known, at, hashes), np.insert(self.row, at, rows)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a slice and the id offsets per document."""
        starts, ends, first = self.chunks(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes, where, inverse = np.unique(segment_hashes(data, starts, ends), return_index=True,
                                           return_inverse=True)
        if len(self.known) + len(hashes) > self.keep:
            self._clear()
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        missing = self.known[at] != hashes if len(self.known) else np.ones(len(hashes), bool)
        if missing.any():
            raw = data.tobytes()
            index = where[missing]
            self._add(hashes[missing], [raw[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist())])
            at = np.searchsorted(self.known, hashes)
        ids, ends_of = expand(self.ids, self.offsets, self.row[at][inverse])
        return ids, ends_of[first]


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """One record batch per run of equal values in the first ``keys`` columns (input sorted by them)."""
    held: list[pa.RecordBatch] = []
    group = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for values in columns:
            change[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            here = tuple(values[a] for values in columns)
            if held and here != group:
                yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            group = here
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
