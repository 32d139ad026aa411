"""Maximal periodic runs of words, by tiles per period octave.

Periods are taken by octaves [b, 2b), b a power of two (periods below 8 together).  A run of period q in an octave
repeats at least three times, so some multiple c of b, a boundary, lies in its first b words and has a square, the q words from
c and the q words after them being equal.  Identifiers of all stretches of b words, made by doubling, tell for every boundary
and every period of the octave at once where the boundary Z-function (the length on which the words from c and from c + q agree)
reaches q; for these few pairs it is evaluated by comparing words, to the right and to the left of c.  Squares
whose root repeats itself have a smaller period and are left out; at most two roots of an octave remain per boundary.

A document of up to ``long_chars`` characters is one tile for each octave.  A longer one is exploded into overlapping tiles, those of
an octave eight times as long as its least period, low octaves sharing one tiling; tiles are solved independently in many
tasks and give fragments (document, period, stretch of words that agree with those one period later).  Fragments are
shuffled by document and period and overlapping ones stitched together; neighbouring tiles overlap far enough
that a run's fragments always touch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .tables import stored
from .textops import flat_texts, mix64, segment_hashes, slices, words

LEAST_LENGTH, LEAST_REPEATS, FLOOR = 24, 3, 8
#: Stride of the tiles that the octaves below TILE / 16 share.
TILE = 1 << 13
#: Boundary and period pairs tested at once.
PAIRS = 1 << 20
_U = np.uint64


def _doubled(h: np.ndarray, step: int) -> np.ndarray:
    """Identifiers of stretches of 2 * step words from those of step words."""
    if len(h) <= step:
        return h[:0]
    return mix64(h[:-step] * _U(0x9E3779B97F4A7C15) + (h[step:] ^ _U(0xD1B54A32D192ED03)))


def _prime_factors(low: int, high: int) -> list[np.ndarray]:
    """Arrays over the periods low..high-1; together they hold the distinct prime factors of each (1: none left)."""
    rest = np.arange(low, high)
    left = rest.copy()
    out = []
    factors = [[] for _ in rest]
    p = 2
    while p * p < high:
        at = np.flatnonzero(left % p == 0)
        for k in at.tolist():
            factors[k].append(p)
        while len(at):
            left[at] //= p
            at = at[left[at] % p == 0]
        p += 1
    for k in np.flatnonzero(left > 1).tolist():
        factors[k].append(int(left[k]))
    for n in range(max(map(len, factors), default=0)):
        out.append(np.array([f[n] if n < len(f) else 1 for f in factors]))
    return out


_FACTORS: dict[int, list[np.ndarray]] = {}


def _primitive(h: np.ndarray, half: int, c: np.ndarray, q: np.ndarray, low: int, high: int) -> np.ndarray:
    """Which roots (q words from c) are no power of a shorter one; ``h`` identifies stretches of ``half`` words."""
    if low not in _FACTORS:
        _FACTORS[low] = _prime_factors(low, high)
    ok = np.ones(len(c), bool)
    for table in _FACTORS[low]:
        p = table[q - low]
        some = np.flatnonzero((p > 1) & ok)
        shift = q[some] // p[some]
        length = q[some] - shift
        same = np.ones(len(some), bool)
        for k in range(0, high, half):
            at = c[some] + np.minimum(k, length - half)
            same &= h[at] == h[at + shift]
        ok[some[same]] = False
    return ok


def boundary_z(ids: np.ndarray, q: int, boundaries: np.ndarray) -> list[tuple[int, int]]:
    """The distinct maximal stretches [s, e) around boundaries on which words equal those q later: e - c and
    c - s are the values of the Z-functions to the right and to the left of a boundary c."""
    breaks = np.flatnonzero(ids[:len(ids) - q] != ids[q:])
    k = np.searchsorted(breaks, boundaries)
    stops = np.concatenate([[-1], breaks, [len(ids) - q]])
    return sorted({(s + 1, e) for s, e in zip(stops[k].tolist(), stops[k + 1].tolist()) if s + 1 < e})


def solve(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, own_lo: np.ndarray, own_hi: np.ndarray, origin: np.ndarray,
          least: int = 0, most: int = 1 << 62) -> Iterator[tuple[int, int, int, int]]:
    """Fragments (tile, period, s, e), positions within the tile, of the octaves with least <= b < most.

    Tile k is the words lo[k]..hi[k]-1 of ``ids``; it owns the boundaries own_lo[k]..own_hi[k]-1; ``origin`` is where boundaries are
    counted from."""
    h = mix64(ids.astype(np.uint64) + _U(1))
    levels, b, size = {1: h}, FLOOR, 1
    longest = int((hi - lo).max(initial=0))
    while max(LEAST_LENGTH, LEAST_REPEATS * b) <= longest or b == FLOOR:
        for group in ((1, FLOOR), (FLOOR, 2 * FLOOR)) if b == FLOOR else ((b, 2 * b),):
            octave = 0 if group[0] == 1 else b
            if not least <= octave < most:
                continue
            while size < b:
                levels[2 * size] = _doubled(levels[size], size)
                size *= 2
                levels.pop(size // 4, None)
            yield from _octave(ids, h, levels, lo, hi, own_lo, own_hi, origin, *group, b)
        b *= 2


def _octave(ids, h, levels, lo, hi, own_lo, own_hi, origin, low, high, b):
    tiles = np.flatnonzero(hi - lo >= max(LEAST_LENGTH, LEAST_REPEATS * low))
    if not len(tiles):
        return
    at = levels[b]
    start = own_lo[tiles] + (origin[tiles] - own_lo[tiles]) % b
    stop = np.minimum(own_hi[tiles], hi[tiles] - low - b + 1)
    n = np.maximum(0, (stop - start + b - 1) // b)
    tile = np.repeat(tiles, n)
    ends = np.cumsum(n)
    c = np.repeat(start - b * (ends - n), n) + b * np.arange(ends[-1] if len(ends) else 0)
    periods = np.arange(low, high)
    found_c, found_q, found_t = [], [], []
    rows = max(1, PAIRS // len(periods))
    for k in range(0, len(c), rows):
        own, end = c[k:k + rows, None], hi[tile[k:k + rows], None]
        last = own + (2 * periods if low >= FLOOR else periods + b)
        fits = last <= end
        first = np.where(fits, own + periods, own)
        hit = fits & (at[first] == at[own])
        r, j = np.nonzero(hit)
        cc, qq = c[k:k + rows][r], periods[j]
        if low >= FLOOR:
            square = at[cc + qq - b] == at[cc + 2 * qq - b]
            cc, qq, r = cc[square], qq[square], r[square]
        prime = _primitive(levels[b // 2], b // 2, cc, qq, low, high) if low >= FLOOR else _primitive(h, 1, cc, qq, low, high)
        found_c.append(cc[prime])
        found_q.append(qq[prime])
        found_t.append(tile[k:k + rows][r][prime])
    c, q, tile = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_c, found_q, found_t))
    order = np.lexsort((c, q, tile))
    c, q, tile = c[order], q[order], tile[order]
    cuts = np.flatnonzero(np.concatenate([[True], (tile[1:] != tile[:-1]) | (q[1:] != q[:-1])])) if len(c) else c
    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(c)]):
        t, period = int(tile[a]), int(q[a])
        for s, e in boundary_z(ids[lo[t]:hi[t]], period, c[a:z] - lo[t]):
            yield t, period, s, e


def runs_of(fragments: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs among whole stretches (period, s, e), by start, then period."""
    least: dict[tuple[int, int], int] = {}
    for q, s, e in fragments:
        if e + q - s >= max(LEAST_LENGTH, LEAST_REPEATS * q):
            least[s, e + q - s] = min(q, least.get((s, e + q - s), q))
    return sorted((s, n, q) for (s, n), q in least.items())


def collapse(text: str, runs: list[tuple[int, int, int]]) -> str:
    """The words of a text, joined by one space, without those that a run repeats."""
    own = text.encode().split()
    keep = np.ones(len(own), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return b" ".join(own if keep.all() else [own[k] for k in np.flatnonzero(keep).tolist()]).decode()


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = "id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _results(ids: pa.Array, texts: list[str | None], runs: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
    cells = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs]
    collapsed = [collapse(t or "", own) for t, own in zip(texts, runs)]
    return pa.RecordBatch.from_arrays([ids, pa.array(cells, pa.list_(RUN)), pa.array(collapsed, pa.string())],
                                      names=["id", "runs", "collapsed"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short texts: each is the one tile of its octaves."""
    for batch in slices(batches, "text"):
        data, offsets = flat_texts(batch.column(1))
        starts, ends, first = words(data, offsets)
        ids = segment_hashes(data, starts, ends)
        lo, hi = first[:-1], first[1:]
        found: list[list] = [[] for _ in range(batch.num_rows)]
        for tile, *fragment in solve(ids, lo, hi, lo, hi, lo):
            found[tile].append(fragment)
        yield _results(batch.column(0), batch.column(1).to_pylist(), [runs_of(f) for f in found])


def tiles_of(n: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(least octave, octaves' end, first word owned, first word, last word + 1) of the tiles of n words."""
    octaves = [(0, TILE // 16)]
    while LEAST_REPEATS * octaves[-1][1] <= n:
        octaves.append((octaves[-1][1], 2 * octaves[-1][1]))
    for low, high in octaves:
        widest = high // 2                  # the largest least period of the tiling
        stride = max(TILE, 8 * widest)
        for own in range(0, n, stride):
            yield low, high, own, max(0, own - widest), min(n, own + stride + 4 * widest)


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) into tiles (row, low, high, own, start, stride's end, words as 32-bit numbers)."""
    for batch in slices(batches, "text"):
        data, offsets = flat_texts(batch.column(1))
        starts, ends, first = words(data, offsets)
        ids = segment_hashes(data, starts, ends)
        for k, row in enumerate(batch.column(0).to_pylist()):
            own = ids[first[k]:first[k + 1]]
            number = np.unique(own, return_inverse=True)[1].astype("<u4")
            for low, high, at, a, z in tiles_of(len(own)):
                stop = min(len(own), at + max(TILE, 4 * high))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], pa.int64()) for x in (row, low, high, at, a, stop)] + [pa.array([number[a:z].tobytes()], pa.binary())],
                    names=["row", "low", "high", "own", "start", "stop", "words"])


def _solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row, low, high, own, start, stop, raw = (batch.column(c)[k].as_py() for c in range(7))
            ids = np.frombuffer(raw, "<u4")
            one = lambda x: np.array([x], np.int64)
            found = [(row, q, s + start, e + start) for _, q, s, e in
                     solve(ids, one(0), one(len(ids)), one(own - start), one(stop - start), one(-start), low, high)]
            columns = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "q", "s", "e"])


def stitch(fragments: DataFrame) -> DataFrame:
    """Fragments (row, q, s, e) of one document and period that overlap or touch become one."""
    order = Window.partitionBy("row", "q").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("new", F.when(F.coalesce(F.col("s") <= before, F.lit(False)), 0).otherwise(1))
    return (marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("row", "q", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island"))


def _collapse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        runs = [runs_of([(f["q"], f["s"], f["e"]) for f in own or ()]) for own in batch.column(2).to_pylist()]
        yield _results(batch.column(0), batch.column(1).to_pylist(), runs)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_chars: int = 1 << 15) -> DataFrame:
    """One row per row of ``docs``: id, ``runs`` (start, length, period of the maximal runs, by start, then period, counted in
    words from 0) and ``collapsed``, the words joined by one space without what a run holds after its first period.

    Words are runs of characters other than blank and tab to CR; two words are equal if a 64-bit hash of their bytes is.  A null
    or empty text has no words.  A run has its smallest period q, at least max(24, 3 q) words and cannot be extended.
    Ids may repeat or be null: every row is taken for itself.  Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    long = F.coalesce(F.length("text") > long_chars, F.lit(False))
    short = rows.filter(~long).mapInArrow(_whole, RESULT)
    kept = stored(rows.filter(long).withColumn("row", F.monotonically_increasing_id()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = kept.select("row", "text").mapInArrow(
        _explode, "row long, low long, high long, own long, start long, stop long, words binary")
    fragments = tiles.repartition(parts, "row", "low", "own").mapInArrow(_solve_tiles, "row long, q long, s long, e long")
    stretches = stitch(fragments).filter(f"e + q - s >= greatest({LEAST_LENGTH}, {LEAST_REPEATS} * q)") \
        .groupBy("row").agg(F.collect_list(F.struct("q", "s", "e")).alias("found"))
    joined = kept.join(stretches, "row", "left").select("id", "text", "found").mapInArrow(_collapse_rows, RESULT)
    return short.unionByName(joined).withColumnRenamed("id", id_col)


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = batch.column(1).to_pylist()
        for k, key in enumerate(batch.column(0).to_pylist()):
            h = zlib.crc32(str(key).encode())
            if key is None or h % 10 or not (own := (texts[k] or "").encode().split()):
                continue
            n, g = len(own), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            root = own[a:a + p]
            texts[k] = b" ".join(own[:a] + (root * (1 + (n - a) // p))[:n - a]).decode()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])


def plant_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with periodic endings in the documents whose crc32 h of the decimal id ends in 0 (a null id: none).

    With g = h div 10, n words, a = g mod n and p = 1 + (n - a) div (3 + g mod 8), word i >= a becomes word
    a + (i - a) mod p; the new text is the words joined by one space."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_plant, "id long, text string").toDF(id_col, text_col)


def run_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``periodic_runs``: id, number of runs, the run with the greatest exponent, digests of runs and collapsed text."""
    best = """aggregate(runs, cast(NULL AS struct<start:bigint,length:bigint,period:bigint>),
        (a, r) -> CASE WHEN a IS NULL OR r.length * a.period > a.length * r.period THEN r ELSE a END)"""
    out = found.withColumn("best", F.expr(best))
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return out.selectExpr(f"`{id_col}`", "cast(size(runs) AS long) AS n_runs", "best.start AS start", "best.length AS length",
                          "best.period AS period", "1000 * best.length div best.period AS exponent_milli",
                          f"sha2({lines}, 256) AS runs_sha256", "sha2(collapsed, 256) AS collapsed_sha256")
