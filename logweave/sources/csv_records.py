"""CSV records with line breaks in cells, read from every split of a file at once (SRC-1).

A split begins in the middle of a file, and whether its first line starts a record depends on the quotes before it.  So
each split is first read under both assumptions, outside and inside a quoted cell: that gives a map from its state
at the start to its state at the end.  A scan over these maps, one row per split, fixes the states; then every split
cuts its own records, and the few that cross a split's edge are put together from their fragments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Complete fields, then a quoted one without its end.  Possessive, so that no line is read twice.
_OPEN = re.compile(r'(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^,"][^,]*+)?+,)*+"(?:[^"]++|"")*+\Z')


def stays_open(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open after a line that starts outside or inside one."""
    if '"' not in line:
        return inside
    return _OPEN.match('"' + line if inside else line) is not None


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """(path, block start, lines) for each stretch of lines of one block."""
    at = 0
    paths, starts = batch.column(1), batch.column(2)
    while at < batch.num_rows:
        same = pc.and_(pc.equal(starts.slice(at), starts[at]), pc.equal(paths.slice(at), paths[at]))
        end = pc.index(same, False).as_py()
        end = batch.num_rows - at if end < 0 else end
        yield paths[at].as_py(), starts[at].as_py(), batch.column(0).slice(at, end)
        at += end


def _quoted(lines: pa.Array) -> bool:
    return bool(pc.any(pc.match_substring(lines, '"')).as_py())


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, [False, True]
    done = []
    for batch in batches:
        for path, start, lines in _runs(batch):
            if (path, start) != now:
                if now is not None:
                    done.append((*now, *state))
                now, state = (path, start), [False, True]
            if _quoted(lines):
                for line in lines.to_pylist():
                    if '"' in line:
                        state = [stays_open(line, s) for s in state]
    if now is not None:
        done.append((*now, *state))
    columns = list(zip(*done)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.bool_()))],
                                     names=["path", "start", "from_outside", "from_inside"])


def _scan(pdf):
    """The state at the start of each split of one file."""
    pdf = pdf.sort_values("start")
    state, out = False, []
    for outside, inside in zip(pdf["from_outside"], pdf["from_inside"]):
        out.append(state)
        state = bool(inside if state else outside)
    return pd.DataFrame({"path": pdf["path"], "start": pdf["start"], "inside": out})


_RECORD = "path string, start long, seq long, opens boolean, closes boolean, head boolean, record string"


def _cut(inside_starts):
    """Records and fragments of each block: ``opens`` if the record starts here, ``closes`` if it ends here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, held, open_, opens, before_head = None, 0, [], False, True, False

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal before_head
            heads = [False] * len(rows)
            if before_head:  # the first record of a file that is not empty is its header
                at = next((k for k, r in enumerate(rows) if r[3] not in ("", "\r")), None)
                if at is not None:
                    heads[at], before_head = True, False
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]] * len(rows), pa.string()), pa.array([now[1]] * len(rows), pa.int64()), pa.array(columns[0], pa.int64()),
                 pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.bool_()), pa.array(heads, pa.bool_()), pa.array(columns[3], pa.string())],
                names=["path", "start", "seq", "opens", "closes", "head", "record"])
        for batch in batches:
            for path, start, lines in _runs(batch):
                if (path, start) != now:
                    if held:
                        yield batch_of([(seq, opens, False, "\n".join(held))])
                    now, seq, held, before_head = (path, start), 0, [], start == 0
                    open_ = now in inside_starts.value
                    opens = not open_
                rows: list[tuple] = []
                if not open_ and not _quoted(lines):
                    rows = [(seq + k, True, True, line) for k, line in enumerate(lines.to_pylist())]
                    seq += len(rows)
                else:
                    for line in lines.to_pylist():
                        open_ = stays_open(line, open_)
                        held.append(line)
                        if not open_:
                            rows.append((seq, opens, True, "\n".join(held)))
                            held, opens, seq = [], True, seq + 1
                if rows:
                    yield batch_of(rows)
        if held:
            yield batch_of([(seq, opens, False, "\n".join(held))])
    return run


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("path"),
                                                      F.col("_metadata.file_block_start").alias("start"))


def csv_records(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """(path, start, seq, head, record) of all records, ``head`` marking each file's header, and the first file's name.

    ``start`` and ``seq`` give the order within a file.  A record ends at a line feed outside of quoted cells (a carriage return
    before it belongs to the end); cells may hold line breaks, separators and doubled quotes.  Empty records are left
    out.  What the driver and the tasks hold is one row per split that begins inside a cell."""
    lines = _lines(spark, path)
    states = lines.mapInArrow(_states, "path string, start long, from_outside boolean, from_inside boolean") \
        .groupBy("path").applyInPandas(_scan, "path string, start long, inside boolean")
    found = states.groupBy("inside").agg(F.min("path").alias("first"), F.collect_list(F.when(F.col("inside"), F.struct("path", "start")))
                                         .alias("starts")).collect()
    inside = spark.sparkContext.broadcast({(s["path"], s["start"]) for r in found for s in r["starts"]})
    cut = lines.mapInArrow(_cut(inside), _RECORD)
    whole = cut.where("opens AND closes").select("path", "start", "seq", "head", "record")
    if inside.value:
        order = Window.partitionBy("path").orderBy("start", "seq")
        numbered = cut.where("NOT (opens AND closes)").withColumn("number", F.sum(F.col("opens").cast("long")).over(order))
        joined = numbered.groupBy("path", "number").agg(F.sort_array(F.collect_list(F.struct("start", "seq", "head", "record"))).alias("parts"))
        whole = whole.unionByName(joined.select("path", F.col("parts")[0]["start"].alias("start"), F.col("parts")[0]["seq"].alias("seq"), F.col("parts")[0]["head"].alias("head"),
                                                F.array_join("parts.record", "\n").alias("record")))
    else:  # a cell that is never closed ends with its file
        whole = whole.unionByName(cut.where("opens AND NOT closes").select("path", "start", "seq", "head", "record"))
    whole = whole.withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    return whole.where("record <> ''"), min((r["first"] for r in found), default=None)


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, open_ = [], False
    for batch in batches:
        for line in batch.column(0).to_pylist():
            open_ = stays_open(line, open_)
            held.append(line)
            if not open_:
                text = "\n".join(held).removesuffix("\r")
                held = []
                if text:
                    yield pa.RecordBatch.from_pydict({"record": [text]})
                    return
    if held:
        yield pa.RecordBatch.from_pydict({"record": ["\n".join(held)]})


def header_record(spark: SparkSession, file: str) -> str | None:
    """The first record of one file; its first split is read up to there."""
    escaped = re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file))
    found = _lines(spark, escaped).where("start = 0").select("value").mapInArrow(_first, "record string").take(1)
    return found[0]["record"].removeprefix("﻿") if found else None
