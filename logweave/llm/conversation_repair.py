"""Repair of the turn structure of conversations by weighted interval parsing.

A repaired conversation has the role initials ``(s?(ua)+)?``.  The grammar is in Chomsky normal form: a nonterminal
(p, q) derives every edited stretch of rows that leads from state p to state q, by the rules (p, q) -> (p, r) (r, q), and by one row that
is kept, given another role or deleted.  Inserted turns derive nothing of the input; they are closed over
beforehand, so that a cell of one row already holds the insertions on both sides of it.  A cell is the cheapest
(cost, audit) of its span, the audit being the edits' initials (Delete, Insert, Keep, Rerole), ASCII-least among the
cheapest.  Two audits of equal cost over the same rows are never one the beginning of the other, so least parts make a
least whole.  As every state is a place where any derivation can be cut, a span's cells are the same from
each of its splits; the chart is therefore filled bottom-up by span lengths 1, 2, 4, ... with one split per span.

A conversation may hold any share of all rows: rows are range-partitioned in order, each task parses its
stretch of a conversation, and the few stretches of one conversation are joined by the same rule.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .tables import stored

BLANKS = " \t\n\x0b\x0c\r"
STATES = range(4)  # nothing yet, after the system turn, after a user turn, after an assistant turn
USER, ASSISTANT = "user", "assistant"
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
#: Spans of up to this many rows are parsed once per sequence of row kinds.
CACHED = 8

Cells = dict[tuple[int, int], tuple[int, str]]


def step(state: int, initial: str) -> int | None:
    """The state after a turn, or None if the turn may not stand there."""
    if initial == "s":
        return 1 if state == 0 else None
    if initial == "u":
        return None if state == 2 else 2
    return 3 if initial == "a" and state == 2 else None


def combine(left: Cells, right: Cells) -> Cells:
    """The cells of two neighbouring spans put together: (p, q) -> (p, r) (r, q)."""
    out: Cells = {}
    for (p, r), (a, first) in left.items():
        for q in STATES:
            if (r, q) in right:
                b, second = right[r, q]
                old = out.get((p, q))
                if old is None or a + b < old[0] or a + b == old[0] and first + second < old[1]:
                    out[p, q] = a + b, first + second
    return out


def _edges(cost: int, name: str, initials: str) -> Cells:
    return {(p, q): (cost, name) for p in STATES for c in initials if (q := step(p, c)) is not None}


def _closure() -> Cells:
    """Any number of insertions, none included."""
    out: Cells = {(p, p): (0, "") for p in STATES}
    for _ in STATES:
        for key, cell in combine(out, _edges(INSERT, "I", "ua")).items():
            out[key] = min(out.get(key, cell), cell)
    return out


CLOSURE = _closure()


@lru_cache(None)
def leaf(kind: str) -> Cells:
    """Cells of one row.  Kinds: role initial s, u, a or o (another), in upper case if cut off; x must be deleted."""
    out: Cells = {(p, p): (DELETE, "D") for p in STATES}
    if kind != "x":
        more = CUT_OFF * kind.isupper()
        for edges in (_edges(REROLE + more, "R", "ua"), _edges(more, "K", kind.lower())):
            out = {k: min(x for x in (out.get(k), edges.get(k)) if x) for k in out | edges}
    return combine(combine(CLOSURE, out), CLOSURE)


@lru_cache(1 << 16)
def _short(kinds: str) -> Cells:
    if len(kinds) == 1:
        return leaf(kinds)
    half = 1 << (len(kinds) - 1).bit_length() - 1
    return combine(_short(kinds[:half]), _short(kinds[half:]))


def parse(kinds: str) -> Cells:
    """Cells of a whole stretch of rows, given as one kind a row."""
    if not kinds:
        return CLOSURE
    row = [_short(kinds[k:k + CACHED]) for k in range(0, len(kinds), CACHED)]
    while len(row) > 1:
        row = [combine(*row[k:k + 2]) if k + 1 < len(row) else row[k] for k in range(0, len(row), 2)]
    return row[0]


def cheapest(cells: Cells) -> tuple[int, str]:
    """(cost, audit) of a whole conversation: from nothing to nothing or to an assistant turn."""
    return min(cells[0, q] for q in (0, 3) if (0, q) in cells)


def replay(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) turns; the audit and the states fix every new role."""
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = ASSISTANT if state == 2 else USER
        state = step(state, role[:1])
        yield role, text


PAIRS = [(p, q) for p in STATES for q in STATES]
STRETCH = "conv long, part long, first string, last string, illegal long, costs array<long>, audits array<string>"
LEGAL = {"su", "ua", "au"}


def _stretch_row(conv, part, kinds: list[str], initials: list[str]) -> dict:
    cells = parse("".join(kinds))
    return {"conv": conv, "part": part, "first": initials[0], "last": initials[-1],
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "costs": [cells[k][0] if k in cells else None for k in PAIRS],
            "audits": [cells[k][1] if k in cells else None for k in PAIRS]}


_STRETCH_TYPE = pa.schema([("conv", pa.int64()), ("part", pa.int64()), ("first", pa.string()), ("last", pa.string()),
                           ("illegal", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows (conv, kind, initial): one row per conversation of the partition."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    now, kinds, initials = None, [], []
    for batch in batches:
        out = []
        for conv, kind, initial in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if kinds and conv != now:
                out.append(_stretch_row(now, part, kinds, initials))
                kinds, initials = [], []
            now = conv
            kinds.append(kind)
            initials.append(initial)
        yield pa.RecordBatch.from_pylist(out, _STRETCH_TYPE)
    if kinds:
        yield pa.RecordBatch.from_pylist([_stretch_row(now, part, kinds, initials)], _STRETCH_TYPE)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by (conv, part): one row (conv, illegal, cost, audit) per conversation."""
    names = ["conv", "illegal", "cost", "audit"]
    schema = pa.schema([("conv", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
    held = None

    def done():
        return dict(zip(names, (held["conv"], held["illegal"], *cheapest(held["cells"]))))
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            cells = {k: (c, a) for k, c, a in zip(PAIRS, r["costs"], r["audits"]) if c is not None}
            if held is not None and held["conv"] == r["conv"]:
                held["illegal"] += r["illegal"] + (held["last"] + r["first"] not in LEGAL)
                held["cells"], held["last"] = combine(held["cells"], cells), r["last"]
            else:
                if held is not None:
                    out.append(done())
                held = {**r, "cells": cells}
        yield pa.RecordBatch.from_pylist(out, schema)
    if held is not None:
        yield pa.RecordBatch.from_pylist([done()], schema)


def _rows(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                       F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text) with reproducible faults, chosen by crc32 of ``conv:turn`` modulo 20: 0 drops a row, 1
    empties its text, 2 takes its full stops, exclamation and question marks away, 3 repeats it, 4 makes its role ``user``.
    Nulls of role and text, and those in the key, count as one space; null conversations and turns stay null."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")))
    out = _rows(rows, conv_col, turn_col, role_col, text_col).withColumn("fault", F.crc32(key) % 20).filter("fault <> 0")
    out = out.withColumn("text", F.expr("CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END")) \
        .withColumn("role", F.expr("CASE WHEN fault = 4 THEN 'user' ELSE role END")) \
        .withColumn("copy", F.explode(F.expr("CASE WHEN fault = 3 THEN array(0, 1) ELSE array(0) END")))
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col),
                      F.col("text").alias(text_col))


def repair_plans(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per conversation of ``rows``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows are taken by turn (nulls first), equal turns by role and digest of the text.  Null conversations are one
    conversation; a null role or text counts as one space.  A row's first fault counts: ``blank`` (no character but white
    space), ``duplicate`` (role and text as in an earlier row), ``truncated`` (last such character is no sentence end).
    ``gaps`` are the turns missing between the smallest and the largest; ``illegal`` neighbours have role initials other
    than su, ua and au.  Other columns are ignored.
    """
    spark = rows.sparkSession
    ship_package(spark)
    end = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    thin = _rows(rows, conv_col, turn_col, role_col, text_col).select(
        "conv", "turn", "role", F.unhex(F.md5("text")).alias("digest"), end.alias("end"))
    same = Window.partitionBy("conv", "role", "digest").orderBy("turn")
    thin = thin.withColumn("fault", F.expr("CASE WHEN end = '' THEN 1 ELSE 0 END")) \
        .withColumn("fault", F.when((F.col("fault") == 0) & (F.row_number().over(same) > 1), 2).otherwise(F.col("fault"))) \
        .withColumn("fault", F.expr("CASE WHEN fault = 0 AND end NOT IN ('.', '!', '?') THEN 3 ELSE fault END"))
    thin = stored(thin.withColumn("initial", F.substring("role", 1, 1)).withColumn("kind", F.expr(
        "CASE WHEN fault IN (1, 2) THEN 'x' ELSE translate(CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END, "
        "CASE WHEN fault = 3 THEN 'suao' ELSE '' END, CASE WHEN fault = 3 THEN 'SUAO' ELSE '' END) END")).drop("end"))
    count = [F.count(F.when(F.col("fault") == k, 1)).alias(name) for k, name in enumerate(("blank", "duplicate", "truncated"), 1)]
    totals = thin.groupBy("conv").agg(*count)
    gaps = (thin.filter("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv")
            .agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", "turn", "role", "digest"]
    parsed = (thin.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv", "kind", "initial")
              .mapInArrow(_stretches, STRETCH).repartition(parts, "conv").sortWithinPartitions("conv", "part")
              .mapInArrow(_joined, "conv long, illegal long, cost long, audit string"))
    # nulls are a conversation too: an outer key that is never null
    key = F.struct(F.col("conv").isNull().alias("n"), F.coalesce("conv", F.lit(0)).alias("c")).alias("key")
    return (parsed.withColumn("key", key).join(totals.withColumn("key", key).drop("conv"), "key")
            .join(gaps.withColumn("key", key).drop("conv"), "key", "left")
            .select("conv", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"))


_TURN = pa.schema([("conv", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, head, role, text) with the audit as text of each conversation's head, which comes first."""
    def flat():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in range(4)))
    rows, ahead = flat(), []

    def own():
        while True:
            row = ahead.pop() if ahead else next(rows, None)
            if row is None or row[1] == 0:
                ahead.append(row)
                return
            yield row[2:]

    out, size, head = [], 0, next(rows, None)
    while head is not None:
        for place, (role, text) in enumerate(replay(head[3], own())):
            out.append({"conv": head[0], "place": place, "role": role, "text": text})
            size += len(text) + 64
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(out, _TURN)
                out, size = [], 0
        for _ in own():  # deleted rows at the end have been read already
            pass
        head = ahead.pop() if ahead else next(rows, None)
    yield pa.RecordBatch.from_pylist(out, _TURN)


def repaired_turns(rows: DataFrame, plans: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns (conv, place, role, text) that the audits of ``repair_plans`` leave, each conversation in one partition and
    in order.  A conversation's texts stream through a task; only its audit is held."""
    spark = rows.sparkSession
    body = _rows(rows, conv_col, turn_col, role_col, text_col).select(
        "conv", F.lit(1).alias("head"), "role", "text", "turn", F.md5("text").alias("digest"))
    heads = plans.select("conv", F.lit(0).alias("head"), F.lit("").alias("role"), F.col("audit").alias("text"),
                         F.lit(None).cast("long").alias("turn"), F.lit("").alias("digest"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (body.unionByName(heads).repartition(parts, "conv")
            .sortWithinPartitions("conv", "head", "turn", "role", "digest").select("conv", "head", "role", "text")
            .mapInArrow(_replayed, "conv long, place long, role string, text string"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, sha = None, None
    schema = pa.schema([("conv", pa.int64()), ("repaired_sha256", pa.string())])
    for batch in batches:
        out = []
        for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if place == 0:
                if sha is not None:
                    out.append({"conv": now, "repaired_sha256": sha.hexdigest()})
                now, sha = conv, hashlib.sha256()
            sha.update(f"{chr(10) * (place > 0)}{role}:{text}".encode())
        yield pa.RecordBatch.from_pylist(out, schema)
    if sha is not None:
        yield pa.RecordBatch.from_pylist([{"conv": now, "repaired_sha256": sha.hexdigest()}], schema)


def repair_digest(original: DataFrame, rows: DataFrame, conv_col: str = "conv_id", **columns) -> DataFrame:
    """Per conversation of ``original``: its plan over ``rows`` and the digest of the repaired turns; zeros, an empty
    audit and the digest of nothing where ``rows`` has none."""
    plans = stored(repair_plans(rows, conv_col, **columns))
    hashes = repaired_turns(rows, plans, conv_col, **columns).mapInArrow(_hashed, "conv long, repaired_sha256 string")
    key = F.struct(F.col("conv").isNull().alias("n"), F.coalesce("conv", F.lit(0)).alias("c")).alias("key")
    every = original.select(F.col(conv_col).cast("long").alias("conv")).distinct().withColumn("key", key)
    out = every.join(plans.withColumn("key", key).drop("conv"), "key", "left") \
        .join(hashes.withColumn("key", key).drop("conv"), "key", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(F.col("conv").alias(conv_col), *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
