"""Plan fragments a step compiles to.

A step never touches data itself; it describes *what* to attach and the
interpreter (``plans.chain``) decides how: row-wise expressions become one
``withColumns``, group statistics are aggregated on a join-free frame and
joined back (fused per key set), ordered-group features go through one
segmented scan per (keys, time, target).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame


@dataclass
class RowOp:
    inputs: list[str]
    assigns: list[tuple[str, Column]]
    pre: list[tuple[str, Column]] = field(default_factory=list)  # temporaries, dropped after


@dataclass
class GroupOp:
    inputs: list[str]
    sig: tuple
    keys: list[Column]
    aggs: list[tuple[str, Column]]
    outputs: list[tuple[str, Callable[[Callable[[str], Column]], Column]]]


@dataclass
class GlobalOp:
    inputs: list[str]
    aggs: list[tuple[str, Column]]
    outputs: list[tuple[str, Callable[[Callable[[str], Column]], Column]]]


@dataclass
class ScanOp:
    inputs: list[str]
    keys: list[str]
    time_col: str
    target: str | None
    bucket_minutes: int | None
    outputs: list[tuple[str, str]]  # (output name, kind)

    @property
    def sig(self) -> tuple:
        # one scan serves every target / bucket width over the same (keys, time)
        return (tuple(self.keys), self.time_col)


@dataclass
class CodeOp:
    inputs: list[str]
    column: str
    output: str


@dataclass
class FrameOp:
    inputs: list[str]
    fn: Callable[[DataFrame], DataFrame]
    row_changing: bool = False
    apply_to_pure: bool = False
    renames: dict[str, str] = field(default_factory=dict)
