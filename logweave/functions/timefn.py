"""Date/time helpers (FTR-2, PRE-5/8, bucket arithmetic for TWN-*).

A text's shape (digit runs as ``0``, letter runs as ``a``, the rest as it is) tells which layouts can fit it, so a
text is parsed by the one or two layouts of its shape and by none if it has the shape of no layout.

Time arithmetic is done on epoch microseconds; buckets floor relative to the
epoch (as pandas ``dt.floor`` does), never with ``F.window`` (which drops null
times).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text layouts tried after Spark's own ISO parsing, in order (month first where a text fits both ways).
_CLOCK = "[ H:mm[:ss[.SSSSSS]]]"
TEXT_TIME_LAYOUTS = [
    *(f"{day}{_CLOCK}" for day in ("yyyy/M/d", "yyyy.M.d", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "d-MMM-yyyy",
                                   "d MMM yyyy", "d MMMM yyyy", "MMM d[,] yyyy", "MMMM d[,] yyyy")),
    "yyyy-M-d H:mm:ss,SSSSSS",
    "dd/MMM/yyyy:HH:mm:ss Z",
    "d MMM yyyy H:mm:ss Z",
    "MMM d H:mm:ss yyyy",
    *(f"{day} h:mm[:ss] a" for day in ("yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy")),
    "yyyyMMdd['T'HHmmss]",
    "yyyyMMddHHmmss",
]
#: Years that a nanosecond timestamp can hold; other bare numbers (ports, ids) are no dates.
_YEAR = r"(?:167[89]|16[89]\d|1[789]\d\d|2[01]\d\d|22[0-5]\d|226[0-2])"
ISO_TEXT = rf"(?s)^\s*(?:{_YEAR}(?:-.*|\s*)|T?\d{{1,2}}:.*)$"
DATED_TEXT = rf"(?:^|\D){_YEAR}"
WEEKDAY = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? "

# strftime directive -> Java DateTimeFormatter letters.
STRFTIME_TO_JAVA = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm",
    "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE",
    "j": "DDD", "z": "Z", "Z": "z",
}


def strftime_to_java(fmt: str) -> str:
    out: list[str] = []
    literal: list[str] = []

    def flush():
        if literal:
            text = "".join(literal).replace("'", "''")
            out.append(f"'{text}'" if any(ch.isalpha() for ch in text) else text)
            literal.clear()

    i = 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "%" and i + 1 < len(fmt):
            d = fmt[i + 1]
            if d == "%":
                literal.append("%")
            elif d in STRFTIME_TO_JAVA:
                flush()
                out.append(STRFTIME_TO_JAVA[d])
            else:
                raise ValueError(f"unsupported strftime directive %{d}")
            i += 2
            continue
        literal.append(ch)
        i += 1
    flush()
    return "".join(out)


def _layout_shapes(layout: str) -> set[str]:
    """The shapes of the texts that a layout can fit, one for each choice of its optional parts."""
    optional = re.search(r"\[([^\[\]]*)\]", layout)
    if optional:
        before, after = layout[:optional.start()], layout[optional.end():]
        return _layout_shapes(before + optional.group(1) + after) | _layout_shapes(before + after)
    letters = re.sub(r"'[^']*'|MMMM?|a", "\0", layout)
    zones = [letters.replace("Z", sign + "mmmm") for sign in "+-"] if "Z" in letters else [letters]
    digits = (re.sub(r"[yMdHhmsS]+", lambda run: "0" * max(len(run.group()), 1), z) for z in zones)
    return {re.sub(SHORT_RUN, "0", d).replace("\0", "a") for d in digits}


#: A run of digits that is no compact date; its length is no part of a shape.
SHORT_RUN = r"(?<!0)0{1,7}(?!0)"
#: Layouts by the shapes they can fit; the sets of any two families are disjoint, a family's layouts are tried in order.
LAYOUT_FAMILIES: dict[frozenset[str], list[str]] = {}
for _layout in TEXT_TIME_LAYOUTS:
    LAYOUT_FAMILIES.setdefault(frozenset(_layout_shapes(_layout)), []).append(_layout)


def text_shape(c: Column) -> Column:
    """``03/Apr/2024 9:15`` has the shape ``0/a/0 0:0``; runs of eight digits or more keep their length."""
    zeros = F.translate(F.regexp_replace(c, "[A-Za-z]+", "a"), "123456789", "000000000")
    return F.regexp_replace(zeros, SHORT_RUN, "0")


def to_timestamp_any(c: Column, dtype: T.DataType | None = None, fmt: str | None = None) -> Column:
    """Coerce any column to TIMESTAMP like ``pd.to_datetime(errors='coerce')``, each row on its own.

    A text is an ISO date, one of ``TEXT_TIME_LAYOUTS`` (a weekday before it is skipped), or null."""
    if isinstance(dtype, T.TimestampType):
        return c
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    if isinstance(dtype, T.NumericType) and not isinstance(dtype, T.BooleanType):
        # pandas reads bare numbers as epoch nanoseconds
        return F.timestamp_micros(F.floor(c.try_cast("double") / 1000).cast("long"))
    s = c.cast("string")
    if fmt:
        return F.try_to_timestamp(s, F.lit(strftime_to_java(fmt)))
    # lambdas keep one copy of the input and of the layouts out of the generated code
    # white space around and between the parts does not count; no layout is longer than 64 characters without it
    dated = F.filter(F.array(s), lambda x: x.rlike(DATED_TEXT))
    single = F.filter(F.transform(dated, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: F.length(x) <= 64)
    plain = F.transform(single, lambda x: F.regexp_replace(x, WEEKDAY, ""))
    # a family's shapes are one literal: a list of them for every column makes wide plans slow to compile
    shaped = F.transform(plain, lambda x: F.struct(x.alias("text"), F.concat(F.lit("|"), text_shape(x), F.lit("|")).alias("shape")))
    parsed = F.transform(shaped, lambda x: F.coalesce(*[
        F.when(F.lit("|".join(["", *sorted(shapes), ""])).contains(x["shape"]),
               F.coalesce(*[F.try_to_timestamp(x["text"], F.lit(layout)) for layout in layouts]))
        for shapes, layouts in LAYOUT_FAMILIES.items()]))
    return F.coalesce(F.when(s.rlike(ISO_TEXT), s.try_cast("timestamp")), F.get(parsed, F.lit(0)))


def epoch_micros(c: Column, dtype: T.DataType | None = None) -> Column:
    return F.unix_micros(to_timestamp_any(c, dtype))


def bucket_id(micros: Column, minutes: int) -> Column:
    width = int(minutes) * 60 * 1_000_000
    return F.floor(micros / F.lit(width)).cast("long")


def bucket_start(micros: Column, minutes: int) -> Column:
    return F.timestamp_seconds(bucket_id(micros, minutes) * int(minutes) * 60)


def time_parts(ts: Column) -> dict[str, Column]:
    dow = F.weekday(ts).cast("long")
    return {
        "hour": F.hour(ts).cast("long"),
        "dayofweek": dow,
        "is_weekend": F.coalesce((dow >= 5).cast("long"), F.lit(0).cast("long")),
    }
