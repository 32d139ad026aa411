"""Row-wise text features (FTR-3..11, PRE-6/7).

Lengths, tokens, keyword and regex counts and pattern flags are JVM expressions
(whole-stage codegen).  Character statistics (entropy, unique characters,
composition) come from one Arrow-batched pass per text (:func:`char_profile`).
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import charclass as cc

# Fixed values that must equal the reference: the token pattern and the
# pattern-flag library (names and regexes, Python syntax).
PATTERN_LIBRARY: dict[str, str] = {
    "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "url": r"https?://[^\s]+",
    "hash": r"\b[a-fA-F0-9]{32,64}\b",
    "hex_like": r"\b(?:0x)?[a-fA-F0-9]{8,}\b",
    "base64_like": r"\b[A-Za-z0-9+/]{16,}={0,2}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
}
PATTERN_CASE_INSENSITIVE = {"url"}


def _s(c: Column) -> Column:
    return c.cast("string")


def token_regex() -> str:
    """A token: one or more of Python word characters, '-', '.', ':' or '/'."""
    return f"[{cc.word_class_body()}\\-.:/]+"


def text_length(c: Column) -> Column:
    """Code points; null stays null."""
    return F.length(_s(c)).cast("long")


def byte_length(c: Column) -> Column:
    """UTF-8 bytes; null counts as empty."""
    return F.octet_length(F.coalesce(_s(c), F.lit(""))).cast("long")


def token_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(_s(c), F.lit("")), F.lit(token_regex())).cast("long")


def keyword_count(c: Column, keywords: list[str]) -> Column:
    """Sum of non-overlapping, case-insensitive literal occurrences."""
    kws = [str(k).lower() for k in keywords if str(k).strip()]
    t = F.lower(F.coalesce(_s(c), F.lit("")))
    total = F.lit(0).cast("long")
    for k in kws:
        occ = (F.length(t) - F.length(F.replace(t, F.lit(k), F.lit("")))) / F.lit(len(k))
        total = total + occ.cast("long")
    return total


CHAR_PROFILE_SCHEMA = T.StructType([T.StructField(n, T.DoubleType() if n == "entropy" else T.LongType())
                                     for n in ("n", "entropy", "uniq", "digit", "alpha", "upper", "space", "alnum")])


#: Characters counted at once.
PIECE = 1 << 19


def _stretches(lengths: list[int]):
    """Stretches of texts (first, end) with at most ``PIECE`` characters together; a longer text is one of its own."""
    first, total = 0, 0
    for k, n in enumerate(lengths):
        if k > first and total + n > PIECE:
            yield first, k
            first, total = k, 0
        total += n
    if len(lengths) > first:
        yield first, len(lengths)


def _cells(strings: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number << 21 | code point, ascending, and how often each occurs; a long text is counted in pieces."""
    joined, ends = "".join(strings), np.cumsum(n)
    cells, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(joined), PIECE):
        points = np.frombuffer(joined[at:at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.searchsorted(ends, np.arange(at, at + len(points)), "right")
        more, times = np.unique(owner << 21 | points, return_counts=True)
        cells, back = np.unique(np.concatenate([cells, more]), return_inverse=True)
        count = np.bincount(back, np.concatenate([count, times]), len(cells)).astype(np.int64)
    return cells, count


def _profile(strings: list[str]) -> pd.DataFrame:
    n = np.array([len(t) for t in strings], np.int64)
    cells, count = _cells(strings, n)
    row = cells >> 21
    chars, which = np.unique(cells & 0x1FFFFF, return_inverse=True)
    share = count / n[row]

    def total(weights):
        return np.bincount(row, weights, len(n))
    out = {"n": n, "entropy": total(-share * np.log2(share)), "uniq": np.bincount(row, minlength=len(n))}
    for name, test in (("digit", str.isdigit), ("alpha", str.isalpha), ("upper", str.isupper), ("space", str.isspace),
                       ("alnum", str.isalnum)):
        flag = np.array([test(chr(c)) for c in chars], bool)
        out[name] = total(count * flag[which]).astype(np.int64) if len(chars) else np.zeros(len(n), np.int64)
    return pd.DataFrame(out)


@F.pandas_udf(CHAR_PROFILE_SCHEMA)
def _char_profile(texts: pd.Series) -> pd.DataFrame:
    """Counts per (text, character), a stretch of texts at a time; Python's own ``str``
    predicates are asked once per distinct character of a stretch."""
    strings = ["" if t is None else t for t in texts]
    parts = [_profile(strings[a:b]) for a, b in _stretches([len(t) for t in strings])]
    return pd.concat(parts, ignore_index=True) if parts else _profile([])


def char_profile(c: Column) -> Column:
    """Struct of per-text character statistics (see :data:`CHAR_PROFILE_SCHEMA`)."""
    return _char_profile(c.cast("string"))


def entropy_from_profile(p: Column) -> Column:
    return F.when(p["n"] == 0, F.lit(0.0)).otherwise(p["entropy"])


def composition_from_profile(p: Column) -> dict[str, Column]:
    n = p["n"].cast("double")

    def ratio(cnt):
        return F.when(p["n"] == 0, F.lit(0.0)).otherwise(cnt.cast("double") / n)

    return {"digit_ratio": ratio(p["digit"]), "alpha_ratio": ratio(p["alpha"]), "upper_ratio": ratio(p["upper"]),
            "whitespace_ratio": ratio(p["space"]),
            # no character is both alphanumeric and whitespace in Python's tables
            "special_ratio": ratio(p["n"] - p["alnum"] - p["space"])}


def unique_from_profile(p: Column) -> dict[str, Column]:
    return {"unique_char_count": p["uniq"].cast("long"),
            "unique_char_ratio": F.when(p["n"] == 0, F.lit(0.0)).otherwise(p["uniq"].cast("double") / p["n"])}


_W = "\\p{L}\\p{N}_"


def py_regex_to_java(pattern: str) -> str:
    """Give Python's Unicode meaning to ``\\b \\B \\d \\D \\w \\W \\s \\S`` in a Java pattern.

    Python's word class is letters + numbers + '_' (no combining marks), its
    digits are decimal digits and its spaces follow ``str.isspace``; Java's
    (?U) classes differ slightly, so the escapes are spelled out.
    """
    sp = cc.space_body()
    inside = {"d": "\\p{Nd}", "w": _W, "s": sp}
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if in_class and nxt in inside:
                out.append(inside[nxt])
            elif in_class and nxt in "DWS":
                raise ValueError("negated class escape inside a character class is not supported")
            elif not in_class and nxt in "dws":
                out.append(f"[{inside[nxt]}]")
            elif not in_class and nxt in "DWS":
                out.append(f"[^{inside[nxt.lower()]}]")
            elif not in_class and nxt == "b":
                out.append(f"(?:(?<=[{_W}])(?![{_W}])|(?<![{_W}])(?=[{_W}]))")
            elif not in_class and nxt == "B":
                out.append(f"(?:(?<=[{_W}])(?=[{_W}])|(?<![{_W}])(?![{_W}]))")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
            out.append(ch)
            if pattern[i + 1:i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1:i + 2] == "]":
                out.append("\\]")
                i += 1
        elif ch == "]" and in_class:
            in_class = False
            out.append(ch)
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def java_regex(pattern: str, case_insensitive: bool = True) -> str:
    """Python-`re` str pattern -> Java pattern with Python's Unicode classes (and optional (?i))."""
    flags = "iu" if case_insensitive else "u"
    return f"(?{flags}){py_regex_to_java(pattern)}"


def regex_match_count(c: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(_s(c), F.lit("")), F.lit(java_regex(pattern))).cast("long")


def _relaxed(pattern: str) -> str:
    """The pattern without word-boundary assertions: a cheap necessary condition."""
    return pattern.replace("\\b", "").replace("\\B", "")


def pattern_flag(c: Column, name: str) -> Column:
    pat = PATTERN_LIBRARY[name]
    ci = name in PATTERN_CASE_INSENSITIVE
    exact = _s(c).rlike(java_regex(pat, case_insensitive=ci))
    if "\\b" in pat or "\\B" in pat:
        # the lookaround-free superset rejects most texts before the exact regex runs
        exact = F.when(_s(c).rlike(java_regex(_relaxed(pat), case_insensitive=ci)), exact).otherwise(F.lit(False))
    return F.coalesce(exact, F.lit(False)).cast("long")


def py_strip(c: Column) -> Column:
    """Python ``str.strip()`` (all Unicode whitespace as Python defines it)."""
    body = cc.space_body()
    return F.regexp_replace(_s(c), F.lit(f"^[{body}]+|[{body}]+$"), F.lit(""))


def contains_ci(c: Column, pattern: str) -> Column:
    """pandas ``str.contains(pattern, case=False)``: a case-insensitive regex search."""
    return _s(c).rlike(java_regex(str(pattern)))
