"""Regex character classes that reproduce Python's ``str`` predicates.

Python's ``str.isdigit`` / ``str.isspace`` / ``\\w`` differ from Java's and
RE2's built-in classes, so the exact code-point sets are derived from the
interpreter's Unicode database by rule (not transcribed) and rendered with
``\\x{...}`` escapes, a syntax both Java regex and RE2 (DuckDB) accept.
"""

from __future__ import annotations

import functools
import sys


def _ranges(codepoints: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for cp in codepoints:
        if out and cp == out[-1][1] + 1:
            out[-1] = (out[-1][0], cp)
        else:
            out.append((cp, cp))
    return out


def _render(ranges: list[tuple[int, int]]) -> str:
    parts = []
    for lo, hi in ranges:
        parts.append(f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}")
    return "".join(parts)


@functools.lru_cache(maxsize=None)
def space_body() -> str:
    """Body (no brackets) of the class of chars with ``str.isspace()``."""
    return _render(_ranges([c for c in range(sys.maxunicode + 1) if chr(c).isspace()]))


@functools.lru_cache(maxsize=None)
def digit_extra_body() -> str:
    """Chars with ``isdigit()`` but not ``isdecimal()`` (superscripts, circled digits...)."""
    return _render(_ranges([c for c in range(sys.maxunicode + 1)
                            if chr(c).isdigit() and not chr(c).isdecimal()]))


def digit_class() -> str:
    return f"[\\p{{Nd}}{digit_extra_body()}]"


def alpha_class() -> str:
    # str.isalpha == Unicode general category L*
    return "[\\p{L}]"


def upper_class(engine: str = "spark") -> str:
    # str.isupper on one char == Unicode "Uppercase" property; Java exposes it,
    # RE2 only has the general category Lu.
    return "[\\p{IsUppercase}]" if engine == "spark" else "[\\p{Lu}]"


def space_class() -> str:
    return f"[{space_body()}]"


def alnum_or_space_class() -> str:
    # complement of the reference's "special" predicate (not isalnum and not isspace)
    return f"[\\p{{L}}\\p{{N}}{space_body()}]"


def word_class_body() -> str:
    # Python's Unicode \w: isalnum() or '_'
    return "\\p{L}\\p{N}_"
