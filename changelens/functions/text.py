"""Python string semantics as Spark column expressions.

The metrics are defined in terms of Python's ``str.splitlines``,
``str.strip`` and ``str.split``.  The character sets below are derived
from Python itself (by rule, not by a hand-written table), so the Spark
expressions split and trim exactly where Python does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters for which Python's str.isspace() is true.
WS_CHARS = "".join(ch for ch in map(chr, range(0x10000)) if ch.isspace())
# Characters on which Python's str.splitlines() breaks ("\r\n" counts once).
LINE_BREAK_CHARS = "".join(
    ch for ch in map(chr, range(0x10000)) if len(("a" + ch + "b").splitlines()) == 2)


def _cls(chars: str) -> str:
    """Regex character class; \\x{..} escapes work in Java and RE2."""
    return "[" + "".join("\\x{%X}" % ord(c) for c in chars) + "]"


WS_CLASS = _cls(WS_CHARS)
LINE_SPLIT_RE = "\\r\\n|" + _cls(LINE_BREAK_CHARS)
_OTHER_BREAKS = LINE_BREAK_CHARS.replace("\n", "")
_NON_SPACE_WS = WS_CHARS.replace(" ", "")
# every line break is also whitespace, so no token spans two lines
assert set(LINE_BREAK_CHARS) <= set(WS_CHARS)


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines(c) -> Column:
    """``c.splitlines()``: split on every break, drop one trailing empty part.

    "\r\n" is folded to "\n" and every other break character is translated
    to "\n", so the split is a single-character split (no regex engine)."""
    folded = F.translate(F.replace(as_col(c), F.lit("\r\n"), F.lit("\n")), _OTHER_BREAKS,
                         "\n" * len(_OTHER_BREAKS))
    parts = F.split(folded, "\n", -1)
    return F.when(F.element_at(parts, -1) == F.lit(""),
                  F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(c) -> Column:
    """``c.strip()`` with Python's whitespace set (a char-set trim, no regex)."""
    return F.btrim(as_col(c), F.lit(WS_CHARS))


def is_blank(c) -> Column:
    return strip(c) == F.lit("")


def tokens(c) -> Column:
    """``c.split()``: every whitespace character becomes a space, the text
    is split on single spaces and the empty pieces are removed."""
    spaced = F.translate(as_col(c), _NON_SPACE_WS, " " * len(_NON_SPACE_WS))
    return F.array_remove(F.split(spaced, " ", -1), F.lit(""))


def count_sub(c, sub: str) -> Column:
    """``c.count(sub)``: non-overlapping occurrences of a literal.

    Removing k occurrences removes k * bytes(sub) bytes, and byte lengths
    are O(1) on Spark strings (character lengths need a scan)."""
    c = as_col(c)
    return ((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(sub), F.lit("")))) /
            F.lit(len(sub.encode("utf-8")))).cast("long")


def contains(c, sub: str) -> Column:
    return F.instr(as_col(c), sub) > 0


def indent(c) -> Column:
    """``len(l) - len(l.lstrip(' '))``: leading spaces only."""
    c = as_col(c)
    return F.length(c) - F.length(F.ltrim(c))


def safe_div(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)
