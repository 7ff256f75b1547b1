"""String helpers as Column -> Column functions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes every character for which str.isspace() is true;
# Spark's trim() only removes blanks.  The set is derived from that rule and
# handed to btrim (codegen'd, no regex).
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """``str.strip()`` semantics."""
    return F.btrim(col_of(c), F.lit(PY_WHITESPACE))


def norm(c: Column | str) -> Column:
    """Trim-to-empty: null -> '', else stripped text."""
    return F.coalesce(strip(c), F.lit(""))


def blank_to_null(c: Column | str) -> Column:
    """Stripped text, or null when blank."""
    return F.nullif(strip(c), F.lit(""))


def surrogate_key(c: Column | str) -> Column:
    """Stable 8-hex key: first 8 hex digits of md5 of the stripped name; null for blank."""
    s = blank_to_null(c)
    return F.when(s.isNotNull(), F.substring(F.md5(s), 1, 8))


def venue_key(c: Column | str) -> Column:
    """Normal form of a venue name: lower case, runs of non [a-z0-9] -> one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(col_of(c)), "[^a-z0-9]+", " "))


def first_integer(c: Column | str) -> Column:
    """First integer in the text, thousands commas allowed (``33,108 (approx)`` -> 33108)."""
    digits = F.regexp_replace(F.regexp_extract(col_of(c), r"(\d[\d,]*)", 1), ",", "")
    return F.when(digits != "", digits.try_cast("int"))
