"""String helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .safe import col_


# The characters Python's str.strip() removes (str.isspace()):
# tab, line feed, vertical tab, form feed, carriage return, the separators
# U+001C to U+001F, space, U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028,
# U+2029, U+202F, U+205F and U+3000.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
              + "".join(chr(c) for c in range(0x2000, 0x200B))
              + "\u2028\u2029\u202f\u205f\u3000")


def strip_ws(c: Column | str) -> Column:
    """Remove leading and trailing whitespace of any kind (G9), like Python's
    ``str.strip()``.  ``trim`` alone removes spaces only; ``btrim`` with the
    explicit set avoids a Unicode regex per value."""
    return F.btrim(col_(c), F.lit(WHITESPACE))


def signed_pct_text(frac: Column | str, places: int = 1) -> Column:
    """Fraction -> text like ``+12.3%``; empty string for NULL (W10 display)."""
    x = col_(frac).cast("double") * 100
    body = F.format_string(f"%+.{places}f%%", F.bround(x, places))
    return F.when(x.isNull(), F.lit("")).otherwise(body)


#: What a part of a date or time pattern can read, at least.
_SHAPES = {"yyyy": "[+-]?[0-9]{4,}", "MM": "[0-9]{2}", "dd": "[0-9]{2}", "HH": "[0-9]{2}", "mm": "[0-9]{2}", "ss": "[0-9]{2}", "SSS": "[0-9]+", "'T'": "T"}


def shape_of(pattern: str) -> str:
    """A regex that every text matches which the pattern can read; any text's for patterns with other letters."""
    parts = [m[0] for m in re.finditer(r"'T'|([A-Za-z])\1*|[^A-Za-z]", pattern)]
    if any(p not in _SHAPES and (p[0].isalpha() or p == "'") for p in parts):
        return ""
    return "(?i)^" + "".join(_SHAPES.get(p) or re.escape(p) for p in parts) + r"\z"


def read_time(s: Column, pattern: str) -> Column:
    """``try_to_timestamp``, without a failed attempt (an exception for each value) where the text's shape tells that it fails."""
    return F.when(s.rlike(shape_of(pattern)), F.try_to_timestamp(s, F.lit(pattern)))


def read_date(s: Column, pattern: str) -> Column:
    """The day of ``read_time``; the common pattern with four digits of year is read by a cast."""
    day = F.to_date(read_time(s, pattern))
    return F.when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}\\z"), s.try_cast("date")).otherwise(day) if pattern == "yyyy-MM-dd" else day
