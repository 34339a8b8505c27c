"""Types of text columns, from all their values in one aggregate.

The types form a lattice: boolean; bigint below decimal below double; date
below timestamp; text above all.  Each value says which types can hold it, and
a column's types are those that all its values have in common, so the answer
is an AND over the rows: it needs no sample, merges map-side, does not depend
on the order of rows, and a single value that fits nowhere else makes a
column text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import read_date, read_time

# How dates and times are commonly written; a column must fit one of them throughout.
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd")
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS")
TRUE, FALSE = ("true", "True", "TRUE"), ("false", "False", "FALSE")

#: Plain decimals of up to 32 digits before the point and 6 after it, which DECIMAL(38,6) holds exactly.
_INTEGER, _DECIMAL = r"^\s*[+-]?[0-9]{1,19}\s*$", r"^\s*[+-]?([0-9]{1,32}(\.[0-9]{0,6})?|\.[0-9]{1,6})\s*$"
#: Numbers in digits only: Spark's cast would also take type suffixes and words for infinities.
_NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

#: Rows that are looked at before all of them.
FIRST = 1000


def _readings(c: Column) -> list[tuple[str, Column, Column]]:
    """(type, whether a value has it, the value as that type), the narrowest first."""
    trimmed = F.trim(c)
    out = [("boolean", trimmed.isin(*TRUE, *FALSE), trimmed.isin(*TRUE)),
           ("bigint", c.rlike(_INTEGER) & c.try_cast("bigint").isNotNull(), c.try_cast("bigint")),
           ("decimal(38,6)", c.rlike(_DECIMAL), trimmed.try_cast("decimal(38,6)")),
           ("double", c.rlike(_NUMBER), c.try_cast("double"))]
    for f in DATE_FORMATS:
        day = read_date(trimmed, f)
        out.append(("date", day.isNotNull(), day))
    for f in TIME_FORMATS:
        t = read_time(trimmed, f)
        out.append(("timestamp_ntz", t.isNotNull(), t.cast("timestamp_ntz")))
    return out


def _fitting(df: DataFrame, places: dict[str, list[int]]) -> dict[str, list[tuple[int, bool | None]]]:
    """For each column the given places of readings, and whether all values of ``df`` have them (null: there are no values)."""
    flags = []
    for i, (name, ks) in enumerate(places.items()):
        c = F.col(f"`{name}`")
        readings = _readings(c)
        flags += [F.bool_and(F.when(c.isNotNull(), F.coalesce(readings[k][1], F.lit(False)))).alias(f"{i}_{k}") for k in ks]
    row = df.agg(*flags).first() if flags else {}
    return {name: [(k, row[f"{i}_{k}"]) for k in ks] for i, (name, ks) in enumerate(places.items())}


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, int | None]:
    """For each text column the place of its narrowest reading; None for text, and for columns without a value.

    One row of flags reaches the driver, whatever the number of rows.  A value
    that refutes a reading does so for the whole column, so the readings that
    some FIRST rows refute are not tried on all rows; every other reading is.
    """
    names = [c for c, t in df.dtypes if t == "string" and (columns is None or c in columns)]
    if not names:
        return {}
    every = list(range(len(_readings(F.lit("")))))
    first = _fitting(df.limit(FIRST), {c: every for c in names})
    whole = _fitting(df, {c: [k for k, fits in first[c] if fits is not False] for c in names})
    return {c: next((k for k, fits in whole[c] if fits), None) for c in names}


def inferred(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``df`` with its text columns, but for ``keep``, cast to their inferred types; nulls stay null."""
    places = infer_types(df, [c for c in df.columns if c not in set(keep)])
    return df.select(*[F.col(f"`{c}`") if places.get(c) is None else _readings(F.col(f"`{c}`"))[places[c]][2].alias(c) for c in df.columns])
