"""Quality rules: how much of a text is repetition.

Words, lines and symbols are counted over the whole text.  For several
n-gram lengths, rolling hashes of all word windows are compared within the
text: for short ones the share of characters in the most frequent window, for
longer ones the share of characters that lie in any window found twice or
more (each character once, all occurrences).  Lines are treated likewise.  A
text is kept if it passes the base rules and no share is above its limit.

Defined results: null and empty texts have no words, all counts 0, fail the
base rule on the number of words and are not kept; repeated rows get equal
results; a text is always read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import blocks, need, small_batches
from .words import PLACE_VALUES, Words, mix, windows, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Published limits on repetition, as shares of a text's word characters.
#: Most frequent window of so many words.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
#: All windows of so many words that occur twice or more.
DUPLICATE_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Share of lines, and of characters, in lines that equal an earlier line.
MAX_DUPLICATE_LINES = 0.30
MAX_DUPLICATE_LINE_CHARS = 0.20

FIELDS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words")
SHARES = tuple(f"top_{n}gram" for n in TOP_LIMITS) + tuple(f"dup_{n}gram" for n in DUPLICATE_LIMITS)
SCHEMA = "struct<" + ",".join([f"{x}:bigint" for x in FIELDS] + [f"{x}:double" for x in SHARES]) + ">"
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _per_row(n_rows: int, rows: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights=weights, minlength=n_rows).astype(np.int64)


def _repeated(words: Words, n: int, shorter: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of equal windows in the row, of the windows of ``n`` words found twice or more.

    ``shorter`` marks the first words of repeated windows of n - 1 words: a
    window can only be repeated if both of its shorter ones are, so most
    windows are never hashed.
    """
    if shorter is None:
        at, h = windows(words, n)
    else:
        at = np.flatnonzero(shorter[:-1] & shorter[1:])
        at = at[words.row[at] == words.row[at + n - 1]]
        at, h = windows(words, n, at)
    key = mix(h + words.row[at].astype(np.uint64) * PLACE_VALUES[n])
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    count = np.repeat(size, size)
    twice = count >= 2
    return at[order[twice]], count[twice]


def _covered(n_words: int, at: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in one of the windows that start at ``at``."""
    edge = np.bincount(at, minlength=n_words + 1) - np.bincount(at + n, minlength=n_words + 1)
    return np.cumsum(edge[:n_words]) > 0


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """All measures of a block of texts."""
    w = words_of(texts)
    rows, n_words = len(texts), len(w.hash)
    points = np.zeros(len(w.data) + 1, dtype=np.int64)
    np.cumsum((w.data & 0xC0) != 0x80, out=points[1:])
    chars = points[w.end] - points[w.start]
    out = {"n_words": _per_row(rows, w.row), "word_chars": _per_row(rows, w.row, chars)}
    symbols = np.concatenate(([0], np.cumsum(_SYMBOLS[w.data])))
    out["n_symbols"] = symbols[w.row_end] - symbols[w.row_start]

    # lines: cut at line feeds and at the ends of rows
    cuts = np.zeros(len(w.data), dtype=bool)
    cuts[w.data == 10] = True
    cuts[w.row_end] = True
    line_end = np.flatnonzero(cuts)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    filled = np.searchsorted(w.start, line_end) > np.searchsorted(w.start, line_start)
    line_start, line_end = line_start[filled], line_end[filled]
    line_row = np.searchsorted(w.row_start, line_start, side="right") - 1
    line_hash = w.hasher.of(line_start, line_end)
    order = np.lexsort((line_start, line_hash, line_row))
    again = np.zeros(len(order), dtype=bool)
    again[order[1:]] = (line_row[order][1:] == line_row[order][:-1]) & (line_hash[order][1:] == line_hash[order][:-1])
    out["n_lines"] = _per_row(rows, line_row)
    out["n_dup_lines"] = _per_row(rows, line_row[again])
    cum = np.concatenate(([0], np.cumsum(chars)))
    line_chars = cum[np.searchsorted(w.start, line_end)] - cum[np.searchsorted(w.start, line_start)]
    out["dup_line_chars"] = _per_row(rows, line_row[again], line_chars[again])

    whole = np.maximum(out["word_chars"], 1)
    found = None
    for n in range(2, max(DUPLICATE_LIMITS) + 1):
        at, count = _repeated(w, n, found)
        found = np.zeros(n_words + 1, dtype=bool)
        found[at] = True
        if n == 3:
            out["n_repeat_words"] = _per_row(rows, w.row[_covered(n_words, at, 3)])
        if n in TOP_LIMITS:
            # characters of a window, times its occurrences; a window found once is no repetition
            top = np.zeros(rows, dtype=np.int64)
            np.maximum.at(top, w.row[at], (cum[at + n] - cum[at]) * count)
            out[f"top_{n}gram"] = np.minimum(top / whole, 1.0)
        if n in DUPLICATE_LIMITS:
            inside = _covered(n_words, at, n)
            out[f"dup_{n}gram"] = _per_row(rows, w.row[inside], chars[inside]) / whole
    return out


def assess(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with all measures, ``base_failed`` and ``kept``; columns of those names are replaced."""
    need(df, text)
    small_batches(df.sparkSession)

    @F.arrow_udf(SCHEMA)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [measure(texts.slice(a, b - a)) for a, b in blocks(texts)]
            get = lambda k, t: pa.array(np.concatenate([p[k] for p in parts]) if parts else [], t)
            yield pa.StructArray.from_arrays([get(k, pa.int64()) for k in FIELDS] + [get(k, pa.float64()) for k in SHARES],
                                             names=[*FIELDS, *SHARES])

    held = "_quality"
    out = df.withColumn(held, run(F.col(text)))
    out = out.withColumns({x: F.col(f"{held}.{x}") for x in (*FIELDS, *SHARES)}).drop(held)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    good = ((F.col("n_dup_lines") <= MAX_DUPLICATE_LINES * F.col("n_lines"))
            & (F.col("dup_line_chars") <= MAX_DUPLICATE_LINE_CHARS * F.col("word_chars")))
    for n, limit in TOP_LIMITS.items():
        good = good & (F.col(f"top_{n}gram") <= limit)
    for n, limit in DUPLICATE_LIMITS.items():
        good = good & (F.col(f"dup_{n}gram") <= limit)
    return out.withColumns({"base_failed": failed, "kept": ~failed & good})


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assess(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                               "base_failed", "kept", "n_lines", "dup_line_chars", *SHARES)
