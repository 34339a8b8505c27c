"""Small helpers shared by the operators that work on Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; texts differ in length by orders of magnitude,
#: so batches are kept short and cut again by bytes below.
BATCH_ROWS = 256
#: Bytes of text that numpy works on at once (its temporaries take about 60 times that).
BLOCK_BYTES = 1 << 20
#: Block size for work with many temporaries per byte.
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, 9, 10, 11, 12, 13]] = True


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short in this session, unless it already asks for shorter ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) runs of rows that hold about ``limit`` bytes; a longer text is a run of its own."""
    start, held = 0, 0
    for i, n in enumerate(byte_lengths(texts)):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(texts):
        yield start, len(texts)


#: Functions whose results a worker keeps for later tasks.
_kept: list[Callable] = []


def kept(f: Callable) -> Callable:
    """``f`` with its last results kept in the worker, until a task begins that does not ask for them."""
    f = lru_cache(maxsize=2)(f)
    _kept.append(f)
    return f


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def drained(batches: Iterator, *keep: Callable) -> Iterator:
    """The batches of a task; after the last one, memory that its worker has freed goes back to the system.

    Workers are kept for later tasks, and those of other stages wait beside
    them; without this each keeps what its largest batch took, and what
    ``kept`` functions other than ``keep`` have made for stages before.
    """
    others = [f for f in _kept if f not in keep and f.cache_info().currsize]
    if others:
        for f in others:
            f.cache_clear()
        _give_back()
    yield from batches
    _give_back()


def byte_lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows' UTF-8 bytes after one another and each row's start (one more entry at the end); null is empty."""
    import pyarrow.compute as pc

    lengths = byte_lengths(texts)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=starts[1:])
    kind = pa.large_binary()
    whole = pc.fill_null(texts.cast(pa.binary()) if pa.types.is_string(texts.type) else texts.cast(kind), b"")
    data = b"".join(whole.to_pylist())
    return np.frombuffer(data, dtype=np.uint8), starts


def need(df: DataFrame, *columns: str) -> None:
    """Fail early, by name, when a column that an operator reads is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")


def hash_share(df: DataFrame, h: Column, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df``, those with the smallest values of the 64-bit hash ``h``; all if there are no more.

    For bounded samples: what a later ``limit`` has to gather is bounded too,
    whatever the number of partitions.
    """
    share = min(1.0, rows / max(1, df.count()))
    return df if share == 1.0 else df.where(F.shiftrightunsigned(h, 33) < int(share * (1 << 31)))


#: Ids that may be broadcast, by count (8 bytes each).
BROADCAST_IDS = 2_000_000


def only_ids(df: DataFrame, key: str, ids: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of ``df`` whose ``key`` is (or is not) in the one column of ``ids``; ids are broadcast only if they are few."""
    named = ids.select(F.col(ids.columns[0]).alias("_id"))
    few = named.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(named) if few else named, F.col(key) == F.col("_id"), "left_semi" if inside else "left_anti")
