"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

Every string of LENGTH bytes that also starts earlier (in a document of smaller
id, or before in the same one) is removed.  Which suffixes are compared is
chosen by content: of the ANCHOR-byte grams inside a string, the one of least
hash (the rightmost of equal ones) is its anchor, so equal strings have equal
anchors at equal distances.  Neighbouring strings mostly share an anchor; one
entry stands for all of them (a stretch), with the anchor's hash, the hash of
all its bytes, and its place.

Entries are sharded by anchor.  In a shard each arriving batch becomes a
sorted suffix array; it enters a family of levels, of which two of like size
are merged.  Sorting and merging scan for long matches: of equal stretches the
earliest stays, every other one is a repeat and leaves the index, so an index
holds distinct stretches only, and a passage in every document is one entry.

Stretches that share an anchor but not all bytes (at the ends of repeats) are
compared string by string: the strings of those that stayed are hashed and
sharded anew, and a second family keeps the earliest of equal strings.

Strings are told apart by two 64-bit hashes (stretches by that of the anchor
and that of all bytes).  Defined results: null and empty
texts have no bytes; matches never cross documents; strings are judged on the
input; of rows that share an id, and of rows without one (which come last),
the order is that of their texts; texts are processed whole, very long ones in pieces
that overlap by LENGTH - 1 bytes, so no string is lost between two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import blocks, joined_bytes, need, only_ids, small_batches
from .mixing import positions
from .words import PLACE_VALUES, RunHasher, mix

LENGTH = 100
ANCHOR = 32
#: Bits of a gram's place inside a block, below its hash, while the least is searched.
PLACE_BITS = 27
BLOCK = 1 << 20
#: Bytes of a text's piece; a place inside it must fit PLACE_BITS.
PIECE = 1 << 24
#: Entries that a map task packs at once, that a shard sorts at once, and that a shard aims to hold.
PACK, SORT, SHARD = 400_000, 1_000_000, 1_500_000

ENTRY = (("key", "<u8"), ("full", "<u8"), ("doc", "<i8"), ("lo", "<i4"), ("count", "<u1"))
STRING = (("key", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("lo", "<i4"))
#: Columns that tell entries apart; the others say where they are.
HASHES = ("key", "full", "check")


# ---- entries of a block of texts ----

def _least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` successive values."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def stretches(data: np.ndarray, starts: np.ndarray, hasher: RunHasher) -> dict[str, np.ndarray]:
    """Entries of all strings of a block: ``row``, ``lo`` (first string, within the row), ``count`` (strings less one), ``key``, ``full``."""
    width = LENGTH - ANCHOR + 1
    n = len(data) - LENGTH + 1
    lengths = np.diff(starts)
    if n <= 0 or not (lengths >= LENGTH).any():
        none = np.empty(0, np.int64)
        return {"row": none, "lo": none, "count": none, "key": np.empty(0, np.uint64), "full": np.empty(0, np.uint64)}
    grams = len(data) - ANCHOR + 1
    at = np.arange(grams)
    # not mixed with the length, as all grams have one
    h = hasher.of(at, at + ANCHOR)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    packed = (h & ~mask) | (mask - at.astype(np.uint64))
    anchor = (mask - (_least_in_windows(packed, width) & mask)).astype(np.int64)
    inside = np.zeros(n, dtype=bool)
    edge = np.zeros(n + 1, dtype=np.int64)
    long = np.flatnonzero(lengths >= LENGTH)
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, np.minimum(starts[long + 1] - LENGTH + 1, n), -1)
    inside = np.cumsum(edge[:n]) > 0
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    new[starts[long]] = True
    first = np.flatnonzero(new)
    stop = inside.copy()
    stop[:-1] &= new[1:] | ~inside[1:]
    last = np.flatnonzero(stop)
    a = anchor[first]
    shape = (a - first).astype(np.uint64) * np.uint64(256) + (last - first).astype(np.uint64)
    row = np.searchsorted(starts, first, side="right") - 1
    return {"row": row, "lo": first - starts[row], "count": last - first, "key": h[a],
            "full": mix(hasher.of(first, last + LENGTH) + shape * PLACE_VALUES[20])}


# ---- packed rows ----

def packed(columns: dict[str, np.ndarray], kind) -> bytes:
    return b"".join(np.ascontiguousarray(columns[c], dtype=t).tobytes() for c, t in kind)


def unpacked(data: bytes, kind) -> dict[str, np.ndarray]:
    n = len(data) // sum(np.dtype(t).itemsize for _, t in kind)
    out, at = {}, 0
    for c, t in kind:
        size = n * np.dtype(t).itemsize
        out[c] = np.frombuffer(data[at:at + size], t)
        at += size
    return out


def _joined(parts: list[dict[str, np.ndarray]], kind) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]) for c, _ in kind}


def _sharded(batch: dict[str, np.ndarray], kind, shards: int) -> pa.RecordBatch:
    """A batch's suffix array by shard.  Repeats inside the batch are known already: they travel as bare spans, in ``gone``,
    so a passage that everyone has is one entry of each batch."""
    level, repeats = Family(kind).sort(batch)
    spans = tuple(x for x in kind if x[0] not in HASHES)
    cut = []
    for columns, fields in ((level, kind), (repeats, spans)):
        shard = (columns["key"] >> np.uint64(20)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        edge = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
        columns = {c: v[order] for c, v in columns.items()}
        cut.append([packed({c: v[edge[k]:edge[k + 1]] for c, v in columns.items()}, fields) for k in range(shards)])
    some = [k for k in range(shards) if cut[0][k] or cut[1][k]]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array([x[k] for k in some], pa.binary()) for x in cut]],
                                      ["shard", "data", "gone"])


# ---- the index family ----

class Family:
    """Levels of sorted entries; of equal entries the earliest stays, the others are handed out as repeats."""

    def __init__(self, kind):
        self.kind = kind
        self.same = [c for c, _ in kind if c in HASHES]
        self.levels: list[dict[str, np.ndarray]] = []

    def sort(self, columns: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """(distinct entries in order, repeats)"""
        order = np.lexsort((columns["lo"], columns["doc"], *[columns[c] for c in reversed(self.same)]))
        columns = {c: v[order] for c, v in columns.items()}
        again = np.zeros(len(order), dtype=bool)
        again[1:] = np.logical_and.reduce([columns[c][1:] == columns[c][:-1] for c in self.same])
        return {c: v[~again] for c, v in columns.items()}, {c: v[again] for c, v in columns.items()}

    def add(self, batch: dict[str, np.ndarray]) -> list[dict[str, np.ndarray]]:
        """Take in a batch; its repeats and those found while levels merge."""
        level, repeats = self.sort(batch)
        out = [repeats]
        while self.levels and len(self.levels[-1]["key"]) < 2 * len(level["key"]):
            level, repeats = self.sort(_joined([self.levels.pop(), level], self.kind))
            out.append(repeats)
        self.levels.append(level)
        return out

    def finish(self) -> tuple[dict[str, np.ndarray] | None, list[dict[str, np.ndarray]]]:
        """One level of all, and the repeats found on the way."""
        out = []
        while len(self.levels) > 1:
            level, repeats = self.sort(_joined([self.levels.pop(), self.levels.pop()], self.kind))
            self.levels.append(level)
            out.append(repeats)
        return (self.levels[0] if self.levels else None), out


def _span_rows(parts: list[dict[str, np.ndarray]], open_: bool = False) -> pa.RecordBatch:
    doc = np.concatenate([p["doc"] for p in parts])
    lo = np.concatenate([p["lo"] for p in parts]).astype(np.int64)
    more = np.concatenate([p["count"].astype(np.int64) if "count" in p else np.zeros(len(p["doc"]), np.int64) for p in parts])
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo), pa.array(lo + more), pa.array(np.full(len(doc), open_))], ["doc", "lo", "hi", "open"])


def _index(packed_rows: DataFrame, shards: int, kind) -> DataFrame:
    """Rows (doc, lo, hi, open): repeated strings from lo to hi; open ones share an anchor with other bytes around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, held, count = Family(kind), [], 0
        spans = tuple(x for x in kind if x[0] not in HASHES)
        for batch in batches:
            gone = [unpacked(x.as_py(), spans) for x in batch.column(2)]
            if gone:
                yield _span_rows(gone)
            for data in batch.column(1):
                held.append(unpacked(data.as_py(), kind))
                count += len(held[-1]["key"])
                if count >= SORT:
                    yield _span_rows(family.add(_joined(held, kind)))
                    held, count = [], 0
        if held:
            yield _span_rows(family.add(_joined(held, kind)))
        level, repeats = family.finish()
        if repeats:
            yield _span_rows(repeats)
        if level is not None and "full" in level and len(level["key"]) > 1:
            same = level["key"][1:] == level["key"][:-1]
            shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
            yield _span_rows([{c: v[shared] for c, v in level.items()}], True)

    return packed_rows.repartition(shards, "shard").mapInArrow(run, "doc bigint, lo bigint, hi bigint, open boolean")


def _pieces(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, row starts, place of the first byte): a block as it is, or a text longer than PIECE in overlapping pieces."""
    if len(starts) > 2 or len(data) <= PIECE:
        yield data, starts, 0
        return
    for at in range(0, max(1, len(data) - LENGTH + 1), PIECE):
        part = data[at:at + PIECE + LENGTH - 1]
        yield part, np.array([0, len(part)], dtype=np.int64), at


def _entries(docs: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for a, b in blocks(texts, BLOCK):
                for data, starts, before in _pieces(*joined_bytes(texts.slice(a, b - a))):
                    found = stretches(data, starts, RunHasher(data))
                    held.append(found | {"doc": ids[a:b][found["row"]], "lo": found["lo"] + before})
                    count += len(found["row"])
                    if count >= PACK:
                        yield _sharded(_joined(held, ENTRY), ENTRY, shards)
                        held, count = [], 0
        if count:
            yield _sharded(_joined(held, ENTRY), ENTRY, shards)

    return docs.select("doc", "text").mapInArrow(run, "shard int, data binary, gone binary")


def _strings(docs: DataFrame, shards: int) -> DataFrame:
    """Hashes of the strings from each lo to each hi of (doc, text, los, his)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for a, b in blocks(texts, BLOCK):
                data, starts = joined_bytes(texts.slice(a, b - a))
                lists = [c.slice(a, b - a) for c in (batch.column(2), batch.column(3))]
                lo, hi = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
                row = np.repeat(np.arange(b - a), np.array([len(x) for x in lists[0].to_pylist()], dtype=np.int64))
                size = hi - lo + 1
                place = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                row = np.repeat(row, size)
                at = starts[row] + place
                h = RunHasher(data).of(at, at + LENGTH)
                # a second hash, over other values of the bytes: only strings that agree in 128 bits are taken as equal
                held.append({"key": h, "check": RunHasher(data ^ np.uint8(0x5A)).of(at, at + LENGTH), "doc": ids[a:b][row], "lo": place})
                count += len(h)
                if count >= PACK:
                    yield _sharded(_joined(held, STRING), STRING, shards)
                    held, count = [], 0
        if count:
            yield _sharded(_joined(held, STRING), STRING, shards)

    return docs.select("doc", "text", "los", "his").mapInArrow(run, "shard int, data binary, gone binary")


# ---- whole tables ----

def _listed(spans: DataFrame) -> DataFrame:
    """(doc, los, his): a document's spans, at most one entry for each of its own positions."""
    return spans.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("lo", "hi")).alias("s")).select(
        "_doc", F.col("s.lo").alias("los"), F.col("s.hi").alias("his"))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, lo, hi) for (doc, text) with distinct non-null longs: strings starting from lo to hi all start earlier, too."""
    spark = docs.sparkSession
    small_batches(spark)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(least, n_bytes * 2 // (LENGTH - ANCHOR) // SHARD)
    found = cut_lineage(_index(_entries(docs, shards), shards, ENTRY), "stretches")
    open_ = cut_lineage(_listed(found.where("open")), "open")
    some = only_ids(docs, "doc", open_.select("_doc"))
    strings = some.join(open_, F.col("doc") == F.col("_doc"))
    n_strings = open_.agg(F.sum(F.aggregate(F.zip_with("los", "his", lambda a, b: b - a + 1), F.lit(0).cast("long"), lambda x, y: x + y))).first()[0] or 0
    shards = max(least, n_strings // (2 * SHARD))
    single = _index(_strings(strings, shards), shards, STRING)
    return found.where("NOT open").select("doc", "lo", "hi").union(single.select("doc", "lo", "hi"))


KIND = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>"


def _cut(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, int, bytes]:
    edge = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi + LENGTH, -1)
    gone = np.cumsum(edge[:len(text)]) > 0
    runs = int((gone[1:] & ~gone[:-1]).sum() + (gone[:1]).sum())
    return len(text), int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the struct ``repeats``: n_bytes, n_removed, n_spans and the kept bytes of each row."""
    need(df, key, text)
    spark = df.sparkSession
    small_batches(spark)
    ids = df.select(F.col(key).cast("bigint").alias("k"))
    shape = ids.agg(F.count(F.lit(1)).alias("rows"), F.count("k").alias("named")).first()
    clear = shape["rows"] == shape["named"] and ids.groupBy("k").count().where("count > 1").isEmpty()
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).cast("bigint").alias("k"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"))
    if clear:
        rows = own.withColumnRenamed("k", "doc")
    else:
        # ids that don't order all rows: number them by id, then text
        rows = positions(own, [F.col("k").asc_nulls_last(), F.col("text")], name="doc").drop("k")
    spans = cut_lineage(_listed(repeats(rows.select("doc", "text"))), "spans")

    @F.arrow_udf(KIND)
    def cut(texts: pa.Array, los: pa.Array, his: pa.Array) -> pa.Array:
        out = [_cut((t.as_py() or "").encode(), np.array(a.as_py() or [], np.int64), np.array(b.as_py() or [], np.int64))
               for t, a, b in zip(texts, los, his, strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.StructArray.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)],
                                          names=["n_bytes", "n_removed", "n_spans", "kept"])

    named = spans.select("_doc")
    hit = only_ids(rows, "doc", named).join(spans, F.col("doc") == F.col("_doc")).select("row", cut("text", "los", "his").alias("repeats"))
    whole = F.struct(F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"),
                     F.lit(0).cast("bigint").alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    rest = only_ids(rows, "doc", named, inside=False).select("row", whole.alias("repeats"))
    return hit.union(rest).select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns if c != "repeats"], "repeats")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", F.sha2("repeats.kept", 256).alias("kept_sha256"))

