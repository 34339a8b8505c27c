"""Exact similarity join of n-gram sets by PartEnum signatures.

A document's set is its distinct hashed shingles.  Sets are put into bands of
like size, such that two sets of Jaccard similarity 0.8 or more lie in the
same or in neighbouring bands, and differ in at most k elements, k known for
each band.  The feature domain is dealt by a hash into more than k / 2 groups
of three partitions, so two such sets differ in one element at most in some
group; each group signs its subsets of two partitions, one of which the two
sets share (for k up to 2 there is one group, and all its subsets of n - k
partitions sign).  Signatures of empty partitions would be shared by all; they
are left out where a set has enough groups without them, and the few sets that
have not sign again under another dealing, in which again only sets of that
kind need to meet.

Signatures travel as packed arrays, sharded by signature; a shard's task
sorts them in bounded memory and keeps what two documents share: pairs of each
bucket's first document (its pivot) with the others.  Pairs are tested, first
by a bound from small count vectors, then exactly; the best supported partner
of each document comes first, then what still lies in different components.
Buckets whose members do not all reach one component offer a member of their
largest one to the others; what then lies in different components still is
tested inside tasks, a thousand members against a thousand, and only pairs
that sizes and count vectors allow come out, to be tested exactly.  The result
does not depend on these choices: every link is found or is between members of
one component already.

Defined results: words of whole texts, A-Z in lower case; fewer than SHINGLE
words are one shingle; null, empty and wordless texts have the empty set and
no link; equal non-empty sets link; rows with a null id have a null component
and link with nothing; rows that share an id are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import BROADCAST_IDS, blocks, drained, need, only_ids, small_batches
from .components import components
from .words import PLACE_VALUES, mix, windows, words_of

SHINGLE = 5
#: Least similarity as a ratio of whole numbers.
SIMILAR, OF = 4, 5
#: Dealings that a set with too many empty partitions signs under before it signs empty partitions too.
DEALINGS = 6
#: Count vector: places of the domain, counts up to 255.
PLACES = 256
#: Partitions of a group.
PARTS = 3
#: Members of a bucket that are tested against one another at once; larger buckets are cut into blocks that meet two by two.
MEMBERS = 1024
#: Pairs whose count vectors are compared at once.
PAIRS = 8_000
#: Signatures that a map task packs at once, that a shard's task sorts at once, and that a shard aims to hold.
PACK, SORT, SHARD = 300_000, 200_000, 600_000
#: Rounds in which a bucket's other components are tested against a member of its largest one.
OFFERS = 2
BLOCK = 1 << 18


# ---- sets ----

def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    w = words_of(texts, lower=True)
    at, h = windows(w, SHINGLE)
    first = np.searchsorted(w.row[at], np.arange(len(texts) + 1)) if len(at) else np.zeros(len(texts) + 1, np.int64)
    out = []
    for i in range(len(texts)):
        n = w.first[i + 1] - w.first[i]
        if n == 0:
            out.append(np.empty(0, np.uint64))
        elif n < SHINGLE:
            s = w.hash[w.first[i]:w.first[i + 1]]
            out.append(mix(np.array([(s * PLACE_VALUES[:n]).sum(dtype=np.uint64) + np.uint64(n)])))
        else:
            s = np.sort(h[first[i]:first[i + 1]])
            keep = np.ones(len(s), dtype=bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
    return out


def identity(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit hashes of each set."""
    one = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    two = np.array([mix(s ^ PLACE_VALUES[11]).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    return one, two


def count_vector(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((mix(s ^ PLACE_VALUES[12]) >> np.uint64(56)).astype(np.int64), minlength=PLACES), 255).astype(np.uint8).tobytes()


# ---- signatures ----

def _bands(most: int = 1 << 40) -> np.ndarray:
    """First size of each band: a band's sizes are within the least similarity of one another."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * OF // SIMILAR + 1)
    return np.array(out, dtype=np.int64)


BAND = _bands()


def _scheme(band: int) -> tuple[int, int]:
    """(k, n): most differing elements of similar sets whose larger one is in the band, and partitions.

    For k up to 2 the partitions are one group, and all subsets of n - k sign.
    Beyond, they form groups of PARTS: with more than k / 2 groups two similar
    sets differ in one element at most in some group, so in all but one of its
    partitions they agree, and each group signs its subsets of PARTS - 1.
    """
    largest = int(BAND[band + 1]) - 1
    k = 2 * largest * (OF - SIMILAR) // (OF + SIMILAR)
    if k <= 2:
        return k, (1, 3, 5)[k]
    groups = k // 2 + 1
    return k, PARTS * (groups + int(np.ceil(0.06 * groups + 1.7 * np.sqrt(0.06 * groups))))


SCHEMES = np.array([_scheme(b) for b in range(len(BAND) - 1)], dtype=np.int64)


def _sign(rows: np.ndarray, sets: list[np.ndarray], band: np.ndarray, large: bool, dealing: int, seed: int,
          out: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Append (row, signature) of the given rows, signed for ``band`` (one entry for each row)."""
    if not len(rows):
        return
    k, n = SCHEMES[band].T
    values = np.concatenate([sets[r] for r in rows])
    size = np.array([len(sets[r]) for r in rows])
    place_of = np.repeat(np.arange(len(rows)), size)
    salt = mix(band.astype(np.uint64) * PLACE_VALUES[13] + np.array([dealing + 64 * seed], np.uint64) * PLACE_VALUES[14])
    dealt = mix(values ^ salt[place_of])
    start = np.concatenate(([0], np.cumsum(n)))
    part = start[place_of] + ((dealt >> np.uint64(32)) * n[place_of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    sums = np.zeros(start[-1], dtype=np.uint64)
    np.add.at(sums, part, mix(dealt + PLACE_VALUES[15]))
    empty = np.bincount(part, minlength=start[-1]) == 0
    empties = np.add.reduceat(empty, start[:-1])
    owner = np.repeat(np.arange(len(rows)), n)
    number = (np.arange(start[-1]) - start[owner]).astype(np.uint64)
    # too many empty partitions: sign again, and in the last dealing sign the empty ones too
    unsure = empties >= n - k
    last = dealing == DEALINGS - 1
    at = np.flatnonzero(k[owner] > 2)
    in_group, bare = sums[at].reshape(-1, PARTS), empty[at].reshape(-1, PARTS)
    group_of, group = owner[at[::PARTS]], number[at[::PARTS]] // np.uint64(PARTS)
    # a group in which some subset is empty as a whole may have nothing to share
    bad = np.bincount(group_of, weights=bare.sum(axis=1) >= PARTS - 1, minlength=len(rows))
    unsure = np.where(k > 2, bad >= n // PARTS - k // 2, unsure)
    tag = lambda who, what, which: (mix(what + salt[who] + which * PLACE_VALUES[16]) & ~np.uint64(1)) | np.uint64(large)
    for which, subset in enumerate(combinations(range(PARTS), PARTS - 1)):
        cols = list(subset)
        ok = ~bare[:, cols].all(axis=1) | (unsure[group_of] & last)
        out.append((rows[group_of[ok]], tag(group_of[ok], in_group[ok][:, cols].sum(axis=1, dtype=np.uint64), group[ok] * np.uint64(PARTS) + np.uint64(which))))
    for few in (0, 1, 2):
        mine = np.flatnonzero(k == few)
        if not len(mine):
            continue
        parts = int((1, 3, 5)[few])
        grid = sums[start[mine][:, None] + np.arange(parts)]
        none = empty[start[mine][:, None] + np.arange(parts)]
        for number_of, subset in enumerate(combinations(range(parts), parts - few)):
            cols = list(subset)
            ok = ~none[:, cols].all(axis=1) | (unsure[mine] & last)
            who = mine[ok]
            out.append((rows[who], tag(who, grid[ok][:, cols].sum(axis=1, dtype=np.uint64), np.array([number_of], np.uint64))))
    if not last and unsure.any():
        _sign(rows[unsure], sets, band[unsure], large, dealing + 1, seed, out)


def signatures(sets: list[np.ndarray], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of all non-empty sets; the lowest bit tells whether the set is of the band that is signed for."""
    rows = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    band = np.searchsorted(BAND, [len(sets[i]) for i in rows], side="right") - 1
    out: list[tuple[np.ndarray, np.ndarray]] = []
    _sign(rows, sets, band, True, 0, seed, out)
    _sign(rows, sets, band + 1, False, 0, seed, out)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


# ---- Spark: sets, shared signatures ----

def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, h1, h2, counts)."""
    kind = "struct<n:bigint,h1:bigint,h2:bigint,counts:binary>"

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in drained(batches):
            sets = [s for a, b in blocks(texts, BLOCK) for s in shingle_sets(texts.slice(a, b - a))]
            one, two = identity(sets)
            yield pa.StructArray.from_arrays([
                pa.array([len(s) for s in sets], pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                pa.array([count_vector(s) if len(s) else b"" for s in sets], pa.binary())], names=["n", "h1", "h2", "counts"])

    held = docs.select("doc_id", run(F.col("text")).alias("s"))
    return held.select("doc_id", F.col("s.n").alias("n_shingles"), "s.h1", "s.h2", "s.counts")


def _packed(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    """Signatures of (doc_id, text) as rows of packed arrays: (shard, signatures, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count, known = 0, set()
        for batch in drained(batches):
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for a, b in blocks(texts, BLOCK):
                sets = shingle_sets(texts.slice(a, b - a))
                # of equal sets near one another the first signs for all: they are linked by identity
                if len(known) > 200_000:
                    known.clear()
                for i, key in enumerate(zip(*identity(sets), strict=True)):
                    if key in known:
                        sets[i] = sets[i][:0]
                    known.add(key)
                row, sig = signatures(sets, seed)
                held.append((ids[a:b][row], sig))
                count += len(sig)
                if count >= PACK:
                    yield pack(held)
                    held, count = [], 0
        if held:
            yield pack(held)

    def pack(held) -> pa.RecordBatch:
        ids, sig = np.concatenate([x for x, _ in held]).astype(np.int64), np.concatenate([x for _, x in held])
        shard = ((sig >> np.uint64(1)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((ids, shard))
        ids, sig, shard = ids[order], sig[order], shard[order]
        edge = np.searchsorted(shard, np.arange(shards + 1))
        some = [k for k in range(shards) if edge[k + 1] > edge[k]]
        return pa.RecordBatch.from_arrays([
            pa.array(some, pa.int32()), pa.array([sig[edge[k]:edge[k + 1]].tobytes() for k in some], pa.binary()),
            pa.array([ids[edge[k]:edge[k + 1]].tobytes() for k in some], pa.binary())], ["shard", "sigs", "ids"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "shard int, sigs binary, ids binary")


class Shared:
    """Finds the signatures that several documents have, in bounded memory; yields (bucket, pivot, doc)."""

    def __init__(self):
        self.bucket, self.doc = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.whole = True

    def add(self, sig: np.ndarray, doc: np.ndarray, final: bool = False):
        bucket = np.concatenate([self.bucket, sig >> np.uint64(1)])
        ids = np.concatenate([self.doc, doc])
        large = np.concatenate([np.ones(len(self.bucket), bool), (sig & np.uint64(1)) == 1])
        # kept documents come first among equals, so a bucket keeps its pivot
        new = np.concatenate([np.zeros(len(self.bucket), np.int8), np.ones(len(sig), np.int8)])
        order = np.lexsort((ids, new, bucket))
        bucket, ids, large = bucket[order], ids[order], large[order]
        if not len(bucket):
            return None
        head = np.ones(len(bucket), dtype=bool)
        head[1:] = bucket[1:] != bucket[:-1]
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(bucket)))
        pivot = np.repeat(ids[first], size)
        take = pivot != ids
        if final and self.whole:
            # a bucket without a set of the band signed for is found in the band below as well
            take &= np.repeat(np.logical_or.reduceat(large, first), size)
        self.bucket, self.doc, self.whole = bucket[first], ids[first], False
        return pa.RecordBatch.from_arrays([pa.array(bucket[take].view(np.int64)), pa.array(pivot[take]), pa.array(ids[take])], ["bucket", "pivot", "doc"])


def shared_signatures(docs: DataFrame, expected: int, seed: int = 0) -> DataFrame:
    """(bucket, pivot, doc) for every signature that several of ``docs`` (doc_id, text) have."""
    spark = docs.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-expected // SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, count = Shared(), [], 0
        for batch in drained(batches):
            for sig, ids in zip(batch.column(1), batch.column(2), strict=True):
                held.append((np.frombuffer(sig.as_py(), np.uint64), np.frombuffer(ids.as_py(), np.int64)))
                count += len(held[-1][0])
                if count >= SORT:
                    yield state.add(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                    held, count = [], 0
        if held:
            out = state.add(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), final=True)
            if out is not None:
                yield out

    small_batches(spark)
    # by the shard's number: by its hash some tasks would get several shards, and hold the signatures of all
    return _packed(docs, shards, seed).repartitionById(shards, F.col("shard")).mapInArrow(run, "bucket bigint, pivot bigint, doc bigint")


# ---- Spark: tests of pairs ----

def may_link(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) that sizes and count vectors allow to link."""
    side = lambda x: info.select(F.col("doc_id").alias(f"_{x}"), F.col("n_shingles").alias(f"n_{x}"), F.col("counts").alias(f"c_{x}"))

    @F.arrow_udf("bigint")
    def apart(x: pa.Array, y: pa.Array) -> pa.Array:
        one, two = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(-1, PLACES).astype(np.int64) for v in (x, y))
        return pa.array(np.abs(one - two).sum(axis=1))

    both = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    fits = F.least("n_a", "n_b") * OF >= F.greatest("n_a", "n_b") * SIMILAR
    some = both.where(fits).withColumn("apart", apart("c_a", "c_b"))
    return some.where(F.col("apart") * (OF + SIMILAR) <= (F.col("n_a") + F.col("n_b")) * (OF - SIMILAR)).select(*pairs.columns)


def _close(members: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): ids of members of one bucket in different components that sizes and count vectors allow to link.

    ``members``: run (bucket and its two blocks), whether both blocks are the same, own block, component, size, id.
    """
    order = np.lexsort((members[4], members[0]))
    run, alone, block, component, n, ids = (m[order] for m in members)
    counts = counts[order]
    # partners stand behind a member in its run, as far as sizes allow
    at = np.arange(len(run))
    base = n.max() * OF + 1
    _, number = np.unique(run, return_inverse=True)
    upto = np.searchsorted(number * base + n * SIMILAR, number * base + n * OF, side="right")
    many = np.maximum(upto - at - 1, 0)
    out_a, out_b = [], []
    edge = np.concatenate(([0], np.cumsum(many)))
    for begin in range(0, int(edge[-1]), PAIRS):
        pair = np.arange(begin, min(begin + PAIRS, int(edge[-1])))
        one = np.searchsorted(edge, pair, side="right") - 1
        two = one + 1 + pair - edge[one]
        keep = (component[one] != component[two]) & (alone[one] | (block[one] != block[two]))
        one, two = one[keep], two[keep]
        apart = np.abs(counts[one].astype(np.int16) - counts[two]).sum(axis=1, dtype=np.int64)
        keep = apart * (OF + SIMILAR) <= (n[one] + n[two]) * (OF - SIMILAR)
        out_a.append(np.minimum(ids[one[keep]], ids[two[keep]]))
        out_b.append(np.maximum(ids[one[keep]], ids[two[keep]]))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def unlike(level: DataFrame, info: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of one bucket (bucket, doc, component, size) in different components that may link.

    Members meet inside tasks, MEMBERS by MEMBERS, and only what sizes and
    count vectors allow comes out.  A large bucket is cut into blocks by hash
    of the document; each two of its blocks meet in a group of their own, so no
    group holds more than about twice MEMBERS rows.
    """
    parts = int(level.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks_ = F.greatest(F.lit(1), F.ceil(F.col("size") / MEMBERS)).cast("int")
    own = level.withColumn("_n_blocks", blocks_).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("_n_blocks")).cast("int"))
    other = own.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_n_blocks") - 1)))
    side = info.select(F.col("doc_id").alias("_id"), "n_shingles", "counts")
    run = F.xxhash64("bucket", F.least("block", "_with"), F.greatest("block", "_with"))
    rows = (other.join(side, F.col("doc") == F.col("_id"))
            .select(run.alias("run"), (F.col("block") == F.col("_with")).alias("same"), "block", "component", "n_shingles", "doc", "counts"))
    dealt = rows.repartition(max(parts, 1), "run").sortWithinPartitions("run")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def pairs_of(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            members = [t[c].to_numpy() for c in ("run", "same", "block", "component", "n_shingles", "doc")]
            counts = np.frombuffer(b"".join(t["counts"].to_pylist()), np.uint8).reshape(-1, PLACES)
            a, b = _close(members, counts)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        for batch in drained(batches):
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 4 * MEMBERS:
                continue
            runs = held["run"].to_numpy()
            # the last run may go on in the next batch
            cut = int(np.flatnonzero(runs != runs[-1])[-1]) + 1 if (runs != runs[-1]).any() else 0
            if cut:
                yield pairs_of(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield pairs_of(held)

    return dealt.mapInArrow(test, "a bigint, b bigint").distinct()


def links(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    pairs = cut_lineage(pairs.select("a", "b").distinct(), "pairs")
    if pairs.isEmpty():
        return pairs
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    @F.arrow_udf("binary")
    def as_set(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in drained(batches):
            yield pa.array([s.tobytes() for x, y in blocks(texts, BLOCK) for s in shingle_sets(texts.slice(x, y - x))], pa.binary())

    @F.arrow_udf("boolean")
    def similar(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for one, two in zip(x, y, strict=True):
            one, two = np.frombuffer(one.as_py(), np.uint64), np.frombuffer(two.as_py(), np.uint64)
            both = np.concatenate([one, two])
            both.sort()
            inside = int((both[1:] == both[:-1]).sum())
            out.append(inside * OF >= SIMILAR * (len(one) + len(two) - inside) > 0)
        return pa.array(out, pa.bool_())

    small_batches(docs.sparkSession)
    sets = cut_lineage(only_ids(docs, "doc_id", ids).select("doc_id", as_set("text").alias("s")), "sets")
    side = lambda k: sets.select(F.col("doc_id").alias(f"_{k}"), F.col("s").alias(f"s_{k}"))
    both = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    return cut_lineage(both.where(similar("s_a", "s_b")).select("a", "b").distinct(), "links")


def _labelled(df: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    own = labels.select(F.col("node").alias("_node"), F.col("component").alias("_label"))
    return df.join(own, F.col(column) == F.col("_node"), "left").withColumn(name, F.coalesce("_label", column)).drop("_node", "_label")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    both = _labelled(_labelled(pairs, "a", labels, "_ca"), "b", labels, "_cb")
    return both.where("_ca <> _cb").drop("_ca", "_cb")


def _as_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def join_components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of ``df``."""
    need(df, key, text)
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    info = cut_lineage(describe(docs), "sets-info")
    named = info.where("doc_id IS NOT NULL AND n_shingles > 0")
    # equal sets: every document of a group links with the group's first
    groups = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    joined = named.select("doc_id", "h1", "h2").join(groups.select(F.col("h1").alias("_1"), F.col("h2").alias("_2"), "first"), (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")))
    copies = cut_lineage(joined.where("doc_id <> first").select("doc_id", "first").distinct(), "copies")
    own = docs.where("doc_id IS NOT NULL")
    expected = int((named.agg(F.sum("n_shingles")).first()[0] or 0) * 1.1)
    ids = copies.select(F.col("doc_id").alias("_id"))
    # copies need no signatures of their own; leaving them out only spares work, so it is done where they are few
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    signed = own.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left_anti") if few else own
    found = cut_lineage(shared_signatures(signed, expected), "shared")
    first_of = copies.select(F.col("doc_id").alias("node"), F.col("first").alias("component"))
    members = found if few else _labelled(_labelled(found, "pivot", first_of, "pivot"), "doc", first_of, "doc")
    members = members.where("pivot <> doc")
    small = info.where("n_shingles > 0").select("doc_id", "n_shingles", "counts")
    pairs = members.groupBy(F.least("pivot", "doc").alias("a"), F.greatest("pivot", "doc").alias("b")).agg(F.count(F.lit(1)).alias("support"))
    pairs = cut_lineage(may_link(pairs, small), "pairs")
    edges = links(pairs.groupBy("b").agg(F.max_by("a", F.struct("support", -F.col("a"))).alias("a")), own)
    labels = components(edges)
    edges, labels = _joined(edges, links(_across(pairs, labels), own), labels)
    # buckets whose members lie in several components: each bucket offers one member of its largest component to all others,
    # another one in each round; a document lies in many buckets, so it meets many members of that component
    level = members.select("bucket", "doc").distinct()
    for k in range(OFFERS):
        level = _open(level, labels)
        if level.isEmpty():
            break
        each = level.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.min_by("doc", F.xxhash64("doc", "bucket", F.lit(k))).alias("offer"))
        top = each.groupBy(F.col("bucket").alias("_bucket")).agg(F.max_by(F.struct("component", "offer"), F.struct("n", "component")).alias("top"))
        offers = level.join(top, F.col("bucket") == F.col("_bucket")).where(F.col("component") != F.col("top.component"))
        tests = _as_pairs(offers.select("doc", F.col("top.offer").alias("offer")), "doc", "offer").distinct()
        edges, labels = _joined(edges, links(may_link(tests, small), own), labels)
    level = _open(level, labels)
    if not level.isEmpty():
        edges, labels = _joined(edges, links(unlike(level, small), own), labels)
    # links join groups of equal sets by their first documents
    return _labelled(_labelled(info.select("doc_id", "n_shingles"), "doc_id", first_of, "_first"), "_first", labels, "component_id").drop("_first")


def _open(level: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (bucket, doc, component, size) of the buckets of (bucket, doc) that hold several components."""
    named = _labelled(level.select("bucket", "doc"), "doc", labels, "component")
    several = (named.groupBy(F.col("bucket").alias("_bucket")).agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("size"))
               .where("x < y").select("_bucket", "size"))
    return cut_lineage(named.join(several, F.col("bucket") == F.col("_bucket")).select("bucket", "doc", "component", "size"), "open")


def _joined(edges: DataFrame, more: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links and their components, after more links were found."""
    if more.isEmpty():
        return edges, labels
    edges = cut_lineage(edges.union(more), "links")
    return edges, components(edges)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
