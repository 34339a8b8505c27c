"""Hard negatives of anchor vectors by segment summary filtering.

Each component becomes a whole number, floor(scale * x).  Every vector is cut
into segments, and each segment's mean and deviation (the length of what is
left after the mean) are stored beside it.  For one segment of two vectors the
inner product is length * mean * mean, give or take the product of the
deviations, so sums over segments bound a score from both sides.  A few wide
segments are tried first, then the narrow ones they consist of, and only what
both let through is scored exactly in whole numbers.

Anchors meet rows in cells of a grid: rows are dealt into stripes, anchors
into groups, both of bounded size and by hash of the id, so no label, vector
or anchor is a key of the exchange and every task holds one cell's rows.  A
cell returns at most a few rows for each anchor (its own best); a second step
keeps the best of all cells.  This is done once for the positives and once,
with their scores known, for the negatives.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part, nor do those with a component of 2**24 or
more in size after scaling, whose scores would not fit 64 bits.  Vectors of
different lengths are compared as if the shorter one ended in zeros; an empty
vector scores 0 with all.  Rows that repeat an id are rows of their own, but
no "other rows" of one another; anchors that repeat an id are each answered.
Ties in score go to the smaller id.  Empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import need

#: Segments of the finer and of the coarser summary.
FINE, COARSE = 16, 4
#: Rows of a stripe and anchors of a group, at most (about 64 MB with their summaries at 64 components).
STRIPE, GROUP = 32_768, 16_384
#: Anchors that are bounded at once: their bounds take 16 bytes for each row of the stripe.
AT_ONCE = 64
LARGEST = 1 << 24


# ---- summaries and bounds, in numpy ----

def matrix(q: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as rows of float64 whole numbers, zeros after each end; the width is a multiple of FINE."""
    q = q.combine_chunks() if isinstance(q, pa.ChunkedArray) else q
    n = np.diff(q.offsets.to_numpy()) if len(q) else np.empty(0, np.int64)
    width = width or max(FINE, -(-int(n.max(initial=0)) // FINE) * FINE)
    out = np.zeros((len(q), width))
    out[np.arange(width)[None, :] < n[:, None]] = q.flatten().to_numpy(zero_copy_only=False)
    return out


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(means, deviations) of FINE segments of each row."""
    s = x.reshape(len(x), FINE, -1)
    mean = s.mean(axis=2)
    return mean, np.sqrt(((s - mean[:, :, None]) ** 2).sum(axis=2))


def coarser(mean: np.ndarray, dev: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Summaries of COARSE segments from those of the FINE ones (each of ``length`` components)."""
    m, d = mean.reshape(len(mean), COARSE, -1), dev.reshape(len(dev), COARSE, -1)
    wide = m.mean(axis=2)
    return wide, np.sqrt((d ** 2).sum(axis=2) + length * ((m - wide[:, :, None]) ** 2).sum(axis=2))


class Side:
    """Vectors of one side of a cell with their summaries, ordered by label."""

    def __init__(self, t: pa.Table, width: int):
        label, ids = t["label"].to_numpy(), t["vec_id"].to_numpy()
        order = np.lexsort((ids, label))
        self.label, self.id = label[order], ids[order]
        self.x = matrix(t["q"], width)[order]
        self.length = width // FINE
        if width == t["width"][0].as_py():
            fine = tuple(np.array(t[c].combine_chunks().flatten()).reshape(-1, FINE)[order] for c in ("means", "devs"))
        else:  # summarised at another width: the stripe holds longer vectors
            fine = summaries(self.x)
        self.fine = fine
        self.coarse = coarser(*fine, self.length)
        self.key = t["key"].to_numpy()[order] if "key" in t.column_names else None


def bounds(a: tuple, b: tuple, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) score of each pair by the segments' summaries, a little wider than rounding can move them."""
    mid, off = length * (a[0] @ b[0].T), a[1] @ b[1].T
    off += 0.25 + 1e-9 * (np.abs(mid) + off)
    return mid - off, mid + off


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products; through float64 where no sum can pass 2**53."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[-1] < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity if there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _refined(a: Side, rows: slice, b: Side, cols: slice, passes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the pairs that both levels of summaries let through; ``passes`` turns bounds into a mask."""
    cut = lambda s, part: tuple(v[part] for v in s)
    first = passes(*bounds(cut(a.coarse, rows), cut(b.coarse, cols), a.length * (FINE // COARSE)), None)
    some = np.flatnonzero(first.any(axis=0))
    if not len(some):
        return (np.empty(0, np.int64),) * 3
    near = tuple(v[cols][some] for v in b.fine)
    second = first[:, some] & passes(*bounds(cut(a.fine, rows), near, a.length), some)
    left = np.flatnonzero(second.any(axis=0))
    score = exact(a.x[rows], b.x[cols][some[left]])
    r, c = np.nonzero(second[:, left])
    return r, some[left][c], score[r, c]


def best_positives(a: Side, b: Side, k: int) -> tuple[np.ndarray, ...]:
    """(anchor key, id, score) of each anchor's k best other rows of its label in the cell."""
    out = []
    for label in np.intersect1d(a.label, b.label):
        lo, hi = np.searchsorted(a.label, label), np.searchsorted(a.label, label, side="right")
        cols = slice(np.searchsorted(b.label, label), np.searchsorted(b.label, label, side="right"))
        for at in range(lo, hi, AT_ONCE):
            rows = slice(at, min(hi, at + AT_ONCE))
            other = a.id[rows][:, None] != b.id[cols][None, :]

            def passes(least, most, some, other=other):
                own = other if some is None else other[:, some]
                return own & (most >= _kth(np.where(own, least, -np.inf), k)[:, None])
            r, c, score = _refined(a, rows, b, cols, passes)
            order = np.lexsort((b.id[cols][c], -score, r))
            r, c, score = r[order], c[order], score[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            keep = place < k
            out.append((a.key[rows][r[keep]], b.id[cols][c[keep]], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def best_negatives(a: Side, wanted: np.ndarray, b: Side, k: int, low: int, high: int) -> tuple[np.ndarray, ...]:
    """(anchor key, which positive, id, score) of the k best rows of other labels in each positive's band.

    ``wanted`` has each anchor's positive scores, NaN after the last one.
    """
    out, everything = [], slice(0, len(b.id))
    for at in range(0, len(a.id), AT_ONCE):
        rows = slice(at, min(len(a.id), at + AT_ONCE))
        differ = (a.label[rows][:, None] != b.label[None, :]) & (a.id[rows][:, None] != b.id[None, :])
        p = wanted[rows]

        def passes(least, most, some, differ=differ, p=p):
            own = differ if some is None else differ[:, some]
            keep = np.zeros_like(own)
            for j in range(p.shape[1]):
                from_, to = low * p[:, j] / 100, high * p[:, j] / 100  # NaN compares false
                sure = own & (most <= to[:, None]) & (least >= from_[:, None])
                third = _kth(np.where(sure, least, -np.inf), k)
                keep |= own & (most >= np.fmax(third, from_ - 0.25)[:, None]) & (least <= (to + 0.25)[:, None]) & (from_ <= to)[:, None]
            return keep
        r, c, score = _refined(a, rows, b, everything, passes)
        for j in range(p.shape[1]):
            whole = np.where(np.isnan(p[:, j]), 0, p[:, j]).astype(np.int64)[r]
            fits = ~np.isnan(p[r, j]) & (low * whole <= 100 * score) & (100 * score <= high * whole)
            rr, cc, ss = r[fits], c[fits], score[fits]
            order = np.lexsort((b.id[cc], -ss, rr))
            rr, cc, ss = rr[order], cc[order], ss[order]
            keep = np.arange(len(rr)) - np.searchsorted(rr, rr) < k
            out.append((a.key[rows][rr[keep]], np.full(keep.sum(), j), b.id[cc[keep]], ss[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4


# ---- Spark ----

def whole_numbers(df: DataFrame, vector: str, scale: int, largest: int = LARGEST) -> DataFrame:
    """``df`` with ``q`` = floor(scale * x) of each component; rows whose vector has no such form are left out."""
    fit = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < largest))
    # a null inside makes forall null, not false
    return df.where(F.coalesce(fit, F.lit(False))).withColumn("q", F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def summarised(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, label, q) with their segments' means and deviations."""
    kind = "struct<width:int,means:array<double>,devs:array<double>>"

    @F.arrow_udf(kind)
    def run(q: pa.Array) -> pa.Array:
        n = np.diff(q.offsets.to_numpy())
        widths = np.maximum(FINE, -(-n // FINE) * FINE)
        mean, dev = np.zeros((len(q), FINE)), np.zeros((len(q), FINE))
        for w in np.unique(widths):
            at = np.flatnonzero(widths == w)
            mean[at], dev[at] = summaries(matrix(q.take(pa.array(at)), int(w)))
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, (len(q) + 1) * FINE, FINE), pa.int32()), pa.array(v.ravel())) for v in (mean, dev)]
        return pa.StructArray.from_arrays([pa.array(widths, pa.int32()), *lists], names=["width", "means", "devs"])

    return rows.select("vec_id", "label", "q", run("q").alias("s")).select("vec_id", "label", "q", "s.width", "s.means", "s.devs")


def _cells(rows: DataFrame, anchors: DataFrame, stripes: int, groups: int, schema: str, work) -> DataFrame:
    """``work(anchors' table, rows' table, width)`` for every (group of anchors, stripe of rows)."""
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    left = rows.withColumn("stripe", deal(stripes, 1)).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = anchors.withColumn("grp", deal(groups, 2)).withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    names = [x.split()[0] for x in schema.split(",")]

    def cell(r: pa.Table, a: pa.Table) -> pa.Table:
        if not len(r) or not len(a):
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        width = max(max(x["width"].to_numpy().max() for x in (r, a)), FINE)
        # one width for all rows of a cell, so their summaries have like segments
        r, a = (x if (x["width"].to_numpy() == width).all() else x.set_column(x.column_names.index("width"), "width", pa.array(np.zeros(len(x), np.int32))) for x in (r, a))
        found = work(Side(a, int(width)), a, Side(r, int(width)))
        return pa.table({n: pa.array(np.asarray(v, np.int64)) for n, v in zip(names, found, strict=True)})

    return left.groupBy("stripe", "grp").cogroup(right.groupBy("stripe", "grp")).applyInArrow(cell, schema)


def mine(df: DataFrame, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows that satisfy ``anchor``.  A positive is one of the
    ``positives`` best other rows of the anchor's label; its negatives are the
    ``negatives`` best rows of other labels with a score of ``low`` to
    ``high`` percent of the positive's.
    """
    need(df, key, label, vector)
    own = df.select(F.col(key).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), F.col(vector).alias("_v"),
                    F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    fit = whole_numbers(own.where("vec_id IS NOT NULL AND label IS NOT NULL"), "_v", scale)
    kept = fit.select("vec_id", "label", "q", "is_anchor")
    rows = cut_lineage(summarised(kept), "negatives-rows")
    anchors = cut_lineage(summarised(kept.where("is_anchor")).withColumn("key", F.monotonically_increasing_id()), "negatives-anchors")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_rows, n_anchors = rows.count(), anchors.count()
    stripes, groups = max(2 * parts, -(-n_rows // STRIPE)), max(1, -(-n_anchors // GROUP))

    found = _cells(rows, anchors, stripes, groups, "key bigint, positive_id bigint, positive_score bigint",
                   lambda a, _, b: best_positives(a, b, positives))
    order = Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id")
    best = found.withColumn("which", F.row_number().over(order)).where(F.col("which") <= positives)
    best = cut_lineage(best, "negatives-positives")

    scores = best.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("which", "positive_score"))), lambda x: x["positive_score"]).alias("wanted"))
    asked = anchors.join(scores, "key")

    def work(a: Side, table: pa.Table, b: Side):
        # as ``Side`` orders its rows
        at = np.lexsort((table["vec_id"].to_numpy(), table["label"].to_numpy()))
        wanted = np.full((len(at), positives), np.nan)
        for i, w in enumerate(table["wanted"].to_pylist()):
            wanted[i, :len(w)] = w
        return best_negatives(a, wanted[at], b, negatives, low, high)

    near = _cells(rows, asked, stripes, groups, "key bigint, which bigint, negative_id bigint, negative_score bigint", work)
    order = Window.partitionBy("key", "which").orderBy(F.desc("negative_score"), "negative_id")
    hard = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).withColumn("which", F.col("which") + 1)
    ids = anchors.select("key", F.col("vec_id").alias("anchor_id"))
    return hard.join(best, ["key", "which"]).join(ids, "key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(df.withColumn("label", shifted), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH fit AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.q, r.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM fit a JOIN fit r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other AS negative_id,
       p.positive_score, n.score AS negative_score
FROM positive p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other)
QUALIFY row_number() OVER w <= 3
"""
