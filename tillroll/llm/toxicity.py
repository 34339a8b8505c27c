"""Toxicity: a convolutional text classifier trained in numpy.

Words (letter and digit runs, in lower case) are hashed twice
into tables of BUCKETS rows; a word's embedding is the sum of its two rows,
and a word whose buckets no frequent training word holds is the zero vector.
Filters of several widths slide over the whole text, each keeps its maximum,
and a logistic layer weighs the rectified maxima.  Training is gradient
descent on a bounded sample of labelled rows; the first embedding dimension
starts from each word's log-odds.  The bias and a threshold for each language
are chosen on all labelled rows that were not trained on, from counts by score
bin; a threshold is no input of the score.

Labels are read only where crc32(id as text) mod 5 is not 0.

Defined results: null and empty texts (or without a word) get the score of no
evidence; repeated rows get equal scores; with no usable labels, or of one
class only, all scores are the smoothed share of toxic labels; a doc_id with
several labels counts as toxic if any of them does; null labels are no labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import blocks, hash_share, need, small_batches
from .words import mix, words_of

#: Training reads at most so many labelled rows, first by hash of the id, and at most so many bytes of text of them.
SAMPLE_ROWS = 16000
SAMPLE_BYTES = 24 << 20
BUCKETS = 1 << 18
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 4
#: A word counts if at least so many training texts have it (more in large samples: the root of their number by 16).
LEAST_TEXTS = 3
#: Texts' worth of the overall share that a word's log-odds start from.
PRIOR = 4.0
STEPS, BATCH, RATE, DECAY = 2500, 32, 0.05, 1e-4
#: Score bins of calibration, per unit of log-odds.
BINS = 32
#: Labelled calibration rows that a language needs for a threshold of its own.
LEAST_CALIBRATION = 50
BLOCK = 1 << 19
_NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_SEED = 7


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row with one more entry at the end)."""
    import pyarrow.compute as pc

    w = words_of(pc.utf8_lower(texts), separators=_NOT_WORD)
    return w.hash, w.first


def buckets_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64), (mix(h) >> np.uint64(40) & np.uint64(BUCKETS - 1)).astype(np.int64)


class Classifier:
    """Parameters and forward pass; ``rows`` maps a bucket to its embedding row, 0 being the zero vector."""

    def __init__(self, known: np.ndarray, odds: np.ndarray, base: float):
        rng = np.random.default_rng(_SEED)
        a, b = buckets_of(known)
        self.rows = np.zeros((2, BUCKETS), dtype=np.int32)
        self.table = []
        for k, at in enumerate((a, b)):
            held = np.unique(at)
            self.rows[k, held] = np.arange(1, len(held) + 1)
            e = rng.normal(0, 0.02, (len(held) + 1, DIM)).astype(np.float32)
            e[:, 0] = 0
            np.add.at(e[:, 0], self.rows[k, at], (odds / 2).astype(np.float32))
            e[0] = 0
            self.table.append(e)
        self.filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for w, f in zip(WIDTHS, self.filters, strict=True):
            f[:, 0, :] = np.abs(rng.normal(1.0 / w, 0.1, (w, FILTERS)))
        self.shift = np.full(len(WIDTHS) * FILTERS, -1.0, dtype=np.float32)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.3, dtype=np.float32)
        self.bias = np.float32(base)
        self.thresholds: dict[str | None, float] = {}
        self.constant: float | None = None

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedding rows of words; a word is known only if both its buckets are."""
        a, b = buckets_of(h)
        a, b = self.rows[0, a], self.rows[1, b]
        known = (a > 0) & (b > 0)
        return a * known, b * known

    def pooled(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's maximum of each filter, and the word where its window begins (-1: a row without words)."""
        n, rows = len(h), len(first) - 1
        best = np.zeros((rows, len(self.out)), dtype=np.float32)
        where = np.full((rows, len(self.out)), -1, dtype=np.int64)
        filled = np.flatnonzero(np.diff(first) > 0)
        if not n or not len(filled):
            return best, where
        a, b = self.places(h)
        # unknown words are zero in every filter: only windows that touch a known word need computing
        known = np.flatnonzero(a)
        e = self.table[0][a[known]] + self.table[1][b[known]]
        row = np.repeat(np.arange(rows), np.diff(first))
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            conv = np.zeros((n, FILTERS), dtype=np.float32)
            for t in range(w):
                start = known - t
                ok = start >= 0
                ok[ok] = row[start[ok]] == row[known[ok]]
                conv[start[ok]] += e[ok] @ f[t]
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            top = np.maximum.reduceat(conv, first[filled])
            best[filled, cols] = top
            hit = conv == np.repeat(top, np.diff(first)[filled], axis=0)
            for j in range(FILTERS):
                at = np.flatnonzero(hit[:, j])
                r, i = np.unique(row[at], return_index=True)
                where[r, k * FILTERS + j] = at[i]
        return best, where

    def logits(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        best, _ = self.pooled(h, first)
        live = (np.diff(first) > 0)[:, None]
        return self.bias + (np.maximum(best + self.shift, 0) * live) @ self.out

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(*hashed_words(texts)).astype(np.float64), -60, 60)))

    def step(self, docs: list[np.ndarray], y: np.ndarray, rate: float) -> None:
        """One step of gradient descent on a batch."""
        h, first = np.concatenate(docs), np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        best, where = self.pooled(h, first)
        z = best + self.shift
        active = (z > 0) & (where >= 0)
        x = np.where(active, z, 0)
        p = 1 / (1 + np.exp(-np.clip(self.bias + x @ self.out, -30, 30)))
        g = ((p - y) / len(y)).astype(np.float32)
        g_z = np.where(active, g[:, None] * self.out, 0).astype(np.float32)
        self.out -= rate * (x.T @ g + DECAY * self.out)
        self.bias -= rate * g.sum()
        self.shift -= rate * g_z.sum(0)
        a, b = self.places(h)
        row = np.repeat(np.arange(len(docs)), np.diff(first))
        r, c = np.nonzero(g_z)
        at, grad = where[r, c], g_z[r, c]
        steps = []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            mine = (c >= k * FILTERS) & (c < (k + 1) * FILTERS)
            for t in range(w):
                word = at[mine] + t
                ok = word < len(h)
                ok[ok] = row[word[ok]] == r[mine][ok]
                word, j, gg = word[ok], c[mine][ok] - k * FILTERS, grad[mine][ok]
                e = self.table[0][a[word]] + self.table[1][b[word]]
                g_f = np.zeros_like(f[t])
                np.add.at(g_f.T, j, gg[:, None] * e)
                steps.append((f, t, g_f, word, gg[:, None] * f[t][:, j].T))
        for f, t, g_f, word, g_e in steps:
            f[t] -= rate * (g_f + DECAY * f[t])
            # embeddings of a batch's few pooled words move faster than shared parameters
            for table, place in ((self.table[0], a), (self.table[1], b)):
                np.add.at(table, place[word], -10 * rate * g_e)
                table[0] = 0


def kept_out(n: int) -> np.ndarray:
    """The rows of a sample of ``n`` (in hash order) that are not trained on."""
    return np.arange(n) % 5 == 4


def train(docs: list[np.ndarray], y: np.ndarray) -> Classifier:
    """Fit on hashed documents, but for those kept out."""
    base = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.5
    if len(y) < 20 or y.min() == y.max():
        none = Classifier(np.empty(0, np.uint64), np.empty(0), 0.0)
        none.constant = float(min(base, 0.499) if len(y) == 0 else base)
        return none
    fit = np.flatnonzero(~kept_out(len(y)))
    distinct = [np.unique(docs[i]) for i in fit]
    labels = np.repeat(y[fit], [len(d) for d in distinct])
    words, group = np.unique(np.concatenate(distinct), return_inverse=True)
    del distinct
    seen = np.bincount(group, minlength=len(words))
    bad = np.bincount(group, weights=labels, minlength=len(words))
    # share of toxic texts among those with the word, drawn towards the overall share, as log-odds against it
    share = (bad + PRIOR * base) / (seen + PRIOR)
    odds = np.log(share / (1 - share)) - np.log(base / (1 - base))
    kept = seen >= max(LEAST_TEXTS, int(np.sqrt(len(fit)) / 16))
    model = Classifier(words[kept], odds[kept], float(np.log(base / (1 - base))))
    rng = np.random.default_rng(_SEED)
    toxic, clean = fit[y[fit] == 1], fit[y[fit] == 0]
    half, some = BATCH // 2, np.empty(0, dtype=np.int64)
    for k in range(STEPS):
        # both classes in each batch; the rarer one is drawn again as needed
        if len(some) < half:
            some = rng.permutation(clean)
        batch = np.concatenate([some[:half], rng.choice(toxic, min(half, max(4, len(toxic))))])
        some = some[half:]
        model.step([docs[i] for i in batch], y[batch].astype(np.float32), RATE / (1 + 4 * k / STEPS))
    return model


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap of scores among those with the fewest errors."""
    values, at = np.unique(p, return_inverse=True)
    return best_cut(values, values, np.bincount(at, weights=y), np.bincount(at, weights=1 - y))


def best_cut(low: np.ndarray, high: np.ndarray, bad: np.ndarray, good: np.ndarray) -> float:
    """``best_threshold`` from ascending bins: least and greatest score, toxic and clean rows of each."""
    errors = np.concatenate(([0], np.cumsum(bad))) + np.concatenate((np.cumsum(good[::-1])[::-1], [0]))
    ends, starts = np.concatenate(([0.0], high)), np.concatenate((low, [1.0]))
    gaps = np.where(errors == errors.min(), starts - ends, -1)
    k = int(np.argmax(gaps))
    return float((ends[k] + starts[k]) / 2)


def calibrate(model: Classifier, docs: DataFrame, labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> None:
    """Move the bias so that 0.5 separates best over all languages, then set each language's threshold.

    ``labelled`` has the id ``k`` and the label ``y`` of all rows that count;
    scores are counted by language and bin, so the driver gets bins only.
    """
    logit = F.least(F.greatest(F.log(F.col("p") / (1 - F.col("p"))), F.lit(-30.0)), F.lit(30.0))
    scored = score(docs.select(F.col(key).alias("d"), F.col(lang).alias("l"), F.col(text).alias("t")), model, "t", "p").select("d", "l", logit.alias("z"))
    bad, good = F.sum("bad").alias("bad"), F.sum("good").alias("good")
    ends = F.min("low").alias("low"), F.max("high").alias("high")
    rows = scored.join(labelled, F.col("d") == F.col("k")).select("l", "z", F.floor(F.col("z") * BINS).alias("bin"), (F.col("y") > 0).cast("long").alias("bad"))
    bins = cut_lineage(rows.groupBy("l", "bin").agg(bad, F.sum(1 - F.col("bad")).alias("good"), F.min("z").alias("low"), F.max("z").alias("high")), "score-bins")

    def cut(found: list, move: float) -> float:
        of = lambda c: np.array([getattr(r, c) for r in found], dtype=float)
        p = lambda z: 1 / (1 + np.exp(move - z))
        return best_cut(p(of("low")), p(of("high")), of("bad"), of("good"))

    every = bins.groupBy("bin").agg(bad, good, *ends).orderBy("bin").collect()
    if not sum(r.bad for r in every) or not sum(r.good for r in every):
        return
    at = cut(every, 0.0)
    move = float(np.log(at / (1 - at))) if 0 < at < 1 else 0.0
    model.bias -= np.float32(move)
    known = bins.where("l IS NOT NULL").groupBy("l").agg(bad, good).where((F.col("bad") > 0) & (F.col("good") > 0) & (F.col("bad") + F.col("good") >= LEAST_CALIBRATION))
    own: dict[str, list] = {}
    for r in bins.join(known.select("l"), "l", "left_semi").orderBy("l", "bin").toLocalIterator():
        own.setdefault(r.l, []).append(r)
    model.thresholds = {name: cut(found, move) for name, found in own.items()}


def usable_labels(labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Labels outside the held-out fold that are not null."""
    return labels.where(F.col(label).isNotNull() & (F.crc32(F.col(key).cast("string")) % 5 != 0))


def by_id(labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """One label ``y`` for each id ``k``."""
    return labels.groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
           label: str = "toxic", rows: int = SAMPLE_ROWS) -> list:
    """Labelled documents as hashed words, at most ``rows`` of them and SAMPLE_BYTES of text, in hash order."""
    usable = (by_id(hash_share(usable_labels(labels, key, label), F.xxhash64(F.col(key)), 2 * rows), key, label)
              .withColumn("o", F.xxhash64(F.col("k"))).orderBy("o", "k").limit(rows))
    found = docs.select(F.col(key).alias("d"), F.col(text).alias("t"), F.col(lang).alias("l")).join(F.broadcast(usable), F.col("d") == F.col("k"))
    small_batches(docs.sparkSession)

    @F.arrow_udf("binary")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for a, b in blocks(texts, BLOCK):
                h, first = hashed_words(texts.slice(a, b - a))
                out += [h[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
            yield pa.array(out, pa.binary())

    sized = found.select("o", "k", "y", "l", "t", F.octet_length(F.coalesce("t", F.lit(""))).alias("n"))
    # of at most `rows` rows those count, in hash order, whose text still fits; a row that does not is passed over
    total, fits = 0, []
    for r in sized.groupBy("o", "k").agg(F.sum("n").alias("n")).orderBy("o", "k").collect():
        if total + r.n <= SAMPLE_BYTES:
            total += r.n
            fits.append((r.k,))
    if not fits:
        return []
    inside = docs.sparkSession.createDataFrame(fits, docs.select(F.col(key).alias("f")).schema)
    return (sized.join(F.broadcast(inside), F.col("k") == F.col("f"), "left_semi")
            .select("o", "k", "y", "l", hashed("t").alias("h")).orderBy("o", "k", "h").collect())


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic",
        rows: int = SAMPLE_ROWS) -> Classifier:
    """Train on a bounded sample, calibrate on all other usable labels."""
    found = sample(docs, labels, key, text, lang, label, rows)
    model = train([np.frombuffer(r.h, dtype=np.uint64) for r in found], np.array([float(r.y) for r in found]))
    if model.constant is None:
        taught = sorted({r.k for r, out in zip(found, kept_out(len(found)), strict=True) if not out})
        ids = docs.sparkSession.createDataFrame([(k,) for k in taught], docs.select(F.col(key).alias("f")).schema)
        labelled = by_id(usable_labels(labels, key, label), key, label)
        calibrate(model, docs, labelled.join(F.broadcast(ids), F.col("k") == F.col("f"), "left_anti"), text, lang, key)
    return model


def score(df: DataFrame, model: Classifier, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score of each whole text, 0 to 1."""
    need(df, text)
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [shared.value.scores(texts.slice(a, b - a)) for a, b in blocks(texts, BLOCK)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return df.withColumn(out, run(F.col(text)))


def flagged(model: Classifier, lang, value):
    """Whether a score reaches its language's threshold (0.5 for languages without one)."""
    limit = F.lit(0.5)
    for name, t in sorted(model.thresholds.items()):
        limit = F.when(lang == name, t).otherwise(limit)
    return value >= limit


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                      flagged(model, F.col("lang"), F.col("score")).alias("flagged"))
