"""Language identification: evidence of several kinds, fused by Bayes' rule.

Text: byte trigrams of lower-case words, hashed, against smoothed trigram
shares of each language; a text's log-likelihood counts as that of at most
EVIDENCE trigrams, as neighbouring trigrams are not independent.  Declared
language (markup or metadata): how often texts that look like a language are
declared so, over all rows.  Address suffix: the share of each suffix in each
language, over all rows.  Host prior: language counts of a host, smoothed by
those of its domain, and these by all rows' counts; a row is left out of the
counts that judge it.  The counts are grouped aggregations over all rows; the
languages told apart are all those that LEAST_ROWS rows of the table declare,
and each one's trigram shares come from a bounded sample of its own rows.

A row is accepted when the posterior of its best language reaches
LEAST_PROBABILITY and its text looks more like that language than like random
bytes.

Defined results: rows without evidence of a kind go without it; null and empty
texts (or without a letter) have no language and are rejected; repeated rows
get equal results; without any declared language nothing can be learnt: the
language is null and every row with a letter is accepted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import blocks, byte_lengths, drained, need, small_batches
from .words import PLACE_VALUES, mix

#: Rows that the trigram shares are taken from and their bytes, divided among the languages, but at least so many for each.
SAMPLE_ROWS, SAMPLE_BYTES = 8000, 64 << 20
LANGUAGE_ROWS, LANGUAGE_BYTES = 200, 1 << 20
BUCKETS = 1 << 15
#: Rows of the whole table that must declare a language for it to be learnt.
LEAST_ROWS = 5
#: Languages whose counts a task holds at once.
HELD = 64
#: Trigrams' worth of all languages' shares in each language's.
SHARED = 2000.0
EVIDENCE = 60
#: Weight of the wider counts in a host's or domain's prior, in rows.
SMOOTHING = 10.0
LEAST_PROBABILITY = 0.5
#: No declaration is trusted beyond this.
MOST_TRUST = 0.95
#: A text's mean log-likelihood must beat that of evenly spread trigrams by so much.
LEAST_GAIN = 0.5
BLOCK = 1 << 19
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram of letters and gaps, row of each); a gap is any run of other bytes."""
    import pyarrow.compute as pc

    low = pc.utf8_lower(texts)
    data = np.frombuffer(b"\0".join((x or "").encode() for x in low.to_pylist()) + b"\0", dtype=np.uint8)
    row_of = np.repeat(np.arange(len(texts)), pc.fill_null(pc.binary_length(low), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    letter = _LETTER[data]
    # of a run of other bytes only the first stays, as a gap
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[0] = True
    data, row_of = np.where(letter, data, 32)[kept].astype(np.uint64), row_of[kept]
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    same = (row_of[:-2] == row_of[2:]) & (data[1:-1] != 32)
    h = mix(data[:-2] * PLACE_VALUES[0] + data[1:-1] * PLACE_VALUES[1] + data[2:] * PLACE_VALUES[2])
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)[same], row_of[:-2][same]


class TextModel:
    """Log shares of trigram buckets by language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        every = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * BUCKETS)
        # a language's own shares, drawn towards those of all languages, so that rare trigrams favour no small language
        self.log_share = np.log((counts + SHARED * every) / (counts.sum(axis=1, keepdims=True) + SHARED)).T.astype(np.float32)

    def likelihoods(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(mean log-likelihood of each language, number of trigrams) of each row."""
        at, row = trigrams(texts)
        n = np.bincount(row, minlength=len(texts))
        total = np.stack([np.bincount(row, weights=self.log_share[at, k], minlength=len(texts)) for k in range(len(self.languages))], axis=1)
        return total / np.maximum(n, 1)[:, None], n


def fit_text(df: DataFrame, text: str, declared: str, rows: int = SAMPLE_ROWS) -> TextModel | None:
    """Trigram shares of every language that LEAST_ROWS rows declare; null if there is none.

    ``rows`` are divided among the languages, but a language with fewer gives
    all its rows, and none is asked for less than LANGUAGE_ROWS.
    """
    spark = df.sparkSession
    small_batches(spark)
    with_lang = df.select(F.col(text).alias("t"), F.lower(F.trim(F.col(declared))).alias("l")).where("l <> '' AND t <> ''")
    sizes = {r.l: r.n for r in with_lang.groupBy("l").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_ROWS).collect()}
    if not sizes:
        return None
    each = max(LANGUAGE_ROWS, rows // len(sizes))
    below = [(x, 1 << 31 if n <= each else int(each / n * (1 << 31))) for x, n in sorted(sizes.items())]
    # an Arrow table, not a list: rows of a list would pass through Python workers of a kind of their own, which wait beside the others
    shares = spark.createDataFrame(pa.table({"l": [x for x, _ in below], "below": pa.array([k for _, k in below], pa.int64())}))
    some = with_lang.join(F.broadcast(shares), "l").where(F.shiftrightunsigned(F.xxhash64("t", "l"), 33) < F.col("below"))
    some = some.select("t", "l").repartition(16)
    most = max(LANGUAGE_BYTES, SAMPLE_BYTES // len(sizes)) // 16

    def packed(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["l", "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in drained(batches):
            langs = batch.column(1).to_pylist()
            # a language with enough text in this task takes no more; the others go on
            kept = []
            for i, (lang, size) in enumerate(zip(langs, byte_lengths(batch.column(0)), strict=True)):
                if seen.get(lang, 0) < most:
                    seen[lang] = seen.get(lang, 0) + int(size)
                    kept.append(i)
            texts, mine = batch.column(0).take(pa.array(kept, pa.int64())), np.array([langs[i] for i in kept], dtype=object)
            for a, b in blocks(texts, BLOCK):
                at, row = trigrams(texts.slice(a, b - a))
                for lang in set(mine[a:b]):
                    own = (mine[a:b] == lang)[row]
                    if lang not in sums and len(sums) >= HELD:
                        yield packed(sums)
                        sums = {}
                    sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int32))
                    sums[lang] += np.bincount(at[own], minlength=BUCKETS).astype(np.int32)
        yield packed(sums)

    def add(parts: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(c, dtype=np.int32) for c in parts.column("c").to_pylist())
        return pa.table({"l": parts.column("l").slice(0, 1), "c": pa.array([whole.tobytes()], pa.binary())})

    found = some.mapInArrow(count, "l string, c binary").groupBy("l").applyInArrow(add, "l string, c binary").collect()
    found.sort(key=lambda r: r.l)
    return TextModel([r.l for r in found], np.stack([np.frombuffer(r.c, dtype=np.int32) for r in found])) if found else None


def _doubles(xs) -> Column:
    return F.array(*[F.lit(float(x)) for x in xs])


def _counts_by(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """One row per key with the number of rows of each guessed language it has."""
    each = df.groupBy(F.col(key).alias(f"{prefix}_key"), "guess").agg(F.sum("n").cast("double").alias("n"))
    return each.groupBy(f"{prefix}_key").agg(F.map_from_entries(F.collect_list(F.struct("guess", "n"))).alias(f"{prefix}_n"))


def identify(df: DataFrame, text: str = "text", declared: str = "lang", host: str | None = "source", domain: str | None = None,
             suffix: str | None = None, model: TextModel | None = None) -> DataFrame:
    """``df`` with ``language``, ``probability``, ``accepted`` (columns of those names are replaced); one row per row."""
    need(df, text, *[c for c in (declared, host, domain, suffix) if c])
    model = model or fit_text(df, text, declared)
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return df.withColumns({"language": F.lit(None).cast("string"), "probability": F.lit(0.0), "accepted": has_letter})
    langs, n = model.languages, len(model.languages)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = "struct<mean:array<double>,n:bigint>"

    @F.arrow_udf(kind)
    def likelihood(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in drained(batches):
            parts = [shared.value.likelihoods(texts.slice(a, b - a)) for a, b in blocks(texts, BLOCK)]
            mean = np.concatenate([p[0] for p in parts]) if parts else np.empty((0, n))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(mean) + 1, n), pa.int32()), pa.array(mean.ravel(), pa.float64()))
            yield pa.StructArray.from_arrays([lists, pa.array(np.concatenate([p[1] for p in parts]) if parts else [], pa.int64())], names=["mean", "n"])

    null = F.lit(None).cast("string")
    said = F.lower(F.trim(F.col(declared)))
    evidence = {"_said": F.when(said != "", F.coalesce(F.array_position(F.array(*map(F.lit, langs)), said), F.lit(0)).cast("int")),
                "_host": F.col(host) if host else null, "_domain": F.col(domain) if domain else null, "_suffix": F.col(suffix) if suffix else null}
    own = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(F.struct(*own).alias("_row"), likelihood(F.col(text)).alias("_text"), *[c.alias(k) for k, c in evidence.items()])
    best = F.when(F.col("_text.n") > 0, F.array_position("_text.mean", F.array_max("_text.mean")).cast("int") - 1)
    rows = rows.withColumn("guess", best)

    # counts over all rows; partial sums first, so a hot host is a few rows of each task
    # rows without a guess are counted too and left out of what was written: a filter below the counts would read the texts
    # by a second call of ``likelihood``, in another worker of the same task
    counts = rows.groupBy("_said", "_host", "_domain", "_suffix", "guess").agg(F.count(F.lit(1)).alias("n"))
    found = cut_lineage(counts, "language-counts").where("guess IS NOT NULL")
    told = np.zeros((n + 1, n))
    for r in found.where("_said IS NOT NULL").groupBy("_said", "guess").agg(F.sum("n").alias("n")).collect():
        told[r["_said"], r["guess"]] = r["n"]
    share = (told + 0.5) / (told.sum(axis=0) + 0.5 * (n + 1))
    # a declaration agrees with probability MOST_TRUST at most
    for k in range(n):
        right = share[k + 1, k]
        if right > MOST_TRUST:
            others = np.arange(n + 1) != k + 1
            share[others, k] *= (1 - MOST_TRUST) / (1 - right)
            share[k + 1, k] = MOST_TRUST
    everywhere = np.ones(n)
    for r in found.groupBy("guess").agg(F.sum("n").alias("n")).collect():
        everywhere[r["guess"]] += r["n"]
    wide = _doubles(everywhere / everywhere.sum())

    def spread(counts: Column) -> Column:
        return F.when(counts.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.element_at(counts, k), F.lit(0.0))))

    joined = rows
    for column, prefix in (("_host", "host"), ("_domain", "domain"), ("_suffix", "suffix")):
        if (host, domain, suffix)[("_host", "_domain", "_suffix").index(column)]:
            table = _counts_by(found.where(F.col(column).isNotNull()), column, prefix)
            joined = joined.join(table, F.col(column) == F.col(f"{prefix}_key"), "left")
            joined = joined.withColumn(f"{prefix}_n", spread(F.col(f"{prefix}_n")))
        else:
            joined = joined.withColumn(f"{prefix}_n", F.lit(None).cast("array<double>"))

    def smoothed(counts: str, prior: Column) -> Column:
        others = F.transform(F.col(counts), lambda c, k: F.greatest(c - F.when(F.col("guess") == k, 1.0).otherwise(0.0), F.lit(0.0)))
        total = F.aggregate(others, F.lit(0.0), lambda a, c: a + c)
        return F.coalesce(F.zip_with(others, prior, lambda c, p: (c + SMOOTHING * p) / (total + SMOOTHING)), prior)

    prior = smoothed("host_n", smoothed("domain_n", wide))
    total_of = _doubles(everywhere)
    by_suffix = F.coalesce(F.zip_with(F.col("suffix_n"), total_of, lambda c, t: F.log((c + 0.5) / (t + 1.0))), _doubles(np.zeros(n)))
    table = df.sparkSession.createDataFrame(pa.table({"_said_key": pa.array(range(n + 1), pa.int32()), "_said_log": pa.array(np.log(share).tolist(), pa.list_(pa.float64()))}))
    joined = joined.join(F.broadcast(table), F.col("_said") == F.col("_said_key"), "left")
    by_said = F.coalesce("_said_log", _doubles(np.zeros(n)))
    weight = F.least(F.col("_text.n"), F.lit(EVIDENCE)).cast("double")
    by_text = F.transform("_text.mean", lambda m: F.when(F.col("_text.n") > 0, m * weight).otherwise(0.0))
    joined = joined.select("_row", "_text", prior.alias("_p"), by_suffix.alias("_s"), by_said.alias("_d"), by_text.alias("_t"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    joined = joined.withColumn("_score", add(add(F.transform("_p", lambda p: F.log(p)), F.col("_s")), add(F.col("_d"), F.col("_t"))))
    joined = joined.withColumn("_top", F.array_max("_score"))
    joined = joined.withColumn("_best", F.array_position("_score", F.col("_top")).cast("int"))
    some = F.col("_text.n") > 0
    sure = 1.0 / F.aggregate("_score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    gain = F.element_at("_text.mean", F.col("_best")) + float(np.log(BUCKETS))
    kept = [c for c in df.columns if c not in ("language", "probability", "accepted")]
    return joined.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in kept],
        F.when(some, F.element_at(F.array(*map(F.lit, langs)), F.col("_best"))).alias("language"),
        F.when(some, sure).otherwise(0.0).alias("probability"),
        F.coalesce(some & (sure >= LEAST_PROBABILITY) & (gain >= LEAST_GAIN), F.lit(False)).alias("accepted"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Text, declared language, host, domain and suffix of (page_id, url, html)."""
    need(pages, "url", "html")
    bare = F.regexp_replace("html", r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.substring(F.regexp_extract("html", r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})\b""", 1), 1, 3)
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return pages.select("*", bare.alias("page_text"), declared.alias("declared"), F.when(host != "", host).alias("host"),
                        F.when(host != "", F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
                        F.when(host != "", F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return identify(docs).select("doc_id", "language", "probability", "accepted", "lang", "source")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of evidence, for web pages."""
    pages = page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).drop("html")
    found = identify(pages, text="page_text", declared="declared", host="host", domain="domain", suffix="suffix")
    return found.select("page_id", "language", "probability", "accepted", "declared", "host", "suffix")
