"""Document fingerprints by winnowing (Spark SQL functions only).

A text's tokens are runs of letters, digits and combining marks (cut after
24), in lower case, and every other visible character by itself; so are the
characters of scripts that put no spaces between words.  The hash of each run of GRAM
tokens rolls up from those of its shorter runs; in every window of WINDOW
successive hashes the smallest is chosen, the rightmost of equal ones.  The
fingerprint is the chosen hashes with their positions.  Two texts that share
GRAM + WINDOW - 1 successive tokens share a chosen hash; no shared run
shorter than GRAM tokens makes them share one.

Defined results: null and empty texts (and those without a token) have the
empty fingerprint, which is like nothing (0); fewer than GRAM tokens are one
run; fewer than WINDOW hashes are one window; equal texts have equal
fingerprints; texts are read whole.  Positions hold any text that fits a
column (2**31 tokens); hashes are compared by 32 bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import need

GRAM = 3
WINDOW = 4
#: Scripts whose words are not set apart by spaces.
UNSPACED = ("Han", "Hiragana", "Katakana", "Bopomofo", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan")
TOKEN = r"[\p{L}\p{N}\p{M}&&[^" + "".join(rf"\p{{Is{s}}}" for s in UNSPACED) + r"]]{1,24}|\S"
#: A chosen hash and its position share one long: HASH_BITS of hash above POSITION_BITS of counted-down position,
#: so that the least long is the least hash and, of equal ones, the rightmost.
POSITION_BITS, HASH_BITS = 31, 32
_LAST = (1 << POSITION_BITS) - 1
_LONGS = "array<bigint>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once."""
    return F.transform(F.array(value), body)[0]


def shifted(xs: Column, by: int, f: Callable[[Column, Column], Column]) -> Column:
    """f(x[i], x[i + by]) for every i; the last ``by`` have no partner (null)."""
    return F.zip_with(xs, F.slice(xs, by + 1, F.greatest(F.size(xs), F.lit(1))), f)


def gram_hashes(text: Column) -> Column:
    """Hashes of all runs of GRAM tokens, in order; each rolls up from the hashes of its shorter runs."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    hash2 = lambda a, b: F.xxhash64(a, b)

    def rolled(v: Column) -> Column:
        runs = v
        for by in range(1, GRAM):
            runs = F.zip_with(runs, F.slice(v, by + 1, F.greatest(F.size(v), F.lit(1))), hash2)
        return (F.when(F.size(v) == 0, F.array().cast(_LONGS)).when(F.size(v) < GRAM, F.array(F.xxhash64(v)))
                .otherwise(F.slice(runs, F.lit(1), F.size(v) - (GRAM - 1))))

    return let(F.transform(tokens, lambda t: F.xxhash64(t)), rolled)


def chosen(hashes: Column) -> Column:
    """The packed hashes that winnowing keeps, in order of position."""
    pack = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 64 - HASH_BITS), POSITION_BITS) + (F.lit(_LAST) - i)
    least = lambda a, b: F.least(a, b)  # noqa: E731  a missing partner counts for nothing

    def windows(m: Column) -> Column:
        # the least of 2, 4, ... successive values; WINDOW is a power of two
        out, width = m, 1
        while width < WINDOW:
            out = let(out, _doubled(width, least))
            width *= 2
        return let(out, lambda xs: F.array_distinct(F.slice(xs, F.lit(1), F.greatest(F.size(xs) - (WINDOW - 1), F.least(F.size(xs), F.lit(1))))))

    return let(F.transform(hashes, pack), windows)


def _doubled(width: int, f: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    return lambda xs: shifted(xs, width, f)


def fingerprint(text: Column) -> Column:
    """Winnowed fingerprint of a text: packed longs, see ``places`` and ``values``."""
    return chosen(gram_hashes(text))


def values(packed: Column) -> Column:
    """The distinct hashes of a fingerprint, in four bytes each (shifted into the range of an int)."""
    return F.array_distinct(F.transform(packed, lambda x: (F.shiftright(x, POSITION_BITS) - (1 << (HASH_BITS - 1))).cast("int")))


def written(packed: Column) -> Column:
    """position:hash (hexadecimal) of each kept hash, by position, comma-joined."""
    return F.array_join(F.transform(packed, lambda x: F.concat_ws(
        ":", (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST))).cast("string"), F.hex(F.shiftright(x, POSITION_BITS)))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Twice the number of shared hashes, by the number of both sides' hashes; 0 if either side has none."""
    return F.coalesce(F.when(F.size(a) + F.size(b) > 0, F.size(F.array_intersect(a, b)) * 2.0 / (F.size(a) + F.size(b))), F.lit(0.0))


def next_ids(ids: DataFrame, key: str) -> DataFrame:
    """Each distinct value of ``key`` (null first) with the next one, ``next_key``; after the last comes the first.

    Ids are dealt by range and kept sorted; one row per partition links
    neighbouring partitions, so no task holds all ids.
    """
    spark = ids.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(key).asc_nulls_first()
    ranged = ids.select(key).distinct().repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut_lineage(ranged, "ids").withColumn("_pid", F.shiftright("_at", 33))
    heads = placed.groupBy("_pid").agg(F.min(F.struct("_at", key)).alias("_head"))
    everything = Window.orderBy("_pid")  # one row per partition
    first = F.first("_head").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("_pid", F.coalesce(F.lead("_head").over(everything), first)[key].alias("_after"))
    inside = Window.partitionBy("_pid").orderBy("_at")
    linked = placed.withColumns({"_next": F.lead(key).over(inside), "_has": F.lead("_at").over(inside).isNotNull()})
    return linked.join(F.broadcast(heads), "_pid").select(key, F.when(F.col("_has"), F.col("_next")).otherwise(F.col("_after")).alias("next_key"))


def compare_with_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint each row's text and its edited text, and compare both and the next document's.

    The edited text has the last quarter of the code points replaced by as
    many of the next document's first ones.  The next document is that of the
    next larger id (null is smallest; after the last the first); where several
    rows share that id, the one with the smallest text counts.

    Texts are exchanged once, alone; fingerprints are made where they are
    compared, and a document sends the one before it a quarter of that one's
    length in text and its hashes.
    """
    need(df, key, text)
    c_type = df.schema[key].dataType
    # an id and its nullness are two plain columns: all joins and the grouping below then share one partitioning
    named = lambda c, x: [F.coalesce(c, F.lit(0).cast(c_type)).alias(f"{x}_id"), c.isNull().alias(f"{x}_null")]
    docs = df.select(*named(F.col(key), "doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # how much the document before may take from this one: the quarter of the longest row of its id
    sizes = df.select(F.col(key).alias("id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n")).groupBy("id").agg(F.max("n").alias("n"))
    links = next_ids(sizes, "id").select(*named(F.col("id"), "own"), *named(F.col("next_key"), "next"))
    quarters = sizes.select(*named(F.col("id"), "q"), (F.col("n") / 4).cast("int").alias("quarter"))
    same = lambda x, y: (F.col(f"{x}_id") == F.col(f"{y}_id")) & (F.col(f"{x}_null") == F.col(f"{y}_null"))
    asks = links.join(quarters, same("own", "q")).drop("q_id", "q_null")
    given = (docs.join(asks, same("doc", "next")).groupBy("own_id", "own_null")
             .agg(F.min(F.struct(F.substring(F.col("text"), F.lit(1), F.col("quarter")).alias("head"), F.length("text").alias("n"),
                                 values(fingerprint(F.col("text"))).alias("hashes"))).alias("given")))
    both = docs.join(given, same("doc", "own")).withColumn("n_chars", F.length("text").cast("long"))
    kept = F.col("n_chars") - F.floor(F.col("n_chars") / 4)
    edited = F.concat(F.substring("text", F.lit(1), kept.cast("int")), F.substring(F.col("given.head"), F.lit(1), F.floor(F.col("n_chars") / 4).cast("int")))
    made = both.select(F.when(~F.col("doc_null"), F.col("doc_id")).alias("doc_id"), "n_chars", fingerprint(F.col("text")).alias("fp"), F.col("given.hashes").alias("next_hashes"),
                       edited.alias("edited"))
    made = made.select("doc_id", "n_chars", "fp", "next_hashes", F.sha2(F.col("edited"), 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fp"))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("fp")).alias("fingerprint"), written(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(values(F.col("fp")), values(F.col("edited_fp"))).alias("near_edited"),
        likeness(values(F.col("fp")), F.col("next_hashes")).alias("near_next"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
