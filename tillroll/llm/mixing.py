"""Mixing sources to target weights by systematic sampling (Spark SQL functions only).

A document's size is its number of words.  Sources in code-point order (null
last) weigh 1, 2, 3, 1, 2, 3, ... and share the total size; no source gets
more than three times its own size, and what it can't take is shared again by
weight among the rest until none is above.  The final targets have a closed
form: sources are taken in ascending order of cap by weight, and those whose
cap lies below the common level are capped; two prefix sums over the source
table find the level.

Within a source each document is expected ``target / source size`` times.
Documents are ordered by size, then id; the running sum of expected copies
starts from one offset per source (a digest of seed and source), and a
document is emitted once per integer that the sum crosses.  As neighbours are
of like size, what a source takes differs from its target by less than its
largest document.

A hot source is spread by range over all partitions: no window and no group
holds a source's documents.  Defined results: null and empty texts have size
0; they take part in the order and add no words.  Rows equal in source, size
and id are interchangeable.  A source without words has target 0.  Null
sources form one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import need

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = "mix-1"
#: Offsets are multiples of 1 / OFFSETS: sums with whole numbers stay exact.
OFFSETS = 65536
_LOCAL = (1 << 33) - 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def positions(df: DataFrame, order: list[Column], sums: tuple[str, ...] = (), name: str = "position") -> DataFrame:
    """Add the 1-based position in ``order`` and, for each column of ``sums``, its running sum ``<column>_upto``.

    Rows are dealt by range and sorted within partitions; the written table
    fixes partition and place; one row per partition carries the offsets.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_at", F.monotonically_increasing_id()))
    local = cut_lineage(ranged, "positions").withColumn("_pid", F.shiftright("_at", 33))
    totals = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_sum_{c}") for c in sums])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("_pid", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_0")
                                      for c in ("_rows", *(f"_sum_{s}" for s in sums))])
    out = local.join(F.broadcast(offsets), "_pid")
    out = out.withColumn(name, F.col("_rows_0") + F.col("_at").bitwiseAND(F.lit(_LOCAL)) + 1)
    within = Window.partitionBy("_pid").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({f"{s}_upto": F.sum(s).over(within) + F.col(f"_sum_{s}_0") for s in sums})
    return out.drop("_pid", "_at", "_rows_0", *[f"_sum_{s}_0" for s in sums])


def source_targets(sizes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, n_docs, source_size) -> with ``docs_before``, ``weight`` and ``target``; sources must be distinct."""
    ranked = positions(sizes, [F.col("source").asc_nulls_last()], ("n_docs",), "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    whole = "decimal(20,0)"
    ranked = ranked.select(
        "source", "n_docs", "source_size", (F.col("n_docs_upto") - F.col("n_docs")).alias("docs_before"),
        weight.cast(whole).alias("weight"), (F.col("source_size") * max_copies).cast(whole).alias("cap"))
    # cap by weight, as a whole number: the weights divide their common multiple
    level = (F.col("cap") * (F.lit(6) / F.col("weight")).cast("decimal(4,0)")).cast("decimal(28,0)")
    filled = positions(ranked.withColumn("level", level), [F.col("level"), F.col("source").asc_nulls_last()], ("cap", "weight"), "place")
    filled = cut_lineage(filled, "filled")
    wide = "decimal(38,0)"
    total = filled.agg(F.sum("source_size").cast(wide)).scalar()
    weights = filled.agg(F.sum("weight").cast(wide)).scalar()
    capped = (F.col("cap_upto").cast(wide) * F.col("weight") + F.col("cap").cast(wide) * (weights - F.col("weight_upto").cast(wide))
              <= total * F.col("weight"))
    marked = filled.withColumn("capped", capped)
    held = marked.where("capped")
    rest = (total - F.coalesce(held.agg(F.sum("cap").cast(wide)).scalar(), F.lit(0).cast(wide))).cast("double")
    free = (weights - F.coalesce(held.agg(F.sum("weight").cast(wide)).scalar(), F.lit(0).cast(wide))).cast("double")
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight").cast("double") * (rest / free))
    return marked.select("source", "n_docs", "source_size", "docs_before", F.col("weight").cast("int"), target.alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """A source's offset in [0, 1)."""
    named = F.when(source.isNull(), F.lit(f"{seed}|")).otherwise(F.concat(F.lit(f"{seed}|="), source))
    return F.conv(F.substring(F.md5(named), 1, 4), 16, 10).cast("double") / OFFSETS


def mix(df: DataFrame, size: Column, source: str = "source", key: str = "doc_id", max_copies: int = MAX_COPIES,
        seed: str = SEED) -> DataFrame:
    """``df`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies``; one row per row of ``df``."""
    need(df, source, key)
    mine = df.select(F.col(source).alias("mix_source"), size.alias("mix_size"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("mix_row"))
    placed = positions(mine, [F.col("mix_source").asc_nulls_last(), F.col("mix_size"), F.col(f"mix_row.`{key}`")], name="mix_position")
    sizes = placed.groupBy(F.col("mix_source").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("mix_size").alias("source_size"))
    goals = source_targets(sizes, max_copies)
    joined = placed.join(goals, placed["mix_source"].eqNullSafe(goals["source"]))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda j: F.floor(offset(F.col("mix_source"), seed) + each * j)
    place = F.col("mix_position") - F.col("docs_before")
    copies = F.least(upto(place) - upto(place - 1), F.lit(max_copies)).cast("long")
    return joined.select("mix_row.*", "mix_size", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"),
                         copies.alias("mix_copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix``, each as often as its copies, without the columns that it added."""
    kept = [c for c in mixed.columns if not c.startswith("mix_")]
    times = mixed.withColumn("mix_copy", F.explode(F.array_repeat(F.lit(0), F.col("mix_copies").cast("int"))))
    return times.select(*kept)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out = mix(slim, F.col("size"))
    return out.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
                      (F.col("mix_copies") * F.col("size")).alias("taken"))


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, count(*) AS n, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, 3 * source_size::HUGEINT AS cap,
         sum(3 * source_size::HUGEINT) OVER w AS cap_upto, sum(weight) OVER w AS weight_upto,
         sum(source_size::HUGEINT) OVER () AS total, sum(weight) OVER () AS weights
  FROM s WINDOW w AS (ORDER BY (3 * source_size::HUGEINT) * (6 // weight), source NULLS LAST ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, cap_upto * weight + cap * (weights - weight_upto) <= total * weight AS capped FROM f),
l AS (
  SELECT (any_value(total) - coalesce(sum(cap) FILTER (WHERE capped), 0))::DOUBLE
         / nullif((any_value(weights) - coalesce(sum(weight) FILTER (WHERE capped), 0))::DOUBLE, 0) AS lvl FROM c),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE weight::DOUBLE * lvl END AS target,
         ('0x' || substr(md5('{SEED}|' || coalesce('=' || source, '')), 1, 4))::INTEGER::DOUBLE / {OFFSETS} AS u
  FROM c, l),
p AS (
  SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS j FROM d)
SELECT p.doc_id, p.size, t.source_size, t.target,
       (p.size * least(floor(u + r * j) - floor(u + r * (j - 1)), {MAX_COPIES}))::BIGINT AS taken
FROM p JOIN (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r FROM t) t
  ON p.source IS NOT DISTINCT FROM t.source
"""
