"""Readers for the parquet tables, the sales fact view and CSV uploads."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .inference import inferred

# The fact contract (required columns, in order).
FACT_COLUMNS = ["date", "store", "department", "region", "weekly_sales", "transactions"]
# Tie-break columns carried by the fact view (G14): they make row order total.
TIE_COLUMNS = ["l_orderkey", "l_linenumber"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Largest dimension (bytes of its files, all columns) we broadcast; above it the join sort-merges.
BROADCAST_MAX_BYTES = int(os.environ.get("TILLROLL_BROADCAST_MAX_BYTES", str(64 << 20)))


def bounded_broadcast(df: DataFrame, whole: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Broadcast-hint ``df`` only if the files of the table ``whole``, which it is a part of, hold at most ``max_bytes`` now.

    The size comes from the file listing that planning needs anyway: no job,
    and made anew for every plan.  Only a few columns of a table are ever
    broadcast, so what is sent is of the order of its files at most.  The hint
    keeps the planner from ever building the fact side: size estimates can
    undershoot for a heavily pruned fact scan.
    """
    limit = BROADCAST_MAX_BYTES if max_bytes is None else max_bytes
    size = int(str(whole._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def fact_view(spark: SparkSession, sf_dir: str, with_ties: bool = True) -> DataFrame:
    """The sales fact over the star schema (FIXTURES.md section 3).

    lineitem -> supplier -> nation -> region, lineitem -> part, all inner.
    Dimension sides are broadcast only behind a check of their files' size
    (``bounded_broadcast``); past the bound (supplier/part at large scale
    factors) the joins sort-merge on the keys, with AQE splitting a hot
    supplier or part key.  The fact side is never a build side.  Only the
    referenced columns reach each scan.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_shipdate", "l_extendedprice", "l_discount", "l_quantity")
    whole = {t: table(spark, sf_dir, t) for t in ("supplier", "nation", "region", "part")}
    su = whole["supplier"].select("s_suppkey", "s_name", "s_nationkey")
    na = whole["nation"].select("n_nationkey", "n_regionkey")
    rg = whole["region"].select("r_regionkey", "r_name")
    pa = whole["part"].select("p_partkey", "p_brand")
    geo = (su.join(bounded_broadcast(na, whole["nation"]), su.s_nationkey == na.n_nationkey)
             .join(bounded_broadcast(rg, whole["region"]), F.col("n_regionkey") == rg.r_regionkey)
             .select("s_suppkey", "s_name", "r_name"))
    j = (li.join(bounded_broadcast(geo, whole["supplier"]), li.l_suppkey == geo.s_suppkey)
           .join(bounded_broadcast(pa, whole["part"]), li.l_partkey == pa.p_partkey))
    cols = [
        F.to_date("l_shipdate").alias("date"),
        F.col("s_name").alias("store"),
        F.col("p_brand").alias("department"),
        F.col("r_name").alias("region"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("weekly_sales"),
        F.col("l_quantity").cast("bigint").alias("transactions"),
    ]
    if with_ties:
        cols += [F.col(c) for c in TIE_COLUMNS]
    return j.select(*cols)


def dirty_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact view as an uploaded file would arrive: every column a string,
    with defects placed by fixed rules on the keys (same rules in the oracle).

    The whole table is kept; defects are a deterministic function of keys.
    """
    f = fact_view(spark, sf_dir)
    k, ln = F.col("l_orderkey"), F.col("l_linenumber")
    date_s = F.date_format("date", "yyyy-MM-dd")
    date_s = F.when(k % 227 == 0, F.lit("2001-13-01")).otherwise(date_s)
    store = F.when(k % 211 == 0, F.lit(None)).when(ln == 7, F.concat(F.lit(" "), "store", F.lit("\t"))).otherwise(F.col("store"))
    dept = F.when(k % 199 == 0, F.lit(None)).when(ln == 6, F.concat(F.lit("\t"), "department")).otherwise(F.col("department"))
    region = F.when(k % 193 == 0, F.lit(None)).otherwise(F.col("region"))
    s = F.col("weekly_sales").cast("string")
    sales = (F.when(k % 97 == 0, F.lit(None))
             .when(k % 101 == 0, F.lit("abc"))
             .when(k % 103 == 0, F.concat(F.lit("-"), s))
             .when(k % 107 == 0, (F.col("weekly_sales") * 100).cast("decimal(18,4)").cast("string"))
             .otherwise(s))
    t = F.col("transactions").cast("string")
    txns = (F.when(k % 89 == 0, F.lit(None))
            .when(k % 109 == 0, F.lit("12.5"))
            .when(k % 113 == 0, F.lit("20000"))
            .when(k % 131 == 0, F.lit("0"))
            .otherwise(t))
    # Exact duplicate rows: a second copy of some lines, made in the same scan.
    copies = F.explode(F.when(k % 53 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return f.select(date_s.alias("date"), store.alias("store"), dept.alias("department"),
                    region.alias("region"), sales.alias("weekly_sales"), txns.alias("transactions"),
                    "l_orderkey", "l_linenumber", copies.alias("_copy")).drop("_copy")


# Texts that an upload's empty cells are commonly written as.
NULL_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
              "NaN", "None", "n/a", "nan", "null")


def read_sales_csv(spark: SparkSession, path: str, multi_line: bool | None = None, infer: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """CSV upload with header (S1), columns by name as the file has them, in any
    order; columns nobody asked for are kept, missing ones stay missing (C1
    reports them).

    Everything is text, as the cleaning step coerces types, unless ``infer``:
    then columns get the narrowest type that holds all their values
    (``sources.inference``), but for those named in ``keep``.

    A folder's files must share one header (checked, never matched by
    position).  Quoted cells may hold line feeds and doubled quotes.  Files in
    which none does are read in splits, the others one by one; which they are
    is looked up in one scan of the lines unless ``multi_line`` says so.
    """
    if multi_line is None:
        multi_line = spans_lines(spark, path)
    raw = (spark.read.option("header", True).option("multiLine", multi_line).option("enforceSchema", False)
           .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path))
    named = raw.toDF(*[c.lstrip("\ufeff").strip() for c in raw.columns])
    text = named.select(*[F.when(~F.col(f"`{c}`").isin(*NULL_TEXTS), F.col(f"`{c}`")).alias(c) for c in named.columns])
    return inferred(text, keep) if infer else text


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell of the CSV files holds a line feed: some line then has an odd number of quotes.

    One scan of the files' lines in splits; doubled quotes count as two, so a
    line that ends inside a quoted cell is always odd.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).limit(1).isEmpty()
