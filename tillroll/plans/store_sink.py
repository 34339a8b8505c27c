"""Weekly store sums as a bucketed table that is replaced year by year.

The table is partitioned by year and bucketed (and sorted) by store.  A new
upload replaces only the years that it holds: a dynamic partition overwrite,
so running it again changes nothing.  Rows of a store are in one bucket of
every year, so sums by store, and joins of one year with another by store,
read the files as they are and need no exchange.

Buckets cut by hash of the store; what is stored has one row per store and
week, so a store that holds a third of all sales rows holds no more rows here
than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import week_end

COLUMNS = ["store", "week", "sales", "transactions", "rows", "year"]


def store_weeks(df: DataFrame, store: str = "store", date: str = "date", sales: str = "weekly_sales", txns: str = "transactions") -> DataFrame:
    """(store, week, sales, transactions, rows, year): one row per store and week-ending Sunday; year of that Sunday."""
    known = df.where(F.col(store).isNotNull() & F.col(date).isNotNull())
    g = known.groupBy(F.col(store).alias("store"), week_end(date).alias("week")).agg(
        F.sum(F.col(sales).cast("decimal(38,6)")).alias("sales"), F.sum(F.col(txns).cast("double")).alias("transactions"), F.count(F.lit(1)).alias("rows"))
    return g.withColumn("year", F.year("week")).select(*COLUMNS)


def write_store_weeks(weeks: DataFrame, table: str, path: str, buckets: int | None = None) -> None:
    """Create the table at ``path``, or replace the years of ``weeks`` in it; other years stay.

    All rows of a bucket of a year go to one task and one file, so the number
    of files is the number of buckets times the years written.
    """
    spark = weeks.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not spark.catalog.tableExists(table):
        (weeks.limit(0).write.partitionBy("year").bucketBy(n, "store").sortBy("store").option("path", path).format("parquet").saveAsTable(table))
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    try:
        spark.conf.set(mode, "dynamic")
        weeks.repartition(n, "store").select(*COLUMNS).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(mode, before)
    spark.catalog.refreshTable(table)


def store_years(spark: SparkSession, table: str) -> DataFrame:
    """(store, year, sales, weeks, previous_sales, change): each year of a store against the one before, straight from the buckets."""
    rows = spark.table(table)
    year = rows.groupBy("store", "year").agg(F.sum("sales").alias("sales"), F.count(F.lit(1)).alias("weeks"))
    line = Window.partitionBy("store").orderBy("year")
    before = F.when(F.lag("year").over(line) == F.col("year") - 1, F.lag("sales").over(line))
    s, b = F.col("sales").cast("double"), F.col("_sales").cast("double")
    return year.withColumn("_sales", before).select("store", "year", s.alias("sales"), "weeks", b.alias("previous_sales"), F.try_divide(s - b, b).alias("change"))
