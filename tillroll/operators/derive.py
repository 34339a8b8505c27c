"""Row-level derived fields.

* avg_transaction_value = sales / transactions (NULL when 0).
* store_efficiency_pct  = (store mean ATV / overall mean ATV - 1) * 100, only
  when the overall mean is > 0.
* wow_pct               = row-to-row % change within a store in (date, ties)
  order.
* revenue_contribution_pct = row sales / that date's sales * 100.

The input is read once: rows are dealt by range of (store, date, ties) and
written, with the previous row's sales and the store's ATV sums carried over
partition edges (``functions.carry``).  Day totals and the overall mean are
small aggregates of two columns of the written rows; a day total has one row
for each calendar day (at most 3.7 million can be represented), so it is
broadcast.  No join moves the rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.carry import carried
from ..functions.ordering import default_ties
from ..functions.safe import pct_change, safe_div
from ..functions.scalar import with_row


def add_derived_fields(df: DataFrame, date: str = "date", store: str = "store",
                       sales: str = "weekly_sales", txns: str = "transactions",
                       ties: Sequence[str] = (), position: str | None = None) -> DataFrame:
    """``df`` with the fields that its columns allow.  ``position`` names a
    column for the row's place in (store, date, ties) order, if wanted; it
    needs a store."""
    cols = set(df.columns)
    atv = safe_div(sales, txns)
    has_atv, has_wow = {sales, txns} <= cols, {date, store, sales} <= cols
    out = df
    if store in cols and (has_atv or has_wow):
        line = [c for c in (date,) if c in cols]
        line += list(ties) or default_ties(df, [store, *line], sales)
        out = carried(df, store, line, prev={"_prev_sales": sales} if has_wow else {},
                      totals={"_atv_sum": atv, "_atv_n": F.when(atv.isNotNull(), F.lit(1))} if has_atv else {}, position=position)
    written = out
    if has_wow:
        out = out.withColumn("wow_pct", pct_change(sales, "_prev_sales") * 100).drop("_prev_sales")
    if has_atv:
        out = out.withColumn("avg_transaction_value", atv)
        if store in cols:
            overall = written.agg(F.avg(atv).alias("_overall"))
            mean = F.when(F.col(store).isNotNull(), F.try_divide(F.col("_atv_sum"), F.col("_atv_n")))
            out = (with_row(out, overall)
                   .withColumn("store_efficiency_pct", F.when(F.col("_overall") > 0, (mean / F.col("_overall") - 1) * 100))
                   .drop("_atv_sum", "_atv_n", "_overall"))
    if date in cols and sales in cols:
        day_tot = written.where(F.col(date).isNotNull()).groupBy(F.col(date).alias("_day")).agg(F.sum(sales).alias("_day_total"))
        if isinstance(df.schema[date].dataType, T.DateType):
            day_tot = F.broadcast(day_tot)
        out = (out.join(day_tot, F.col(date) == F.col("_day"), "left")
               .withColumn("revenue_contribution_pct", safe_div(sales, "_day_total") * 100)
               .drop("_day", "_day_total"))
    return out


def prep_common(df: DataFrame, date: str = "date", sales_src: str = "weekly_sales") -> DataFrame:
    """Column harmonisation and date parts.

    ``sales`` copied from ``weekly_sales`` when absent; absent ``profit`` and
    ``quantity`` added as NULL; ``year``, ``month`` and ISO ``week`` of the date.
    """
    out = df
    if "sales" not in df.columns and sales_src in df.columns:
        out = out.withColumn("sales", F.col(sales_src))
    for c in ("profit", "quantity"):
        if c not in df.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    if date in df.columns:
        d = F.to_date(date)
        out = out.withColumn("year", F.year(d)).withColumn("month", F.month(d)).withColumn("week", F.weekofyear(d))
    return out
