"""Outlier flags and treatments.

Fences come from the exact, skew-safe ``group_quantiles``.  The per-group
table (one row per store) is joined back to the rows: AQE broadcasts it when
it is small, and otherwise splits a hot store's partition (skew join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import counted_values, quantiles_of
from ..functions.scalar import with_row
from ..session import cut_lineage


def iqr_fences(df: DataFrame, value: str, group_by: str | None, k: float = 1.5,
               min_n: int = 4) -> DataFrame:
    """Per group (or global): q1, q3, lower/upper fence and usable flag (n >= min_n)."""
    return fences_of(counted_values(df, [group_by] if group_by else [], value), group_by, k, min_n)


def fences_of(values: DataFrame, group_by: str | None, k: float = 1.5, min_n: int = 4) -> DataFrame:
    """``iqr_fences`` from a table of counted values."""
    keys = [group_by] if group_by else []
    q = quantiles_of(values, keys, [0.25, 0.75], names=["q1", "q3"], with_count="n")
    iqr = F.col("q3") - F.col("q1")
    return q.select(*keys, "n", "q1", "q3",
                    (F.col("q1") - k * iqr).alias("lower_fence"),
                    (F.col("q3") + k * iqr).alias("upper_fence"),
                    (F.col("n") >= min_n).alias("_usable"))


def _join_group_table(df: DataFrame, table: DataFrame, group_by: str | None) -> DataFrame:
    if group_by:
        return df.join(table, group_by, "left")
    # A global aggregate is one row: attached as a scalar subquery, no join.
    return with_row(df, table)


def flag_outliers_iqr(df: DataFrame, value: str = "weekly_sales", group_by: str | None = "store",
                      k: float = 1.5, min_n: int = 4, keep_fences: bool = False) -> DataFrame:
    """O1/O2: is_outlier when value lies outside [q1 - k*iqr, q3 + k*iqr].

    Groups with fewer than ``min_n`` non-null values are not flagged; NULL
    values and NULL group keys are never flagged (G15, G6).
    """
    if group_by is not None and group_by not in df.columns:
        group_by = None
    return apply_fences(df, iqr_fences(df, value, group_by, k, min_n), value, group_by, keep_fences)


def apply_fences(df: DataFrame, f: DataFrame, value: str = "weekly_sales", group_by: str | None = "store",
                 keep_fences: bool = False) -> DataFrame:
    """Flag ``df`` rows against a fence table from ``iqr_fences`` (fences can
    be computed once and applied to several frames with the same rows)."""
    j = _join_group_table(df, f, group_by)
    x = F.col(value).cast("double")
    flag = F.coalesce(F.col("_usable") & ((x < F.col("lower_fence")) | (x > F.col("upper_fence"))),
                      F.lit(False))
    out = j.withColumn("is_outlier", flag)
    drop = ["n", "q1", "q3", "_usable"] + ([] if keep_fences else ["lower_fence", "upper_fence"])
    return out.drop(*drop)


def outlier_count(df: DataFrame, value: str = "weekly_sales", group_by: str | None = "store", k: float = 1.5, min_n: int = 4) -> DataFrame:
    """O3: number of flagged rows.  Rows are read once: the counted values that give the fences also tell how many rows lie
    outside them."""
    if group_by is not None and group_by not in df.columns:
        group_by = None
    values = counted_values(df, [group_by] if group_by else [], value)
    j = _join_group_table(values, fences_of(values, group_by, k, min_n), group_by)
    outside = F.col("_usable") & ((F.col("_x") < F.col("lower_fence")) | (F.col("_x") > F.col("upper_fence")))
    return j.agg(F.coalesce(F.sum(F.when(outside, F.col("_c"))), F.lit(0)).cast("long").alias("outliers"))


def outlier_table(df: DataFrame, k: float = 1.5, n: int = 50, date: str = "date",
                  store: str = "store", department: str = "department",
                  value: str = "weekly_sales", ties: tuple[str, ...] = ()) -> DataFrame:
    """Per-store fences with no minimum group size, the n largest flagged
    rows, labelled Spike/Drop/Anomaly against the median of those n rows.

    The limit is the feature (a top-n table).  The median is over at most n
    rows, so it is a bounded one-row aggregate.
    """
    d = df.where(F.col(value).isNotNull() & F.col(date).isNotNull())
    flagged = flag_outliers_iqr(d, value, store, k, min_n=1).where("is_outlier")
    top = (flagged.select(date, store, department, F.col(value).cast("double").alias("sales"), *ties)
           .orderBy(F.col("sales").desc(), date, store, department, *ties).limit(n))
    med = top.agg(F.median("sales").alias("_m"))
    s = F.signum(F.col("sales") - F.col("_m"))
    label = F.when(s > 0, "Spike").when(s < 0, "Drop").otherwise("Anomaly")
    return with_row(top, med).select(date, store, department, "sales",
                                                  label.alias("z_flag"), *ties)


def flag_outliers_zscore(df: DataFrame, value: str = "weekly_sales", group_by: str | None = "store",
                         k: float = 3.0) -> DataFrame:
    """D4 zscore: |x - mean| / stddev_samp > k within the group (partial aggregates)."""
    keys = [group_by] if group_by else []
    x = F.col(value).cast("double")
    st = (df.where(F.col(value).isNotNull() & (F.lit(True) if not group_by else F.col(group_by).isNotNull()))
          .groupBy(*keys).agg(F.avg(x).alias("_mu"), F.stddev_samp(x).alias("_sd")))
    j = _join_group_table(df, st, group_by)
    z = F.try_divide(F.abs(x - F.col("_mu")), F.col("_sd"))
    return j.withColumn("is_outlier", F.coalesce(z > k, F.lit(False))).drop("_mu", "_sd")


def flag_outliers_mad(df: DataFrame, value: str = "weekly_sales", group_by: str | None = "store",
                      k: float = 3.0) -> DataFrame:
    """D4 mad: |x - median| > k * 1.4826 * median(|x - median|) within the group."""
    centre = median_and_mad(df, value, group_by)
    j = _join_group_table(df, centre, group_by)
    distance = F.abs(F.col(value).cast("double") - F.col("_med"))
    flag = F.coalesce(distance > k * 1.4826 * F.col("_mad"), F.lit(False))
    return j.withColumn("is_outlier", flag).drop("_med", "_mad")


def median_and_mad(df: DataFrame, value: str = "weekly_sales", group_by: str | None = "store") -> DataFrame:
    """(group, _med, _mad): median, and median of the distances from it.

    Rows are counted by value once; the distances are those of the counted
    values, each as often as its value, so neither the rows nor a row-sized
    join are needed for the second median.
    """
    keys = [group_by] if group_by else []
    values = counted_values(df, keys, value)
    med = quantiles_of(values, keys, [0.5], names=["_med"], with_count=None)
    if group_by:
        med = cut_lineage(med, "medians")
    apart = counted_values(_join_group_table(values, med, group_by), keys, F.abs(F.col("_x") - F.col("_med")), times="_c")
    mad = quantiles_of(apart, keys, [0.5], names=["_mad"], with_count=None)
    return med.join(mad, group_by) if group_by else with_row(med, mad)


def flag_by_rules(df: DataFrame, outliers: dict, value: str = "weekly_sales", group_by: str | None = "store",
                  fences: DataFrame | None = None) -> DataFrame:
    """Flag rows by the rules' ``method``: iqr (given or own fences), zscore or mad."""
    method, k = outliers.get("method", "iqr"), float(outliers.get("k", 1.5))
    if method == "iqr":
        return apply_fences(df, iqr_fences(df, value, group_by, k) if fences is None else fences, value, group_by)
    if method == "zscore":
        return flag_outliers_zscore(df, value, group_by, k)
    if method == "mad":
        return flag_outliers_mad(df, value, group_by, k)
    raise ValueError(f"unknown outlier method {method!r}")


def treat_outliers(df: DataFrame, value: str = "weekly_sales", group_by: str | None = "store",
                   k: float = 1.5, treat: str = "flag") -> DataFrame:
    """D4 treatments: flag | winsorize (clip to the fences) | remove (drop flagged)."""
    f = flag_outliers_iqr(df, value, group_by, k, keep_fences=True)
    if treat == "flag":
        return f.drop("lower_fence", "upper_fence")
    if treat == "remove":
        return f.where(~F.col("is_outlier")).drop("lower_fence", "upper_fence", "is_outlier")
    if treat == "winsorize":
        x = F.col(value).cast("double")
        w = (F.when(F.col("is_outlier") & (x < F.col("lower_fence")), F.col("lower_fence"))
             .when(F.col("is_outlier") & (x > F.col("upper_fence")), F.col("upper_fence"))
             .otherwise(x))
        return f.withColumn(value, w).drop("lower_fence", "upper_fence", "is_outlier")
    raise ValueError(f"unknown outlier treatment {treat!r}")


def outlier_report(df: DataFrame, value: str = "weekly_sales", group_by: str = "store",
                   k: float = 1.5, threshold: int = 3) -> DataFrame:
    """D4 report_threshold: groups with more than ``threshold`` flagged rows."""
    f = flag_outliers_iqr(df, value, group_by, k)
    return (f.where(F.col(group_by).isNotNull()).groupBy(group_by)
            .agg(F.count_if("is_outlier").cast("long").alias("outliers"))
            .where(F.col("outliers") > threshold))
