"""The KPI result bundle (S4-S6): clean once, derive, then every output is its
own lazy DataFrame over the cleaned fact.

The cleaned fact is materialised once in the shared checkpoint folder
(reliable checkpoint, survives executor loss) because a dozen outputs read
it.  The bundle is a dict of DataFrames; ``write_bundle`` is the sink.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import derive as D
from ..operators import entities as E
from ..operators import filters as FL
from ..operators import outliers as O
from ..operators import weekly as wk
from ..functions.scalar import one_row


def compute_kpis(raw: DataFrame, rules: dict, filters: dict | None = None,
                 ties: Sequence[str] = (), outputs: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Clean -> filter -> derive -> outliers -> weekly/entity outputs.

    Cleaning runs on the whole input (the imputation median is global) and
    its lineage is cut once; filters then apply to the cleaned rows.  Only
    the requested ``outputs`` are built (all by default); each is lazy apart
    from the small tables the skew-safe helpers materialise.  Without a
    required column, or without rows, the outputs are empty.  The rules'
    outlier ``method`` flags rows; ``treat`` applies to ``flagged_rows``:
    flag keeps them, remove drops flagged ones, winsorize clips to the fences.
    """
    want = set(outputs or OUTPUTS)
    if C.missing_columns(raw, rules):
        raw = C.empty_input(raw, rules)
    cleaned = FL.apply_filters(C.clean(raw, rules, materialize=True), filters)
    freq = ((rules.get("kpis", {}) or {}).get("time_freq") or "W")
    oc = rules.get("outliers", {}) or {}
    group_by, k = oc.get("group_by", "store"), float(oc.get("k", 1.5))
    if group_by not in cleaned.columns:
        group_by = None
    out: dict[str, DataFrame] = {}
    fences = None
    if want & {"summary", "flagged_rows"} and oc.get("method", "iqr") == "iqr":
        fences = O.iqr_fences(cleaned, "weekly_sales", group_by, k)
    derived = D.add_derived_fields(cleaned, ties=ties, position="_at") if want & {"stores", "flagged_rows"} else None
    if "summary" in want:
        n_derived = len(cleaned.columns) + 4
        counts = cleaned.agg(F.count(F.lit(1)).cast("long").alias("record_count")).select(
            "record_count", F.col("record_count").alias("rows"), F.lit(n_derived + 1).cast("long").alias("cols"))
        flagged = O.flag_by_rules(cleaned, oc, "weekly_sales", group_by, fences)
        out["summary"] = one_row(counts, wk.weekly_trend(cleaned, freq=freq),
                                 flagged.agg(F.count_if("is_outlier").cast("long").alias("outliers")))
    if "kpis_weekly" in want:
        out["kpis_weekly"] = wk.weekly_kpis(cleaned, freq=freq)
    if "stores" in want:
        out["stores"] = E.store_metrics(derived, ties=ties, position="_at")
    if "stores_meta" in want:
        out["stores_meta"] = E.store_summary(cleaned)
    if "regional" in want:
        out["regional"] = E.region_metrics(cleaned, ties=ties)
    if want & {"departments", "departments_meta"}:
        dept = E.department_metrics(cleaned, ties=ties, rounded=False)
        out["departments"] = dept.withColumn("cumulative_pct", F.round("cumulative_pct", 6))
        out["departments_meta"] = E.pareto_meta(dept)
    if "flagged_rows" in want:
        derived = derived.drop("_at")
        treat = oc.get("treat", "flag")
        if treat == "winsorize":
            out["flagged_rows"] = O.treat_outliers(derived, "weekly_sales", group_by, k, treat)
        else:
            rows = O.flag_by_rules(derived, oc, "weekly_sales", group_by, fences)
            out["flagged_rows"] = rows.where("NOT is_outlier").drop("is_outlier") if treat == "remove" else rows
    return {k2: v for k2, v in out.items() if k2 in want}


OUTPUTS = ("summary", "kpis_weekly", "stores", "stores_meta", "regional", "departments",
           "departments_meta", "flagged_rows")


def write_bundle(bundle: dict[str, DataFrame], path: str, names: Sequence[str] | None = None) -> list[str]:
    """S4 sink: each output as parquet under ``path/<name>``."""
    written = []
    for name, df in bundle.items():
        if names and name not in names:
            continue
        out = f"{path.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(out)
        written.append(out)
    return written


def preview(df: DataFrame, n: int = 25) -> DataFrame:
    """S3: first rows for display (the limit is the feature)."""
    return df.limit(n)
