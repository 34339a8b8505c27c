"""Schema checks, coercion and cleaning.

Order as in the rules contract: required columns -> types -> dates -> trim
-> dedupe -> clip -> null policy.  Everything is one lazy chain.  The only
global value (the median for ``impute_median``) is a one-row aggregate
attached as a scalar subquery, never a driver round-trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import group_quantiles
from ..functions.safe import clip
from ..functions.text import read_date, strip_ws
from ..session import cut_lineage
from ..functions.scalar import with_row

# Date formats tried in order when a date column arrives as text.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "yyyy/MM/dd"]
# Declared "float" columns parse to an exact decimal (money); sums stay exact.
FLOAT_TYPE = "decimal(38,6)"


class MissingColumnsError(ValueError):
    pass


def missing_columns(df: DataFrame, rules: dict) -> list[str]:
    """Required columns absent from the frame (sorted)."""
    req = (rules.get("dataset", {}) or {}).get("required_columns", []) or []
    return sorted(set(req) - set(df.columns))


def empty_input(df: DataFrame, rules: dict) -> DataFrame:
    """No rows, with every required column: what an upload without some of them is treated as."""
    return df.limit(0).withColumns({c: F.lit(None).cast("string") for c in missing_columns(df, rules)})


def require_columns(df: DataFrame, rules: dict) -> DataFrame:
    miss = missing_columns(df, rules)
    if miss:
        raise MissingColumnsError(f"Missing required columns: {', '.join(miss)}")
    return df


def _parse_date(c: str, dtype: T.DataType, formats: list[str]):
    if isinstance(dtype, T.DateType):
        return F.col(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(F.col(c))
    s = F.col(c).cast("string")
    return F.coalesce(*[read_date(s, f) for f in formats])


def _parse_int(c: str, dtype: T.DataType):
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return F.col(c).cast("bigint")
    x = F.col(c).try_cast("double")
    # Fractional values cannot be integers: NULL, counted by the report.
    return F.when(x == F.floor(x), x.try_cast("bigint"))


def _parse_float(c: str, dtype: T.DataType):
    if isinstance(dtype, (T.DecimalType, T.DoubleType, T.FloatType, T.LongType, T.IntegerType)):
        return F.col(c)
    return F.col(c).try_cast(FLOAT_TYPE)


def coerce_types(df: DataFrame, rules: dict) -> DataFrame:
    """One projection of try_* casts by declared type; unknown columns kept."""
    dt = (rules.get("dataset", {}) or {}).get("dtypes", {}) or {}
    formats = (rules.get("dataset", {}) or {}).get("date_formats") or DATE_FORMATS
    types = dict(df.dtypes)
    schema = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in df.columns:
        kind = dt.get(c)
        if kind == "datetime":
            e = _parse_date(c, schema[c], formats)
        elif kind in ("string", "category"):
            e = F.col(c).cast("string") if types[c] != "string" else F.col(c)
        elif kind == "float":
            e = _parse_float(c, schema[c])
        elif kind == "int":
            e = _parse_int(c, schema[c])
        else:
            e = F.col(c)
        out.append(e.alias(c))
    return df.select(*out)


def date_columns(rules: dict) -> list[str]:
    dt = (rules.get("dataset", {}) or {}).get("dtypes", {}) or {}
    return [c for c, k in dt.items() if k == "datetime"]


def drop_invalid_dates(df: DataFrame, rules: dict, date: str = "date") -> DataFrame:
    """Rows whose date did not parse are removed."""
    return df.where(F.col(date).isNotNull()) if date in df.columns else df


def apply_date_bounds(df: DataFrame, rules: dict, date: str = "date",
                      today: str | None = None) -> DataFrame:
    """min_date / max_date (NULL max = today) / no future dates."""
    dv = (rules.get("dataset", {}) or {}).get("date_validation", {}) or {}
    if date not in df.columns or not dv:
        return df
    cond = F.lit(True)
    if dv.get("min_date"):
        cond = cond & (F.col(date) >= F.to_date(F.lit(dv["min_date"])))
    if dv.get("max_date"):
        cond = cond & (F.col(date) <= F.to_date(F.lit(dv["max_date"])))
    if dv.get("future_days_allowed") is not None:
        ref = F.to_date(F.lit(today)) if today else F.current_date()
        cond = cond & (F.col(date) <= F.date_add(ref, int(dv["future_days_allowed"])))
    return df.where(cond)


def trim_strings(df: DataFrame, rules: dict) -> DataFrame:
    """C4: strip all whitespace kinds from declared string/category columns."""
    dt = (rules.get("dataset", {}) or {}).get("dtypes", {}) or {}
    cols = {c for c, k in dt.items() if k in ("string", "category")}
    return df.select(*[strip_ws(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def clip_ranges(df: DataFrame, rules: dict) -> DataFrame:
    """Clip to [lo, hi]; either bound optional; NULLs stay NULL."""
    rng = ((rules.get("cleaning", {}) or {}).get("clip_ranges") or {})
    out = []
    for c in df.columns:
        if c in rng:
            lo, hi = (list(rng[c]) + [None, None])[:2]
            out.append(clip(c, lo, hi).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def apply_null_policy(df: DataFrame, rules: dict) -> DataFrame:
    """C7-C9, D2 in rule order: drop_row, zero, impute_median, fill_unknown.

    The median is taken over the rows left by the earlier policies (as in
    the contract); it is an exact global quantile computed without a
    single-task sort, then attached as a scalar subquery.
    """
    pol = ((rules.get("cleaning", {}) or {}).get("null_policy") or {})
    for c, p in pol.items():
        if c not in df.columns:
            continue
        if p == "drop_row":
            df = df.where(F.col(c).isNotNull())
        elif p == "zero":
            df = df.fillna(0, subset=[c]) if dict(df.dtypes)[c] != "string" else df.fillna("0", subset=[c])
        elif p == "impute_median":
            med = group_quantiles(df, [], c, [0.5], names=["_med"], with_count=None)
            df = (with_row(df, med)
                  .withColumn(c, F.coalesce(F.col(c).cast("double"), F.col("_med"), F.lit(0.0)))
                  .drop("_med"))
        elif p == "fill_unknown":
            df = df.fillna("Unknown", subset=[c])
    return df


def apply_cleaning(df: DataFrame, rules: dict, materialize: bool = False) -> DataFrame:
    """Trim -> dedupe -> clip -> null policy (the cleaning stage).

    With ``materialize`` the result's lineage is cut exactly once: before the
    median imputation when there is one (the median and the fill both read
    it), else at the end.
    """
    c = rules.get("cleaning", {}) or {}
    if c.get("trim_strings"):
        df = trim_strings(df, rules)
    if c.get("drop_duplicates"):
        # Nulls compare equal (G18); partial aggregation collapses copies map-side.
        df = df.dropDuplicates()
    df = clip_ranges(df, rules)
    pol = (c.get("null_policy") or {}).values()
    if "impute_median" in pol:
        # The median needs the cleaned rows and so does the fill: write them
        # once to the shared checkpoint folder instead of running the
        # parse/trim/dedupe chain for each pass.
        return apply_null_policy(cut_lineage(df, "cleaned"), rules)
    df = apply_null_policy(df, rules)
    return cut_lineage(df, "cleaned") if materialize else df


def clean(df: DataFrame, rules: dict, date: str = "date", materialize: bool = False) -> DataFrame:
    """Whole validate-and-clean chain on a raw frame."""
    require_columns(df, rules)
    df = coerce_types(df, rules)
    df = drop_invalid_dates(df, rules, date)
    df = apply_date_bounds(df, rules, date)
    return apply_cleaning(df, rules, materialize)


#: The report's counts of rows by stage, in order.
STAGE_COUNTS = ["initial_rows", "initial_cols", "invalid_dates", "cleaning_removed", "cleaning_removed_pct", "rows_removed", "final_rows",
                "zero_sales", "negative_sales_raw", "negative_sales"]


def clean_counted(raw: DataFrame, rules: dict, date: str = "date", sales: str = "weekly_sales") -> tuple[DataFrame, dict]:
    """(cleaned rows, counts of the upload): the upload is read once.

    Copies are counted where they are collapsed, and rows with invalid dates
    stay until the result is written, so every count of the upload is a sum
    over the rows that are written.  It is observed in the stage that writes:
    its tasks count once however often they are tried, which does not hold for
    metrics observed before an exchange.  The median of the null policy, if
    there is one, and everything later read the written rows.

    Counts: initial_rows, invalid_dates, negative_sales_raw, first_date, last_date.
    """
    require_columns(raw, rules)
    c = rules.get("cleaning", {}) or {}
    rows = coerce_types(raw, rules)
    if c.get("trim_strings"):
        rows = trim_strings(rows, rules)
    if c.get("drop_duplicates"):
        # Nulls compare equal (G18); partial aggregation collapses copies map-side
        rows = rows.groupBy(*[F.col(f"`{x}`") for x in raw.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    else:
        rows = rows.withColumn("_copies", F.lit(1).cast("bigint"))
    seen = Observation()
    share = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_copies"))), F.lit(0))
    rows = rows.observe(seen, share(F.lit(True)).alias("initial_rows"), share(F.col(date).isNull()).alias("invalid_dates"),
                        share(F.col(sales) < 0).alias("negative_sales_raw"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    written = cut_lineage(rows, "counted").drop("_copies")
    kept = apply_date_bounds(drop_invalid_dates(written, rules, date), rules, date)
    return apply_null_policy(clip_ranges(kept, rules), rules), seen.get


def with_stage_counts(r: DataFrame, counts: dict, columns: int) -> DataFrame:
    """``r`` (final_rows, ...) with the upload's counts and what cleaning removed of it."""
    n = {k: F.lit(counts[k]).cast("long") for k in ("initial_rows", "invalid_dates", "negative_sales_raw")}
    kept = n["initial_rows"] - n["invalid_dates"]
    removed = kept - F.col("final_rows")
    return r.withColumns({**n, "initial_cols": F.lit(columns).cast("long"), "cleaning_removed": removed.cast("long"),
                          "cleaning_removed_pct": F.round(F.try_divide(removed * 100.0, kept), 6),
                          "rows_removed": (n["initial_rows"] - F.col("final_rows")).cast("long")})


def validation_report(raw: DataFrame, rules: dict, date: str = "date", sales: str = "weekly_sales") -> DataFrame:
    """C11 + Q3/Q4: one row of stage counts, the date range, and what is wrong.

    initial rows/cols, invalid dates, rows removed by cleaning (and %), final
    rows, zero and negative sales (negative measured before and after clip),
    first and last valid date, and ``error_text`` and ``warning_text``: what
    was found, joined by "; ", empty if nothing was.  Two passes: the upload,
    counted while it is cleaned and written, and the cleaned rows.  A frame
    without the required columns is reported as one without rows, in the same
    schema, with an error that names them.
    """
    missing = missing_columns(raw, rules)
    if missing:
        raw = empty_input(raw, rules)
    cleaned, counts = clean_counted(raw, rules, date, sales)
    b = cleaned.agg(F.count(F.lit(1)).alias("final_rows"), F.count_if(F.col(sales) == 0).alias("zero_sales"), F.count_if(F.col(sales) < 0).alias("negative_sales"))
    r = with_stage_counts(b, counts, len(raw.columns) - len(missing))
    r = r.withColumns({"first_date": F.lit(counts["first_date"]).cast("date"), "last_date": F.lit(counts["last_date"]).cast("date")})
    note = lambda cond, n, text: F.when(cond, F.concat(n.cast("string"), F.lit(text)))
    told = F.lit(f"missing columns: {', '.join(missing)}") if missing else F.lit(None).cast("string")
    r = r.withColumns({
        "error_text": F.concat_ws("; ", told, note(F.col("negative_sales") > 0, F.col("negative_sales"), " rows with negative sales")),
        "warning_text": F.concat_ws("; ", note(F.col("invalid_dates") > 0, F.col("invalid_dates"), " rows without a valid date"),
                                    note(F.col("cleaning_removed") > 0, F.col("cleaning_removed"), " rows removed by cleaning"),
                                    note(F.col("zero_sales") > F.col("final_rows") * 0.1, F.col("zero_sales"), " rows with zero sales"))})
    return r.select(*STAGE_COUNTS, "first_date", "last_date", "error_text", "warning_text")
