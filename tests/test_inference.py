"""Types of uploaded columns."""

import datetime as dt
from decimal import Decimal

import pytest

from tillroll.sources.inference import inferred
from tillroll.sources.tables import read_sales_csv, spans_lines

COLUMNS = {
    "whole": (["1", "-20", " 3 ", None], "bigint", [1, -20, 3, None]),
    "long": (["9223372036854775807", "1", "2", "3"], "bigint", [9223372036854775807, 1, 2, 3]),
    "too_long": (["9223372036854775808", "1", "2", "3"], "decimal(38,6)", [Decimal("9223372036854775808"), 1, 2, 3]),
    "money": (["1.5", "2", "-.25", None], "decimal(38,6)", [Decimal("1.5"), 2, Decimal("-.25"), None]),
    "fine": (["1.1234567", "2", "3", "4"], "double", [1.1234567, 2.0, 3.0, 4.0]),
    "power": (["1e3", "2", None, "4.5"], "double", [1000.0, 2.0, None, 4.5]),
    "suffix": (["1d", "2", "3", "4"], "string", ["1d", "2", "3", "4"]),
    "word": (["NaN", "2", "3", "Infinity"], "string", ["NaN", "2", "3", "Infinity"]),
    "flag": (["true", "False", None, "TRUE"], "boolean", [True, False, None, True]),
    "day": (["2024-02-29", None, "2023-01-01", "2023-12-31"], "date", [dt.date(2024, 2, 29), None, dt.date(2023, 1, 1), dt.date(2023, 12, 31)]),
    "us_day": (["02/29/2024", "01/31/2023", "12/01/2023", None], "date", [dt.date(2024, 2, 29), dt.date(2023, 1, 31), dt.date(2023, 12, 1), None]),
    "no_day": (["2023-02-30", "2023-01-01", "2023-01-02", None], "string", ["2023-02-30", "2023-01-01", "2023-01-02", None]),
    "two_ways": (["2023-02-03", "01/31/2023", "2023-01-02", None], "string", ["2023-02-03", "01/31/2023", "2023-01-02", None]),
    "time": (["2024-02-29 10:00:01", None, "2023-01-01 00:00:00", None], "timestamp_ntz", [dt.datetime(2024, 2, 29, 10, 0, 1), None, dt.datetime(2023, 1, 1), None]),
    "mixed": (["1", "x", None, "2"], "string", ["1", "x", None, "2"]),
    "nothing": ([None] * 4, "string", [None] * 4),
}


@pytest.mark.parametrize("parts", [1, 4])
def test_narrowest_type_that_holds_every_value(spark, parts):
    names = list(COLUMNS)
    rows = [tuple(COLUMNS[n][0][i] for n in names) for i in range(4)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).coalesce(1)
    out = inferred(df.repartition(parts, "whole") if parts > 1 else df)
    assert dict(out.dtypes) == {n: COLUMNS[n][1] for n in names}
    got = {r["whole"]: r for r in out.collect()}
    for i, w in enumerate(COLUMNS["whole"][2]):
        for n in names:
            assert got[w][n] == COLUMNS[n][2][i], n


def test_one_late_value_decides_and_kept_columns_stay_text(spark):
    df = spark.range(5000, numPartitions=8).selectExpr("string(id) AS a", "IF(id = 4999, 'x', string(id)) AS b", "string(id) AS `c.d`", "id")
    assert inferred(df, keep=["a"]).dtypes == [("a", "string"), ("b", "string"), ("c.d", "bigint"), ("id", "bigint")]
    assert inferred(df.limit(0)).dtypes == df.dtypes


def test_files_without_line_feeds_in_cells_are_read_in_splits(spark, tmp_path):
    (tmp_path / "plain.csv").write_text('a,b\n1,"say ""x"""\n2,y\n')
    (tmp_path / "feeds.csv").write_text('a,b\n1,"two\nlines"\n2,y\n')
    assert not spans_lines(spark, str(tmp_path / "plain.csv")) and spans_lines(spark, str(tmp_path / "feeds.csv"))
    plain, feeds = (read_sales_csv(spark, str(tmp_path / f), infer=True) for f in ("plain.csv", "feeds.csv"))
    assert sorted(map(tuple, plain.collect())) == [(1, 'say "x"'), (2, "y")]
    assert sorted(map(tuple, feeds.collect())) == [(1, "two\nlines"), (2, "y")]
    large = tmp_path / "large.csv"
    large.write_text("a,b\n" + "".join(f"{i},x\n" for i in range(200_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
        assert read_sales_csv(spark, str(large)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_shapes_refute_nothing_that_a_pattern_reads(spark):
    from pyspark.sql import functions as F

    from tillroll.functions.text import read_date, read_time
    from tillroll.sources.inference import DATE_FORMATS, TIME_FORMATS
    texts = ["2023-02-03", "2023-02-30", "12023-02-03", "+12023-02-03", "-2023-02-03", "0000-01-01", "02/03/2023", "2023/02/03", "2023-02-03 10:00:00", "2023-2-03",
             "2023-02-03t10:00:00", "2023-02-03 10:00:00.123", "2023-02-03 10:00:00.1", "x", None, "", "2023-02-03\n", "1582-10-10", "0099-12-31"]
    df, s = spark.createDataFrame([(t,) for t in texts], "s string"), F.col("s")
    for p in (*DATE_FORMATS, *TIME_FORMATS):
        t = F.try_to_timestamp(s, F.lit(p))
        assert df.where(~(t.eqNullSafe(read_time(s, p)) & F.to_date(t).eqNullSafe(read_date(s, p)))).collect() == [], p


def test_refuted_readings_are_not_tried_on_all_rows(spark, monkeypatch):
    from tillroll.sources import inference
    tried, real = [], inference._fitting
    monkeypatch.setattr(inference, "_fitting", lambda df, places: tried.append(places) or real(df, places))
    df = spark.range(3000, numPartitions=3).selectExpr("concat('s', id) AS store", "string(id) AS n", "IF(id < 2999, NULL, '1.5') AS late")
    assert dict(inference.inferred(df).dtypes) == {"store": "string", "n": "bigint", "late": "decimal(38,6)"}
    assert not tried[1]["store"] and len(tried[1]["n"]) == 3
