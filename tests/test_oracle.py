"""Registered queries against their DuckDB twins at sf0.01 (the driver's gate).

The default run checks a representative subset; ``TILLROLL_FULL_ORACLE=1``
checks every registered query (about five minutes on local[8]).
"""

import os

import pytest

import __spark_entry__ as E
from tillroll.plans.catalog import ORACLE, QUERIES
from tillroll.plans.oracle_compare import compare, duck

SF = "/root/testdata/sf0.01"
SUBSET = ["weekly_kpis", "weekly_trend", "clean_fact", "quality_report", "outlier_iqr_store",
          "derived_fields", "store_metrics", "department_metrics", "store_4wk_own_tail",
          "share_top5_department", "efficiency_regression", "alerts", "stream_weekly_events"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _names():
    return list(E.oracle_sql()) if os.environ.get("TILLROLL_FULL_ORACLE") else SUBSET


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert r["ok"], r


def test_every_query_registered_has_an_oracle():
    """The library's own queries; the optional folder's are tested with it."""
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["date", "weekly_sales_sum", "transactions_sum", "wow_growth_pct", "ma_4wk"]
