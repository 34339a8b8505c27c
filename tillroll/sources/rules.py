"""Rules: built-in defaults and the YAML file.

Rules are a small driver-side dict passed to operators; nothing here touches
data.
"""

from __future__ import annotations

import copy
import logging
from pathlib import Path

log = logging.getLogger(__name__)

# The built-in defaults used when no rules file is found.
DEFAULT_RULES = {
    "dataset": {
        "required_columns": ["date", "store", "department", "region", "weekly_sales", "transactions"],
        "dtypes": {"date": "datetime", "store": "string", "department": "string",
                   "region": "category", "weekly_sales": "float", "transactions": "int"},
    },
    "cleaning": {
        "trim_strings": True,
        "drop_duplicates": True,
        "null_policy": {"weekly_sales": "drop_row", "transactions": "impute_median"},
        "clip_ranges": {"weekly_sales": [0, None], "transactions": [0, None]},
    },
    "outliers": {"method": "iqr", "group_by": "store", "k": 1.5, "treat": "flag"},
    "kpis": {
        "time_freq": "W",
        "aggregates": {"weekly_sales": ["sum"], "transactions": ["sum"]},
        "thresholds": {"growth": {"strong": 0.05, "stable": 0.0, "declining": -0.05}},
    },
}

# The shipped rules file's settings that operators read.
SHIPPED_RULES = {
    "dataset": {
        "required_columns": ["date", "store", "department", "region", "weekly_sales", "transactions"],
        "dtypes": {"date": "datetime", "store": "string", "department": "string",
                   "region": "category", "weekly_sales": "float", "transactions": "int"},
        "optional_columns": ["units_sold", "discount_applied", "cost_of_goods_sold",
                             "product_category", "customer_segment"],
        "date_validation": {"min_date": "2020-01-01", "max_date": None, "future_days_allowed": 0},
    },
    "cleaning": {
        "trim_strings": True,
        "drop_duplicates": True,
        "null_policy": {"weekly_sales": "drop_row", "transactions": "impute_median",
                        "date": "drop_row", "store": "drop_row",
                        "department": "fill_unknown", "region": "fill_unknown"},
        "clip_ranges": {"weekly_sales": [0, 1000000], "transactions": [0, 10000]},
        "validation": {"min_transactions_per_sale": 1, "max_avg_transaction": 50000,
                       "min_stores": 2, "min_weeks": 4},
    },
    "outliers": {"method": "iqr", "group_by": "store", "k": 1.5, "treat": "flag",
                 "report_threshold": 3},
    "kpis": {
        "time_freq": "W",
        "aggregates": {"weekly_sales": ["sum", "mean", "std"], "transactions": ["sum", "mean"]},
        "derived": {
            "avg_order_value": "weekly_sales_sum / NULLIF(transactions_sum, 0)",
            "sales_volatility": "weekly_sales_std / NULLIF(weekly_sales_mean, 0)",
        },
        "thresholds": {
            "growth": {"strong": 0.05, "stable": 0.0, "declining": -0.05},
            "health": {"excellent": 0.10, "good": 0.03, "watch": -0.03,
                       "at_risk": -0.10, "critical": -999},
            "stores": {"min_sales_per_week": 5000, "min_transactions_per_week": 50},
        },
    },
    "alerts": {
        "enabled": True,
        "rules": [
            {"name": "Revenue Drop Alert", "condition": "wow_pct < -0.15", "severity": "high",
             "message": "Sales changed by {wow_pct:.1%} from one week to the next"},
            {"name": "Store Performance Alert", "condition": "store_4wk_decline > 3",
             "severity": "medium", "message": "{store_4wk_decline} stores sold less than in the four weeks before"},
            {"name": "Data Quality Alert", "condition": "missing_pct > 0.10", "severity": "high",
             "message": "{missing_pct:.1%} of the cells are missing"},
        ],
    },
    "reports": {"department_analysis": {"top_n": 10}},
}


def default_rules() -> dict:
    return copy.deepcopy(DEFAULT_RULES)


def shipped_rules() -> dict:
    return copy.deepcopy(SHIPPED_RULES)


def load_rules(path: str | None = None) -> dict:
    """Read a YAML rules file; unreadable or missing -> built-in defaults."""
    if path and Path(path).exists():
        try:
            import yaml  # optional dependency
        except ImportError:  # pragma: no cover - yaml is usually present
            log.warning("PyYAML missing; using default rules")
            return default_rules()
        try:
            with open(path, encoding="utf-8") as fh:
                data = yaml.safe_load(fh)
            if isinstance(data, dict):
                return data
        except Exception as exc:  # malformed file -> defaults, as documented
            log.error("error loading %s: %s", path, exc)
    return default_rules()


def fact_rules(min_date: str | None = None, max_date: str | None = None) -> dict:
    """Shipped rules with date bounds that admit the driver tables (1995-2001)."""
    r = shipped_rules()
    r["dataset"]["date_validation"]["min_date"] = min_date
    r["dataset"]["date_validation"]["max_date"] = max_date
    return r
