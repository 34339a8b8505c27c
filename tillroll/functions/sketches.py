"""Opt-in approximate distinct counts and quantiles from stored sketches.

Each entity and week keeps a quantile sketch (KLL) of an amount and a distinct
sketch (theta) of a key.  Both merge, so any set of weeks, or all entities,
are answered from the stored sketches without reading rows again; new weeks
only add sketches.  The exact measures (``functions.quantiles``,
``functions.bitmaps``) stay the default: use these where a documented error
is good enough and rows are too many to sort.

Errors, at the default sizes: a quantile's rank is off by 1.7 % at most in 99
of 100 cases (k = 200); a distinct count by 4.7 % at most in 997 of 1,000
(4,096 entries), and not at all below 4,096.  Sizes are bounded: a few KB and
32 KB for each entity and week.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .calendar import week_end

#: Sizes of the sketches, and the errors that go with them.
KLL_K, THETA_LOG2 = 200, 12
RANK_ERROR, DISTINCT_ERROR = 0.0165, 3 / (2 ** THETA_LOG2) ** 0.5


def weekly_sketches(df: DataFrame, entity: str, amount: str, key: str, date: str = "date") -> DataFrame:
    """(entity, week, amounts, keys): written sketches of ``amount`` (nulls skipped) and ``key`` (nulls skipped).

    Partial sketches are built map-side, so a hot entity is one sketch per map task.
    """
    known = df.where(F.col(entity).isNotNull())
    out = known.groupBy(entity, week_end(date).alias("week")).agg(
        F.kll_sketch_agg_double(F.col(amount).cast("double"), KLL_K).alias("amounts"),
        F.theta_sketch_agg(F.col(key), THETA_LOG2).alias("keys"))
    return cut_lineage(out, "sketches")


def merged(sketches: DataFrame, by: Sequence[str | Column] = (), probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(by, n, q.., distinct): quantiles and distinct keys of each group of stored sketches; null where there was no amount."""
    g = sketches.groupBy(*by).agg(F.kll_merge_agg_double("amounts").alias("_a"), F.theta_union_agg("keys", THETA_LOG2).alias("_k"))
    names = [c for c in g.columns if c not in ("_a", "_k")]
    n = F.kll_sketch_get_n_double("_a")
    q = [F.when(n > 0, F.kll_sketch_get_quantile_double("_a", F.lit(float(p)))).alias(f"q{int(round(p * 100))}") for p in probs]
    return g.select(*names, n.cast("long").alias("n"), *q, F.theta_sketch_estimate("_k").cast("long").alias("distinct"))
