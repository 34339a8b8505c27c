"""Connected components of a large graph by repeated contraction.

In each round every node hooks onto its smallest smaller neighbour, hooks are
shortened by pointer jumping, and the edges are rewritten to the hooks' ends;
edges inside a component vanish.  Each round writes its small tables to the
shared folder, so lineage stays short.  A hot node is one row of each map
task after partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Pointer jumps of a round: chains of 2**JUMPS hooks become one.
JUMPS = 3


def _through(df: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """``column`` of ``df`` replaced by the end of its hook, if it has one."""
    ends = hooks.select(F.col("hi").alias("_from"), F.col("lo").alias("_to"))
    return df.join(ends, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the smallest node reachable, for every node of an edge; null ends are left out."""
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left = cut_lineage(both, "edges")
    labels = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not left.isEmpty():
        hooks = cut_lineage(left.groupBy(F.col("a").alias("hi")).agg(F.min("b").alias("lo")), "hooks")
        for _ in range(JUMPS):
            hooks = _through(hooks, "lo", hooks)
        hooks = cut_lineage(hooks, "hooks")
        labels = _through(labels, "component", hooks)
        moved = _through(_through(left, "a", hooks), "b", hooks).where("a <> b")
        left = cut_lineage(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return cut_lineage(labels, "labels")
