"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import cut_lineage, in_tasks


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """Links the neighbours of each node to the smallest of them and itself.

    The minimum is aggregated before it is joined back, so a node with a third of all
    edges sends one row for each task, and the join can split its side. ``rows`` is the
    number of edges.
    """
    around = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
    if large:
        around = around.unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    least = around.groupBy("n").agg(F.least(F.col("n"), F.min("m")).alias("root"))
    joined = around.join(least, "n")
    if large:
        linked = joined.where(F.col("m") > F.col("n")).select(F.col("m").alias("u"), F.col("root").alias("v"))
    else:
        linked = joined.select(F.col("m").alias("u"), F.col("root").alias("v"))
        linked = linked.unionByName(least.select(F.col("n").alias("u"), F.col("root").alias("v")))
    return in_tasks(in_tasks(linked.where("u <> v"), rows).distinct(), rows)


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """node, root for each node of at least one edge between different nodes; root is the
    smallest node reachable. Null ends and loops are no edges; no edges give no rows."""
    edges = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    edges = cut_lineage(edges.where("u <> v").distinct())
    before, rows = None, edges.count()
    while True:
        edges = cut_lineage(_star(_star(in_tasks(edges, rows), True, rows), False, rows))
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
