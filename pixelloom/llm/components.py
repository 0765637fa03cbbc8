"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a pre-aggregated minimum by node and a join back (which AQE may split for a hot node), so no group is
ever collected.  Edge tables are written to the shared folder each round, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.storage import drop, save


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: distinct (a, b), a > b.  Links neighbours of each node to the node's smallest neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); the component is its smallest node.  Loops are allowed."""
    now = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    mark = None
    while True:
        after = save(_star(_star(now, True), False), "edges")
        drop(now)
        now = after
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == was or mark[0] == 0:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
