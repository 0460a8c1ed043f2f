"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two aggregates and two equality joins over edges; a node with very many edges is one key
of a join, which adaptive execution splits, never a collected list. Each round is written to the shared
folder; only its size and a checksum come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with b < a. Large: neighbours above a node are tied to its smallest neighbour.
    Small: neighbours below a node, and the node, are tied to the smallest of them."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return tied.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) for every node ``a`` that is not the smallest of its component, which is ``b``; from edges
    of two comparable columns (a, b) in any direction. No edges: no rows."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = materialize(now, "edges")
    mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while mark[0]:
        now = materialize(_star(_star(now, True), False), "edges")
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(last) == tuple(mark):
            break
    return now
