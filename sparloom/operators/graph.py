"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.operators.shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """(a, b) for every node ``a`` that is not the smallest of its component, which is ``b``; from edges (a, b) in
    any direction.

    Every node points to a smaller one or to itself. A round ties, for each edge between two trees, what the larger
    end points to to what the smaller one does, and then lets every node point to what its target points to, so
    that trees are halved in depth as they are put together."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    nodes = edges.select("a").union(edges.select("b")).distinct()
    parent = materialize(nodes.select("a", F.col("a").alias("b")), "parents")
    while True:
        low = edges.join(parent.withColumnRenamed("b", "pa"), "a").join(parent.select(F.col("a").alias("b"), F.col("b").alias("pb")), "b")
        met = low.filter("pa <> pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("to"), "pa", "pb", F.col("a").alias("x"), F.col("b").alias("y"))
        # the target of the larger end, and both ends themselves, may point to the smaller target
        asked = met.select(F.inline(F.array(F.struct(F.col("a"), F.col("to")), F.struct(F.col("x").alias("a"), F.col("to")), F.struct(F.col("y").alias("a"), F.col("to")))))
        least = asked.groupBy("a").agg(F.min("to").alias("to"))
        tied = materialize(parent.join(least, "a", "left").select("a", F.least("b", F.coalesce("to", "b")).alias("b")), "tied")
        up = tied.select(F.col("a").alias("b"), F.col("b").alias("up"))
        leapt = materialize(tied.join(up, "b").select("a", F.col("up").alias("b")), "parents")
        again = leapt.select(F.col("a").alias("b"), F.col("b").alias("up"))
        now = materialize(leapt.join(again, "b").select("a", F.col("up").alias("b")), "parents")
        changed = now.join(parent.withColumnRenamed("b", "old"), "a").filter("b <> old").limit(1).count()
        parent = now
        if not changed:
            return parent.filter("a <> b")
