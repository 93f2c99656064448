"""Connected components of an edge list by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquill.llm._stage import drop_staged, staged


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the edges (a, b).

    Each round points every node at its smallest neighbour and renames the edges by it. A node that isn't a local minimum
    vanishes, so the edges are gone after a logarithmic number of rounds. Edges, not neighbour lists, are shuffled; a
    node's minimum is aggregated before the shuffle. Every round's tables are written to the shared folder.
    """
    edges = staged(edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    names = staged(nodes.select("node", F.col("node").alias("component")), "names")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        parent = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("parent")), "parents")
        left, right = (parent.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}")) for c in "ab")
        renamed = edges.join(left, "a").join(right, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        fresh, old = staged(renamed, "edges"), edges
        moved = names.join(parent.select(F.col("node").alias("component"), "parent"), "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        names, stale = staged(moved, "names"), names
        for gone in (old, stale, parent):
            drop_staged(gone)
        edges = fresh
    return names
