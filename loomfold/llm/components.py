"""Connected components of an undirected graph, by rounds of joins; nothing is collected.

Nodes are unique longs. Each round gives every node the least node known to it: of its neighbours' least ones, and of the node that
this one has itself reached (pointer jumping), so rounds grow with the logarithm of a chain's length. Nodes without edges never enter
a round. Both joins of a round have one side with unique keys and plain rows of two longs on the other, so a hub or root with very many
rows is split by the adaptive skew join, and the minimum is taken by a partial aggregate before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfold.llm.common import durable


def components(edges: DataFrame) -> DataFrame | None:
    """`edges`: a, b. Returns node, root for each node with an edge, root being the least node reachable; None without edges."""
    both = durable(edges.filter("a != b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct())
    if both.isEmpty():
        return None
    now = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")))
    while True:
        near = both.join(now.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = now.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("next"))
        jump = now.select(F.col("node").alias("next"), F.col("root").alias("far"))
        step = durable(step.join(jump, "next").select("node", "old", F.least("next", "far").alias("root")))
        now = step.select("node", "root")
        if step.filter("old != root").isEmpty():
            return now


def merged(roots: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """The components after further edges: only the roots that these edges join enter the rounds."""
    if roots is None:
        return components(edges)
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias(end), "root")
        edges = edges.join(own, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    edges = durable(edges.select("a", "b").filter("a != b").distinct())
    more = components(edges)
    if more is None:
        return roots
    above = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
    old = roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return durable(old.unionByName(more.join(roots, "node", "left_anti").select("node", "root")))
