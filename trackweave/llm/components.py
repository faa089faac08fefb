"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import forget, saved


def components(edges: DataFrame) -> DataFrame:
    """(id, component): every vertex of edges (a, b) with the smallest vertex that it reaches.

    Each round points every vertex at its smallest neighbour, follows two pointers, and contracts the edges;
    those within one component vanish. The smallest vertex of a component never moves, so the rest end there.
    The rounds grow with the logarithm of the longest path. Nulls in a or b are dropped; no edges, no rows.
    """
    edges = saved(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    labels = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().select("id", F.col("id").alias("component"))
    if edges.isEmpty():
        return labels
    labels = saved(labels, "labels")
    while True:
        both = edges.union(edges.select("b", "a"))
        step = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p"))
        first = step = saved(step, "pointers")
        jump = step.select(F.col("v").alias("v2"), F.col("p").alias("p2"))
        step = saved(step.join(jump, F.col("p") == F.col("v2"), "left").select("v", F.coalesce("p2", "p").alias("p")), "pointers")
        forget(first)
        moved = step.where("v <> p")
        before = labels, edges
        labels = saved(
            labels.join(moved, F.col("component") == F.col("v"), "left").select("id", F.coalesce("p", "component").alias("component")), "labels"
        )
        left = step.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        right = step.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        edges = edges.join(left, "a").join(right, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        edges = saved(edges.distinct(), "edges")
        forget(*before, step)
        if edges.isEmpty():
            return labels
