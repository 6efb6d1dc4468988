"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import drop, stash


def connected_components(edges: DataFrame) -> DataFrame:
    """Label each vertex of ``edges(a long, b long)`` with the least vertex of its component.

    Each round points every vertex at its least neighbour, jumps one pointer further, and contracts the
    edges along the pointers, so chains shrink quickly. All tables of a round are written to the shared folder.
    Every step is a partial aggregate or a plain equi-join of two stored tables, so a hub vertex is split
    by adaptive execution. Self loops and repeated edges are allowed; an empty table gives an empty table.
    Returns ``(vertex long, component long)``, one row per vertex.
    """
    edges = stash(edges.select("a", "b").where("a is not null and b is not null").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stash(both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.col("vertex"), F.min("b")).alias("to")), "step")
        if labels is not None and step.isEmpty():
            return labels
        further = step.select(F.col("vertex").alias("to"), F.col("to").alias("next"))
        jump = stash(step.join(further, "to", "left").select("vertex", F.coalesce("next", "to").alias("to")), "jump")
        drop(step)
        if labels is None:
            labels = stash(jump.select("vertex", F.col("to").alias("component")), "labels")
        else:
            moved = labels.join(jump.withColumnRenamed("vertex", "component"), "component", "left")
            newer = stash(moved.select("vertex", F.coalesce("to", "component").alias("component")), "labels")
            drop(labels)
            labels = newer
        by_a = jump.select(F.col("vertex").alias("a"), F.col("to").alias("x"))
        by_b = jump.select(F.col("vertex").alias("b"), F.col("to").alias("y"))
        left = edges.join(by_a, "a").join(by_b, "b").where("x <> y")
        contracted = stash(left.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        drop(edges)
        drop(jump)
        edges = contracted
