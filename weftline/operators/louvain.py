"""Communities by modularity (Louvain's method) as rounds of joins and aggregates over an edge table.

A graph is a table (src, dst, w) with both directions of each edge; a vertex's own loop holds twice its inner weight. The
weights are whole numbers, so every comparison is exact whatever the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import undirected
from weftline.sources.folders import stored

WIDE = "decimal(38,0)"


def _wide(a: Column, b: Column) -> Column:
    """A product of two whole numbers that may pass 64 bits."""
    return a.cast("decimal(19,0)") * b.cast("decimal(19,0)")


def modularity(graph: DataFrame, labels: DataFrame) -> float:
    """Share of edge weight inside the communities beyond what the degrees alone would give; ``labels(id, community)``."""
    total, inside, expected = _terms(graph, labels)
    return 0.0 if not total else float(inside * total - expected) / float(total) ** 2


def _terms(graph: DataFrame, labels: DataFrame) -> tuple[int, int, int]:
    """(sum of weights, weight inside communities, sum of squared community degrees), all whole numbers."""
    a = labels.select(F.col("id").alias("src"), F.col("community").alias("c"))
    b = labels.select(F.col("id").alias("dst"), F.col("community").alias("d"))
    ends = graph.join(a, "src").join(b, "dst").groupBy("c").agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("c") == F.col("d"), F.col("w")).otherwise(0)).alias("inside"))
    r = ends.agg(F.sum("degree"), F.sum("inside"), F.sum(_wide(F.col("degree"), F.col("degree")).cast(WIDE))).first()
    return (int(r[0]), int(r[1]), int(r[2])) if r[0] is not None else (0, 0, 0)


def _moves(graph: DataFrame, state: DataFrame, total: int, part: int, parts: int, turn: int) -> DataFrame:
    """``state(id, community, degree)`` after the vertices of one hash part went where that raises modularity most.

    Vertices of one part decide at once by the labels as they stand, so two neighbours of different parts cannot swap. The
    own community wins ties, then the least one.
    """
    sums = state.groupBy("community").agg(F.sum("degree").alias("all"))
    movers = state.where(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(parts)) == part).select(F.col("id").alias("src"), F.col("community").alias("home"), "degree")
    near = graph.where("src <> dst").join(movers, "src").join(state.select(F.col("id").alias("dst"), "community"), "dst").select("src", "home", "degree", "community", "w")
    stay = movers.select("src", "home", "degree", F.col("home").alias("community"), F.lit(0).cast("long").alias("w"))
    choices = near.unionByName(stay).groupBy("src", "home", "degree", "community").agg(F.sum("w").alias("w")).join(sums, "community")
    at_home = F.col("community") == F.col("home")
    others = F.when(at_home, F.col("all") - F.col("degree")).otherwise(F.col("all"))
    gain = (_wide(F.col("w"), F.lit(total)) - _wide(F.col("degree"), others)).cast(WIDE)
    best = choices.groupBy(F.col("src").alias("id")).agg(F.max_by("community", F.struct(gain.alias("gain"), at_home.cast("int"), -F.col("community"))).alias("next"))
    return state.join(best, "id", "left").select("id", F.coalesce("next", "community").alias("community"), "degree")


def _settle(graph: DataFrame, most: int, least: float) -> tuple[DataFrame, bool]:
    """Labels (id, community) of one level, and whether any vertex moved for good.

    A turn lets all parts decide one after another. One that raises modularity by less than ``least`` is the last; one that
    does not raise it is undone and tried again with parts of an eighth, so that fewer vertices decide at once, until no
    vertex wants to move or three turns have failed.
    """
    degrees = graph.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree"))
    state = stored(degrees.select("id", F.col("id").alias("community"), "degree"), "vertices")
    total, inside, expected = _terms(graph, state)
    best, moved, parts, failed = inside * total - expected, False, 2, 0
    for turn in range(most):
        step = state
        for part in range(parts):
            step = stored(_moves(graph, step, total, part, parts, turn), "vertices")
        _, inside, expected = _terms(graph, step)
        raised = inside * total - expected - best
        if raised > 0:
            state, best, moved = step, best + raised, True
            if raised < least * total**2:
                break
        else:
            failed += 1
            still = raised == 0 and step.join(state.select("id", F.col("community").alias("before")), "id").where("community <> before").isEmpty()
            if still or failed == 3:
                break
            parts = 8
    return state.select("id", "community"), moved


def louvain(edges: DataFrame, levels: int = 10, turns: int = 20, least: float = 1e-4) -> DataFrame:
    """(id, community) of all vertices with an edge to another one; a community is named by its least vertex.

    Vertices move between communities until modularity rises by less than ``least``, then each community becomes one vertex
    of a smaller weighted graph, and so on until no vertex moves. Directions and repeated edges do not count, loops and null
    ends are left out. ``turns`` bounds the turns of a level; an empty table gives no rows. State between rounds is written
    to the shared folder; nothing but three sums a turn comes to the driver.
    """
    graph = stored(undirected(edges.where("src is not null and dst is not null")).select("src", "dst", F.lit(1).cast("long").alias("w")), "graph")
    labels = graph.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    for _ in range(levels):
        if graph.isEmpty():
            break
        step, moved = _settle(graph, turns, least)
        if not moved:
            break
        up = step.select(F.col("id").alias("community"), F.col("community").alias("next"))
        labels = stored(labels.join(up, "community").select("id", F.col("next").alias("community")), "labels")
        a, b = step.select(F.col("id").alias("src"), F.col("community").alias("c")), step.select(F.col("id").alias("dst"), F.col("community").alias("d"))
        graph = stored(graph.join(a, "src").join(b, "dst").groupBy(F.col("c").alias("src"), F.col("d").alias("dst")).agg(F.sum("w").alias("w")), "graph")
    names = labels.groupBy("community").agg(F.min("id").alias("least"))
    return labels.join(names, "community").select("id", F.col("least").alias("community"))


def community_facts(labels: DataFrame, entities: DataFrame) -> DataFrame:
    """Per community of ``labels(id, community)``: size, avg_trust (4 places, 0 without scores) and its leading type.

    ``entities(id, score, type)`` may lack members: these count in size, and as type ``human``; ties go to the least type.
    """
    j = labels.join(entities, "id", "left")
    kinds = j.groupBy("community", F.coalesce("type", F.lit("human")).alias("type")).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"), F.count("score").alias("scored"))
    # the greatest (n, then least name): counts first, names compared downwards by a second aggregate
    top = kinds.groupBy("community", "n").agg(F.min("type").alias("type"), F.sum("n").alias("size"), F.sum("total").alias("total"), F.sum("scored").alias("scored"))
    out = top.groupBy("community").agg(F.sum("size").alias("size"), F.max_by("type", "n").alias("dominant_type"), F.sum("total").alias("total"), F.sum("scored").alias("scored"))
    return out.select("community", "size", F.coalesce(F.round(F.try_divide("total", "scored"), 4), F.lit(0.0)).alias("avg_trust"), "dominant_type")
