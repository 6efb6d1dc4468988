"""Graph operators over edge tables (src, dst): iterative joins, each round cut from its lineage.

Rounds write their frontier to the checkpoint folder of the session where it names one; see ``cut``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.folders import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def bfs(edges: DataFrame, start: int, depth: int, directed: bool = True) -> DataFrame:
    """Vertices within ``depth`` hops with their distance and the least parent that reaches them first."""
    e = cut(edges.select("src", "dst").where("src <> dst").distinct() if directed else undirected(edges))
    found = e.sparkSession.createDataFrame([(start, 0, None)], "id long, hops int, parent long")
    frontier = found
    for hop in range(1, depth + 1):
        step = frontier.select(F.col("id").alias("src")).join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier = cut(step.join(found.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hops"), "parent"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def shortest_path(edges: DataFrame, start: int, goal: int, depth: int = 6) -> DataFrame:
    """The shortest directed path as rows (place, id), least parents first; empty beyond ``depth`` hops."""
    tree = cut(bfs(edges, start, depth))
    path = tree.where(F.col("id") == goal)
    rows = path.select(F.col("hops").alias("place"), "id", "parent")
    last = rows
    for _ in range(depth):
        last = last.select(F.col("parent").alias("id")).join(tree, "id").select(F.col("hops").alias("place"), "id", "parent")
        rows = rows.unionByName(last)
    return rows.select("place", "id")


def components(edges: DataFrame) -> DataFrame:
    """Least vertex of each vertex's component, by neighbour minima and pointer jumps until nothing changes."""
    e = cut(undirected(edges))
    labels = cut(e.groupBy(F.col("src").alias("id")).agg(F.least(F.col("id"), F.min("dst")).alias("component")))
    while True:
        seen = e.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(seen, "id", "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("next"))
        jump = step.select(F.col("id").alias("next"), F.col("next").alias("further"))
        step = cut(step.join(jump, "next", "left").select("id", "component", F.least("next", F.coalesce("further", "next")).alias("next")))
        changed = step.where("component <> next").isEmpty()
        labels = step.select("id", F.col("next").alias("component"))
        if changed:
            return labels


def by_degree(e: DataFrame) -> DataFrame:
    """Each undirected edge once, from its end of lesser degree: at most sqrt(2 E) from each vertex."""
    degree = e.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = e.join(degree.select(F.col("v").alias("src"), F.col("n").alias("n1")), "src").join(degree.select(F.col("v").alias("dst"), F.col("n").alias("n2")), "dst")
    return ranked.where(F.struct("n1", "src") < F.struct("n2", "dst")).select("src", "dst")


def wedges_closed(e: DataFrame) -> DataFrame:
    """Triangles as (src, x, y), x < y, each once at its vertex of least degree."""
    out = by_degree(e)
    wedge = out.select("src", F.col("dst").alias("x")).join(out.select("src", F.col("dst").alias("y")), "src").where("x < y")
    return wedge.join(e.where("src < dst").select(F.col("src").alias("x"), F.col("dst").alias("y")), ["x", "y"]).select("src", "x", "y")


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles a < b < c of the undirected graph, each found from its vertex of least degree."""
    t = wedges_closed(undirected(edges)).select(F.array_sort(F.array("src", "x", "y")).alias("t"))
    return t.select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Label propagation: each vertex takes the most frequent label around it, the least at ties; fixed rounds, so results are deterministic."""
    e = cut(undirected(edges))
    labels = cut(e.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id")))
    for _ in range(rounds):
        votes = e.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("id").agg(F.max_by("community", F.struct("n", -F.col("community"))).alias("next"))
        step = cut(labels.join(best, "id").select("id", "community", "next"))
        labels = step.select("id", F.col("next").alias("community"))
        if step.where("community <> next").isEmpty():
            break
    return labels


def cliques(edges: DataFrame, least: int = 3) -> DataFrame:
    """All maximal cliques of at least ``least`` members (3 or more) as (members, size).

    A clique is searched at its vertex of least degree, among the triangles there: a group holds the edges between at
    most sqrt(2 E) neighbours, whatever the graph and its components. A clique found so is dropped where a vertex
    outside is joined to all of its members.
    """
    if least < 3:
        raise ValueError("cliques have three members at least")
    e = cut(undirected(edges))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for a, b in zip(pdf["x"], pdf["y"], strict=True):
            near.setdefault(int(a), set()).add(int(b))
            near.setdefault(int(b), set()).add(int(a))
        home, found = int(pdf["src"].iloc[0]), []

        def grow(chosen: list[int], open_: set[int], done: set[int]) -> None:
            if not open_ and not done:
                if len(chosen) + 1 >= least:
                    found.append(sorted([home, *chosen]))
                return
            hub = max(open_ | done, key=lambda v: (len(near[v] & open_), -v))
            for v in sorted(open_ - near[hub]):
                grow([*chosen, v], open_ & near[v], done & near[v])
                open_, done = open_ - {v}, done | {v}

        grow([], set(near), set())
        return pd.DataFrame({"members": pd.Series(found, dtype=object)})

    found = cut(wedges_closed(e).groupBy("src").applyInPandas(search, "members array<long>"))
    outside = found.select("members", F.explode("members").alias("dst")).join(e, "dst").groupBy("members", "src").agg(F.count(F.lit(1)).alias("n"))
    larger = outside.where(F.col("n") == F.size("members")).select("members").distinct()
    return found.join(larger, "members", "left_anti").select("members", F.size("members").alias("size"))


def levels(edges: DataFrame, root: int, depth: int) -> DataFrame:
    """A tree by levels from ``root`` along src -> dst: (id, hops, parent), each vertex at its least depth."""
    return bfs(edges, root, depth)


def cross_degree(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per vertex, out-edges that leave its own cluster; ``labels(id, cluster)``."""
    a = labels.select(F.col("id").alias("src"), F.col("cluster").alias("from"))
    b = labels.select(F.col("id").alias("dst"), F.col("cluster").alias("to"))
    return edges.join(a, "src").join(b, "dst").where("from <> to").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("crossing"))
