"""Louvain's method against a sequential version, planted groups and modularity computed apart."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.operators import louvain as lv


def modularity(edges, label):
    pairs = {(min(a, b), max(a, b)) for a, b in edges if a != b}
    degree, inside, m = {}, 0, len(pairs)
    for a, b in pairs:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        inside += label[a] == label[b]
    total = {}
    for v, k in degree.items():
        total[label[v]] = total.get(label[v], 0) + k
    return inside / m - sum((k / (2 * m)) ** 2 for k in total.values())


def sequential(edges):
    """One vertex after another, level by level."""
    graph = {}
    for a, b in {(min(a, b), max(a, b)) for a, b in edges if a != b}:
        graph.setdefault(a, {})[b] = 1
        graph.setdefault(b, {})[a] = 1
    where = {v: v for v in graph}
    while True:
        m2 = sum(sum(n.values()) for n in graph.values())
        label, degree = {v: v for v in graph}, {v: sum(n.values()) for v, n in graph.items()}
        total, moved, again = dict(degree), False, True
        while again:
            again = False
            for v in sorted(graph):
                weight = {}
                for u, w in graph[v].items():
                    if u != v:
                        weight[label[u]] = weight.get(label[u], 0) + w
                total[label[v]] -= degree[v]
                best = max([*weight, label[v]], key=lambda c: (weight.get(c, 0) * m2 - degree[v] * total.get(c, 0), c == label[v]))
                total[best] = total.get(best, 0) + degree[v]
                if best != label[v]:
                    label[v], moved, again = best, True, True
        if not moved:
            return where
        where = {v: label[c] for v, c in where.items()}
        small = {}
        for v, n in graph.items():
            for u, w in n.items():
                row = small.setdefault(label[v], {})
                row[label[u]] = row.get(label[u], 0) + w
        graph = small


def planted(rng, groups, size, inner, outer):
    edges = []
    for a in range(groups * size):
        for b in range(a):
            if rng.random() < (inner if a // size == b // size else outer):
                edges.append((a, b) if rng.random() < 0.5 else (b, a))
    return edges


@pytest.mark.parametrize(("groups", "size", "inner", "outer"), [(4, 12, 0.6, 0.04)])
def test_no_worse_than_a_sequential_search(spark, groups, size, inner, outer):
    edges = planted(random.Random(groups), groups, size, inner, outer)
    df = spark.createDataFrame([*edges, *edges[:9], (3, 3), (None, 1)], "src long, dst long")
    labels = lv.louvain(df).persist()
    got = {r.id: r.community for r in labels.collect()}
    assert set(got) == {v for e in edges for v in e} and all(got[c] == c and min(v for v in got if got[v] == c) == c for c in got.values())
    ours, theirs = modularity(edges, got), modularity(edges, sequential(edges))
    assert ours >= theirs - 0.02 and ours >= modularity(edges, {v: v // size for v in got}) - 0.02
    both = df.where("src <> dst and src is not null").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    graph = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("w", F.lit(1).cast("long"))
    assert lv.modularity(graph, labels) == pytest.approx(ours, abs=1e-12)
    if ours == modularity(edges, {v: v // size for v in got}):
        assert got == {v: v // size * size for v in got}
    e, lab = pd.DataFrame(sorted({(min(x), max(x)) for x in edges}), columns=["a", "b"]), labels.toPandas()  # noqa: F841
    q = duckdb.sql("""WITH m AS (SELECT count(*)::DOUBLE AS m FROM e), t AS (SELECT community, count(*) AS k FROM (SELECT a AS v FROM e UNION ALL SELECT b FROM e) JOIN lab ON id = v GROUP BY 1)
    SELECT (SELECT count(*) FROM e JOIN lab x ON x.id = a JOIN lab y ON y.id = b WHERE x.community = y.community) / any_value(m) - sum((k / (2 * m)) ** 2) FROM t, m""").fetchall()[0][0]
    assert q == pytest.approx(ours, abs=1e-12)


def test_facts_and_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)], "id long, community long")
    entities = spark.createDataFrame([(1, 0.5, "human"), (2, 0.25001, "agent"), (3, None, "agent"), (7, None, "b"), (8, None, "a"), (9, 1.0, "a")], "id long, score double, type string")
    got = {r.community: (r.size, r.avg_trust, r.dominant_type) for r in lv.community_facts(labels, entities).collect()}
    assert got == {1: (3, 0.375, "agent"), 7: (2, 0.0, "a")}
    assert {r.dominant_type for r in lv.community_facts(labels, entities.limit(0)).collect()} == {"human"}
    empty = spark.createDataFrame([], "src long, dst long")
    assert lv.louvain(empty).count() == 0
    pair = lv.louvain(spark.createDataFrame([(5, 2), (2, 5), (9, 8), (1, 1)], "src long, dst long"))
    assert {(r.id, r.community) for r in pair.collect()} == {(2, 2), (5, 2), (8, 8), (9, 8)}
