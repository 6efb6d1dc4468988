"""Graph queries over the follow and attestation edges."""

from pyspark.sql import functions as F

from weftline.operators import graph as g
from weftline.plans import model as m
from weftline.plans.registry import load, query

@query(m.SQL + """
, h1 AS (SELECT DISTINCT dst AS id FROM follows WHERE src = 7), h2 AS (SELECT DISTINCT dst AS id FROM follows WHERE src IN (SELECT id FROM h1) AND dst <> 7 AND dst NOT IN (SELECT id FROM h1))
SELECT 7::BIGINT AS id, 0 AS hops, NULL::BIGINT AS parent UNION ALL SELECT id, 1, 7 FROM h1 UNION ALL SELECT h2.id, 2, min(f.src) FROM h2 JOIN follows f ON f.dst = h2.id AND f.src IN (SELECT id FROM h1) GROUP BY 1
""")
def ego_graph(spark, d):
    """Two hops around an entity along follows."""
    return g.bfs(m.follows(spark, d), 7, 2)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT user_id AS src, (props->>'k')::BIGINT AS dst FROM events WHERE event_type = 'purchase' AND user_id <> (props->>'k')::BIGINT),
t(id, hops) AS (SELECT 9::BIGINT, 0 UNION SELECT e.dst, hops + 1 FROM t JOIN e ON e.src = t.id WHERE hops < 4)
SELECT id, min(hops) AS hops FROM t GROUP BY 1
""")
def reachable(spark, d):
    """Distances within four hops on the purchase graph."""
    e = m.events(spark, d).where("event_type = 'purchase' and user_id <> k").select(F.col("user_id").alias("src"), F.col("k").alias("dst"))
    return g.bfs(e, 9, 4).select("id", "hops")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT user_id AS src, (props->>'k')::BIGINT AS dst FROM events WHERE event_type = 'purchase' AND user_id <> (props->>'k')::BIGINT),
t(id, hops) AS (SELECT 9::BIGINT, 0 UNION SELECT e.dst, hops + 1 FROM t JOIN e ON e.src = t.id WHERE hops < 6), dist AS (SELECT id, min(hops) AS hops FROM t GROUP BY 1),
par AS (SELECT d.id, d.hops, min(p.id) AS parent FROM dist d JOIN e ON e.dst = d.id JOIN dist p ON p.id = e.src AND p.hops = d.hops - 1 GROUP BY ALL),
walk(place, id) AS (SELECT hops, id FROM dist WHERE id = (SELECT max(id) FROM dist WHERE hops = (SELECT max(hops) FROM dist)) UNION SELECT place - 1, parent FROM walk JOIN par USING (id) WHERE place > 0)
SELECT place, id FROM walk
""")
def shortest_path(spark, d):
    """A shortest path to the farthest vertex, through the least parents."""
    e = m.events(spark, d).where("event_type = 'purchase' and user_id <> k").select(F.col("user_id").alias("src"), F.col("k").alias("dst"))
    goal = g.bfs(e, 9, 6).agg(F.max_by("id", F.struct("hops", "id"))).first()[0]
    return g.shortest_path(e, 9, goal)


@query()
def connected_components(spark, d):
    """Components of the bipartite graph of suppliers and parts."""
    e = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.lit(1000000) + F.col("l_partkey")).alias("dst"))
    return g.components(e)


@query(m.SQL + """
, u AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM follows)
SELECT p.x AS a, p.y AS b, q.y AS c FROM u p JOIN u q ON q.x = p.y JOIN u r ON r.x = p.x AND r.y = q.y
""")
def triangles(spark, d):
    """All triangles of the follow graph."""
    return g.triangles(m.follows(spark, d))


@query(m.SQL + "SELECT f.src AS id, count(*) AS crossing FROM follows f JOIN entities a ON a.id = f.src JOIN entities b ON b.id = f.dst WHERE a.framework <> b.framework GROUP BY 1 HAVING count(*) > 10")
def cluster_cross(spark, d):
    """Entities with many follows out of their own cluster."""
    labels = m.entities(spark, d).select("id", F.col("framework").alias("cluster"))
    return g.cross_degree(m.follows(spark, d), labels).where("crossing > 10")


@query(m.SQL + """
, d AS (SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM follows UNION ALL SELECT dst, 0, 1 FROM follows) GROUP BY 1)
SELECT count(*) AS vertices, sum(out_degree)::BIGINT AS edges, round(avg(out_degree + in_degree), 6) AS mean_degree, arg_max(id, (in_degree, -id)) AS most_followed, max(in_degree) AS followers FROM d
""")
def network_stats(spark, d):
    """Sizes, mean degree and the most followed vertex in one pass over degrees."""
    f = m.follows(spark, d)
    ends = f.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(f.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    n = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return n.agg(F.count(F.lit(1)).alias("vertices"), F.sum("o").alias("edges"), F.round(F.avg(F.col("o") + F.col("i")), 6).alias("mean_degree"), F.max_by("id", F.struct("i", -F.col("id"))).alias("most_followed"), F.max("i").alias("followers"))


@query(m.SQL + ", top AS (SELECT id FROM entities ORDER BY balance DESC, id LIMIT 600) SELECT src, dst FROM follows WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top)")
def induced_subgraph(spark, d):
    """Edges inside the most trusted entities: two semi joins with a bounded set."""
    top = m.entities(spark, d).orderBy(F.desc("balance"), "id").limit(600).select("id")
    f = m.follows(spark, d)
    return f.join(top, f["src"] == top["id"], "left_semi").join(top, F.col("dst") == top["id"], "left_semi")


@query(m.SQL + """
, r AS (SELECT DISTINCT target AS src, attester AS dst FROM attestations WHERE context = 'code'), h1 AS (SELECT dst AS id FROM r WHERE src = 11),
h2 AS (SELECT DISTINCT dst AS id FROM r WHERE src IN (SELECT id FROM h1) AND dst <> 11 AND dst NOT IN (SELECT id FROM h1))
SELECT hops, count(*) AS n FROM (SELECT 0 AS hops UNION ALL SELECT 1 FROM h1 UNION ALL SELECT 2 FROM h2) GROUP BY 1
""")
def trust_tree(spark, d):
    """Attesters of an entity by level, each once at its least depth."""
    r = m.attestations(spark, d).where("context = 'code'").select(F.col("target").alias("src"), F.col("attester").alias("dst"))
    return g.levels(r, 11, 2).groupBy("hops").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE v AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 3 END AS parent, p_size AS version FROM part), t(id, hops) AS (SELECT 4::BIGINT, 0 UNION ALL SELECT v.id, hops + 1 FROM t JOIN v ON v.parent = t.id WHERE hops < 5)
SELECT t.id, hops, version FROM t JOIN v USING (id)
""")
def lineage(spark, d):
    """Fork children to five levels with their latest version."""
    p = load(spark, d, "part")
    edges = p.where("p_partkey > 0").select(F.floor((F.col("p_partkey") - 1) / 3).alias("src"), F.col("p_partkey").alias("dst"))
    return g.levels(edges, 4, 5).join(p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("version")), "id").select("id", "hops", "version")


@query()
def communities(spark, d):
    """Communities of the follow graph by label propagation with fixed ties."""
    return g.communities(m.follows(spark, d))


@query()
def attestation_cliques(spark, d):
    """Maximal cliques among mutually attesting entities."""
    from weftline.operators.detectors import mutual_pairs

    return g.cliques(mutual_pairs(m.attestations(spark, d), "attester", "target").select(F.col("a").alias("src"), F.col("b").alias("dst")))
