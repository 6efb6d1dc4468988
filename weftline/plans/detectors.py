"""Detector queries: velocity, churn, rings, floods, sybil risk, gates."""

from pyspark.sql import functions as F

from weftline.functions.exprs import ladder
from weftline.operators import detectors as det
from weftline.operators.tables import band_counts, outliers, shares
from weftline.plans import model as m
from weftline.plans.registry import load, query

r6 = lambda c: F.round(c, 6)


@query(m.SQL + """
, s AS (SELECT user_id, avg(value) AS v FROM ev GROUP BY 1), st AS (SELECT avg(v) AS mean, stddev_pop(v) AS sd FROM s)
SELECT user_id, round((v - mean) / sd, 6) AS z, CASE WHEN abs((v - mean) / sd) >= 4 THEN 'high' WHEN abs((v - mean) / sd) >= 3 THEN 'medium' ELSE 'low' END AS severity FROM s, st WHERE sd > 0 AND abs((v - mean) / sd) > 1.5
""")
def velocity(spark, d):
    """Entities whose recent score is far from the population's mean."""
    s = m.events(spark, d).groupBy("user_id").agg(F.avg("value").alias("v"))
    return outliers(s, "v", 1.5).select("user_id", r6(F.col("z")).alias("z"), det.severity_of(F.col("z")).alias("severity"))


@query(m.SQL + """
, s AS (SELECT src, count(*) / 30.0 AS v FROM follows GROUP BY 1), st AS (SELECT avg(v) AS mean, stddev_pop(v) AS sd FROM s)
SELECT src, round((v - mean) / sd, 6) AS z, CASE WHEN abs((v - mean) / sd) >= 4 THEN 'high' WHEN abs((v - mean) / sd) >= 3 THEN 'medium' ELSE 'low' END AS severity FROM s, st WHERE sd > 0 AND abs((v - mean) / sd) > 2
""")
def churn(spark, d):
    """Entities that follow unusually often, among those that follow at all."""
    s = m.follows(spark, d).groupBy("src").agg((F.count(F.lit(1)) / 30.0).alias("v"))
    return outliers(s, "v", 2.0).select("src", r6(F.col("z")).alias("z"), det.severity_of(F.col("z")).alias("severity"))


@query(m.SQL + """
, p AS (SELECT least(attester, target) AS a, greatest(attester, target) AS b, count(*) FILTER (WHERE attester < target) AS forth, count(*) FILTER (WHERE attester > target) AS back FROM attestations GROUP BY ALL)
SELECT a, b, forth, back, CASE WHEN x.operator = y.operator THEN 'high' ELSE 'medium' END AS severity FROM p JOIN entities x ON x.id = a JOIN entities y ON y.id = b WHERE forth > 0 AND back > 0
""")
def mutual_attestation(spark, d):
    """Reciprocal attestations, worse where both have one operator."""
    e = m.entities(spark, d)
    p = det.mutual_pairs(m.attestations(spark, d), "attester", "target").join(e.select(F.col("id").alias("a"), F.col("operator").alias("x")), "a").join(e.select(F.col("id").alias("b"), F.col("operator").alias("y")), "b")
    return p.select("a", "b", "forth", "back", F.when(F.col("x") == F.col("y"), "high").otherwise("medium").alias("severity"))


def _rings_sql(days: int, overlap: float, least: int) -> str:
    return m.SQL + f"""
, u AS (SELECT voter, post AS author, count(*) AS n FROM votes, clock WHERE direction = 'up' AND us >= now - {days} * 86400000000::BIGINT AND voter <> post GROUP BY ALL), t AS (SELECT voter, sum(n) AS total FROM u GROUP BY 1),
strong AS (SELECT voter, author, n, total FROM u JOIN t USING (voter) WHERE n >= {least} AND n >= {overlap}::DOUBLE * total),
p AS (SELECT x.voter AS a, x.author AS b, x.n AS forth, y.n AS back, round(x.n / x.total::DOUBLE, 4) AS overlap_a, round(y.n / y.total::DOUBLE, 4) AS overlap_b FROM strong x JOIN strong y ON y.voter = x.author AND y.author = x.voter WHERE x.voter < x.author),
r AS (WITH RECURSIVE w(id, seen) AS (SELECT a, a FROM p UNION SELECT b, b FROM p UNION SELECT CASE WHEN p.a = w.id THEN p.b ELSE p.a END, seen FROM w JOIN p ON p.a = w.id OR p.b = w.id) SELECT id, min(seen) AS ring FROM w GROUP BY 1),
z AS (SELECT ring, count(*) AS members FROM r GROUP BY 1)
SELECT ring, members, CASE WHEN members >= 3 THEN 'high' ELSE 'medium' END AS severity, a, b, forth, back, overlap_a, overlap_b FROM p JOIN r ON r.id = a JOIN z USING (ring)"""


def _rings(spark, d, days, overlap, least):
    """Votes on posts, each post being its entity's own."""
    now = m.now(spark, d).first()["now"]
    return det.voting_rings(m.votes(spark, d).withColumnRenamed("post", "author"), F.lit(now), days, overlap, least)


@query(_rings_sql(30, 0.8, 5))
def voting_ring(spark, d):
    """Entities that give each other most of their upvotes, at the rule's own values."""
    return _rings(spark, d, 30, 0.8, 5)


@query(_rings_sql(3650, 0.01, 1))
def mutual_upvotes(spark, d):
    """The same at values that any mutual vote meets, so that there are rows and larger rings."""
    return _rings(spark, d, 3650, 0.01, 1)


@query()
def voting_overlap(spark, d):
    """Voters with nearly the same sets of posts: suppliers and their parts."""
    return det.voting_pairs(load(spark, d, "lineitem").select(F.col("l_suppkey").alias("voter"), F.col("l_partkey").alias("post")))


@query("SELECT c_mktsegment AS label, count(*) AS n, count(*) / (SELECT count(*) FROM customer)::DOUBLE AS share, CASE WHEN count(*) >= 0.85 * (SELECT count(*) FROM customer) THEN 'high' ELSE 'medium' END AS severity FROM customer GROUP BY 1 HAVING count(*) > 0.2 * (SELECT count(*) FROM customer)")
def monoculture(spark, d):
    return shares(load(spark, d, "customer"), "c_mktsegment").where("share > 0.2").withColumn("severity", F.when(F.col("share") >= 0.85, "high").otherwise("medium"))


@query(m.SQL + "SELECT operator, count(*) AS n, CASE WHEN count(*) >= 20 THEN 'high' ELSE 'medium' END AS severity FROM ev JOIN entities ON id = user_id, clock WHERE us > now - 86400000000 GROUP BY 1 HAVING count(*) > 10")
def operator_flood(spark, d):
    """Operators whose entities were very active in the last day."""
    e = m.events(spark, d).crossJoin(F.broadcast(m.now(spark, d))).where("us > now - 86400000000")
    n = e.join(m.entities(spark, d).select(F.col("id").alias("user_id"), "operator"), "user_id").groupBy("operator").agg(F.count(F.lit(1)).alias("n")).where("n > 10")
    return n.withColumn("severity", F.when(F.col("n") >= 20, "high").otherwise("medium"))


@query(m.SQL + "SELECT user_id // 10 AS address, count(DISTINCT user_id) AS entities FROM ev, clock WHERE us > now - 86400000000 GROUP BY 1 HAVING count(DISTINCT user_id) > 5")
def sybil_cluster(spark, d):
    """Addresses that many entities share within a day."""
    e = m.events(spark, d).crossJoin(F.broadcast(m.now(spark, d))).where("us > now - 86400000000")
    return e.groupBy(F.floor(F.col("user_id") / 10).alias("address")).agg(F.count_distinct("user_id").alias("entities")).where("entities > 5")


@query(m.SQL + """
, born AS (SELECT user_id AS id, min(us) // 1000000 AS t FROM ev GROUP BY 1), near AS (SELECT a.id, count(b.id) AS nearby FROM born a LEFT JOIN born b ON b.id <> a.id AND abs(a.t - b.t) <= 300 GROUP BY 1),
base AS (SELECT id, regexp_replace(lower('Bot' || (id // 12) || 'x' || (id % 12)), '[0-9]+$', '') AS base, t // 86400 AS day FROM born), sim AS (SELECT a.id, count(b.id) AS alike FROM base a LEFT JOIN base b ON b.base = a.base AND b.id <> a.id GROUP BY 1)
SELECT id, round(r, 4)::DOUBLE AS risk, CASE WHEN r >= 0.7 THEN 'critical' WHEN r >= 0.5 THEN 'high' WHEN r >= 0.25 THEN 'medium' ELSE 'low' END AS level FROM (SELECT id, least(round((CASE WHEN nearby >= 3 THEN 0.35 WHEN nearby >= 1 THEN 0.15 ELSE 0 END
+ CASE WHEN alike >= 2 THEN 0.3 WHEN alike >= 1 THEN 0.1 ELSE 0 END + CASE WHEN id IN (SELECT src FROM follows) THEN 0 ELSE 0.15 END + CASE WHEN id % 3 = 0 THEN 0.1 ELSE 0 END)::DOUBLE, 6), 1.0) AS r FROM near JOIN sim USING (id))
""")
def sybil_risk(spark, d):
    """Risk of each entity from bursts of creation, similar names, inactivity and unverified addresses."""
    born = m.events(spark, d).groupBy(F.col("user_id").alias("id")).agg(F.floor(F.min("us") / 1_000_000).alias("t"))
    name = F.concat(F.lit("Bot"), F.floor(F.col("id") / 12).cast("string"), F.lit("x"), (F.col("id") % 12).cast("string"))
    base = born.select("id", F.regexp_replace(F.lower(name), "[0-9]+$", "").alias("base"))
    similar = base.join(base.groupBy("base").agg((F.count(F.lit(1)) - 1).alias("similar")), "base").select("id", "similar")
    active = m.follows(spark, d).select(F.col("src").alias("id"), F.lit(True).alias("active")).distinct()
    rows = band_counts(born, "id", "t", 300).join(similar, "id").join(active, "id", "left")
    risk = F.round(det.sybil_score(F.col("nearby"), F.col("similar"), F.coalesce("active", F.lit(False)), F.col("id") % 3 != 0), 6)
    return rows.select("id", F.round(risk, 4).alias("risk"), ladder(risk, [(0.7, "critical"), (0.5, "high"), (0.25, "medium")], "low").alias("level"))


@query(m.SQL + "SELECT post, count(*) AS reports, round(sum(coalesce(balance / 10000, 1.0)), 6) AS weight, sum(coalesce(balance / 10000, 1.0)) >= 5 AS hidden FROM flags LEFT JOIN entities ON id = reporter GROUP BY 1")
def auto_hide(spark, d):
    e = m.entities(spark, d).select(F.col("id").alias("reporter"), "balance")
    s = m.flags(spark, d).join(e, "reporter", "left").groupBy("post").agg(F.count(F.lit(1)).alias("reports"), F.sum(F.coalesce(F.col("balance") / 10000, F.lit(1.0))).alias("w"))
    return s.select("post", "reports", r6(F.col("w")).alias("weight"), (F.col("w") >= 5).alias("hidden"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 6 < 2 THEN 'tier' WHEN least(p_size * 2, p_partkey % 101) < 40 THEN 'category' WHEN p_partkey % 3000 > 1800 THEN 'stale' ELSE 'allow' END AS decision FROM part
""")
def gateway_decision(spark, d):
    """Allow, or the first reason not to: tier, a weak category, a stale scan."""
    p, k = load(spark, d, "part"), F.col("p_partkey")
    scores = F.create_map(F.lit("code"), F.col("p_size").cast("long") * 2, F.lit("data"), k % 101)
    return p.select("p_partkey", det.gateway(k % 6, F.lit(2), scores, k % 3000, F.lit(1800)).alias("decision"))


@query("""
WITH need(kind, least) AS (VALUES ('view', 0.0), ('click', 0.1), ('signup', 0.3), ('purchase', 0.5), ('error', 0.2)), e AS (SELECT event_type, c_acctbal / 10000 AS s FROM events JOIN customer ON c_custkey = user_id)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE s >= least) AS allowed FROM e JOIN need ON kind = event_type GROUP BY 1
""")
def interaction_threshold(spark, d):
    """Interactions that meet the least trust of their kind, from a small table of thresholds."""
    need = spark.createDataFrame([("view", 0.0), ("click", 0.1), ("signup", 0.3), ("purchase", 0.5), ("error", 0.2)], "event_type string, least double")
    e = load(spark, d, "events").join(load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") / 10000).alias("s")), "user_id")
    return e.join(F.broadcast(need), "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") >= F.col("least")).alias("allowed"))


@query("""
WITH a AS (SELECT o_custkey AS id, o_orderkey % 7 AS tool, max(o_orderkey * 31 % 5) AS digest FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL), b AS (SELECT o_custkey AS id, o_orderkey % 7 AS tool, max(o_orderkey * 31 % 5) AS digest FROM orders WHERE o_orderkey % 3 = 1 GROUP BY ALL),
j AS (SELECT coalesce(a.id, b.id) AS id, a.digest AS x, b.digest AS y FROM a FULL JOIN b ON a.id = b.id AND a.tool = b.tool)
SELECT id, count(*) FILTER (WHERE x <> y) AS changed, count(*) FILTER (WHERE y IS NULL) AS removed, count(*) FILTER (WHERE x IS NULL) AS added, count(*) FILTER (WHERE x <> y OR y IS NULL) > 0 AS drift FROM j GROUP BY 1
""")
def snapshot_drift(spark, d):
    """Digests of tools in two snapshots: changed or removed ones are drift, added ones are not."""
    o = load(spark, d, "orders")
    snap = lambda r, n: o.where(F.col("o_orderkey") % 3 == r).groupBy(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 7).alias("tool")).agg(F.max(F.col("o_orderkey") * 31 % 5).alias(n))
    j = snap(0, "x").join(snap(1, "y"), ["id", "tool"], "full_outer")
    c = j.groupBy("id").agg(F.count_if(F.col("x") != F.col("y")).alias("changed"), F.count_if(F.col("y").isNull()).alias("removed"), F.count_if(F.col("x").isNull()).alias("added"))
    return c.withColumn("drift", F.col("changed") + F.col("removed") > 0)
