"""Relational queries: filters, joins, aggregates, windows, sorts, set operations."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.exprs import ladder, like_escape, ratio, visible
from weftline.operators.selection import exact_percentile
from weftline.operators.tables import band_counts, insert_new, latest, outliers, shares, streaks, top_per_key, upsert, upsert_counting, window_counts
from weftline.plans import model as m
from weftline.plans.registry import load, query

cents = lambda c: F.round(F.col(c) * 100).cast("long")
r6 = lambda c: F.round(c, 6)


@query("""
SELECT c_custkey, c_name, orders, spent, row_number() OVER (ORDER BY spent DESC, c_custkey) AS place FROM (
  SELECT c_custkey, c_name, count(o_orderkey) AS orders, coalesce(sum(cast(round(o_totalprice * 100) AS BIGINT)), 0)::BIGINT AS spent
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
ORDER BY spent DESC, c_custkey LIMIT 100
""")
def leaderboard(spark, d):
    """Customers by cents spent: orders are aggregated before the join, and only the top rows are numbered."""
    spent = load(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"), F.sum(cents("o_totalprice")).alias("spent"))
    all_ = load(spark, d, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    top = all_.select("c_custkey", "c_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("spent", F.lit(0)).alias("spent")).orderBy(F.desc("spent"), "c_custkey").limit(100)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("spent"), "c_custkey")).cast("long"))


@query(m.SQL + """
SELECT e.id, e.name, e.tier FROM entities e LEFT JOIN (SELECT dst FROM follows WHERE src = 5) f ON f.dst = e.id
WHERE e.tier = 'public' OR e.id = 5 OR e.tier = 'verified' OR (e.tier = 'private' AND f.dst IS NOT NULL)
""")
def visible_entities(spark, d):
    """Entities that a verified viewer may see; the viewer's follows come by a left join."""
    followed = m.follows(spark, d).where("src = 5").select(F.col("dst").alias("id"), F.lit(True).alias("followed"))
    e = m.entities(spark, d).join(followed, "id", "left")
    return e.where(visible(F.col("tier"), F.col("id") == 5, True, F.coalesce("followed", F.lit(False)))).select("id", "name", "tier")


@query("""
SELECT 'keeps_null' AS filter, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS f FROM customer) WHERE f IS NULL OR f <> 'MACHINERY'
UNION ALL SELECT 'drops_null', count(*) FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS f FROM customer) WHERE f <> 'MACHINERY'
UNION ALL SELECT 'is_false', count(*) FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS hidden FROM customer) WHERE hidden IS FALSE
""")
def null_aware_filters(spark, d):
    """Inequality that keeps nulls, the plain one that drops them, and IS FALSE: one pass, three counts."""
    c = load(spark, d, "customer").select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("f"), F.when(F.col("c_custkey") % 3 == 1, True).when(F.col("c_custkey") % 3 == 2, False).alias("hidden"))
    one = c.agg(F.count_if(F.col("f").isNull() | (F.col("f") != "MACHINERY")).alias("keeps_null"), F.count_if(F.col("f") != "MACHINERY").alias("drops_null"), F.count_if(~F.col("hidden")).alias("is_false"))
    return one.unpivot([], ["keeps_null", "drops_null", "is_false"], "filter", "n")


@query(r"SELECT doc_id, length(text) AS n FROM documents WHERE text ILIKE '%licen_ed under%' AND text NOT LIKE '%100\%%' ESCAPE '\'")
def ilike_search(spark, d):
    """Case-insensitive substring search with a wildcard, and an escaped literal that must not occur."""
    t = load(spark, d, "documents")
    return t.where(F.col("text").ilike("%licen_ed under%") & ~F.col("text").like(f"%{like_escape('100%')}%")).select("doc_id", F.length("text").cast("long").alias("n"))


@query("""
SELECT CASE WHEN url LIKE 'https://%' THEN 'secure' ELSE 'plain' END AS kind, count(*) AS n,
  count(*) FILTER (WHERE url NOT LIKE '%example.com%') AS elsewhere FROM pages GROUP BY 1
""")
def like_prefix_split(spark, d):
    u = F.col("url")
    return load(spark, d, "pages").groupBy(F.when(u.startswith("https://"), "secure").otherwise("plain").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~u.contains("example.com")).alias("elsewhere"))


@query("""
SELECT event_type, (props->>'k')::BIGINT % 10 AS bucket, count(*) AS n, count(*) FILTER (WHERE json_exists(props, '$.missing')) AS with_missing FROM events GROUP BY ALL
""")
def json_field_group(spark, d):
    e = load(spark, d, "events")
    return e.groupBy("event_type", (F.get_json_object("props", "$.k").cast("long") % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count(F.get_json_object("props", "$.missing")).alias("with_missing"))


@query(m.SQL + "SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM follows GROUP BY ALL")
def pair_normalised(spark, d):
    """Edges of either direction under one key."""
    f = m.follows(spark, d)
    return f.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT tier, grade, count(*) AS n FROM (SELECT CASE WHEN s >= 96 THEN 'verified' WHEN s >= 81 THEN 'trusted' WHEN s >= 51 THEN 'standard' WHEN s >= 31 THEN 'minimal' WHEN s >= 11 THEN 'restricted' ELSE 'blocked' END AS tier,
  CASE WHEN s >= 96 THEN 'A+' WHEN s >= 81 THEN 'A' WHEN s >= 61 THEN 'B' WHEN s >= 41 THEN 'C' WHEN s >= 21 THEN 'D' ELSE 'F' END AS grade
  FROM (SELECT p_partkey % 101 AS s FROM part)) GROUP BY ALL
""")
def tier_ladder(spark, d):
    """Tiers and letter grades of scores from 0 to 100."""
    s = load(spark, d, "part").select((F.col("p_partkey") % 101).alias("s"))
    tier = ladder(F.col("s"), [(96, "verified"), (81, "trusted"), (51, "standard"), (31, "minimal"), (11, "restricted")], "blocked")
    grade = ladder(F.col("s"), [(96, "A+"), (81, "A"), (61, "B"), (41, "C"), (21, "D")], "F")
    return s.groupBy(tier.alias("tier"), grade.alias("grade")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT c_custkey, CASE WHEN t < 0.3 THEN CAST(trunc(60 * (0.5 + t / 0.3 * 0.5)) AS INT) WHEN t < 0.7 THEN 60 ELSE CAST(trunc(60 * (1 + (t - 0.7) / 0.3)) AS INT) END AS requests
FROM (SELECT c_custkey, greatest(0, least(1, c_acctbal / 10000)) AS t FROM customer)
""")
def trust_scaled_limit(spark, d):
    """Requests a minute, piecewise linear in trust: half to full below 0.3, up to double above 0.7."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c_acctbal") / 10000))
    c = load(spark, d, "customer").select("c_custkey", t.alias("t"))
    limit = F.when(F.col("t") < 0.3, 60 * (0.5 + F.col("t") / 0.3 * 0.5)).when(F.col("t") < 0.7, 60.0).otherwise(60 * (1 + (F.col("t") - 0.7) / 0.3))
    return c.select("c_custkey", limit.cast("int").alias("requests"))


@query("""
SELECT o_orderkey, o_totalprice, c_name, n_name, r_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-04-01'
""")
def author_inner(spark, d):
    """Facts with their author and two small dimensions; the date range reaches the scan."""
    o = load(spark, d, "orders").where("o_orderdate >= timestamp_ntz'1998-01-01' and o_orderdate < timestamp_ntz'1998-04-01'")
    c = load(spark, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(load(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(load(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("o_orderkey", "o_totalprice", "c_name", "n_name", "r_name")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.toxic IS NULL AS unlabelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_score(spark, d):
    return load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("toxic").isNull().alias("unlabelled"))


@query("""
SELECT c_custkey, count(o_orderkey) AS urgent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1
""")
def left_compound_on(spark, d):
    """A condition in ON, so customers without such orders stay with 0."""
    urgent = load(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("o_orderkey").alias("urgent"))
    return load(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("urgent", F.lit(0)).alias("urgent"))


@query(m.SQL + "SELECT a.src AS a, a.dst AS b FROM follows a JOIN follows b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def mutual_pairs(spark, d):
    """Reciprocal follows: pairs whose normalised key occurs in both directions, by one aggregate instead of a self join."""
    f = m.follows(spark, d)
    both = f.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return both.where("n = 2").select("a", "b")


@query(m.SQL + "SELECT x.dst AS id, e.name FROM follows x JOIN follows y ON x.dst = y.dst JOIN entities e ON e.id = x.dst WHERE x.src = 3 AND y.src = 8")
def mutual_follows(spark, d):
    """Entities that two given entities both follow."""
    f = m.follows(spark, d)
    both = f.where("src = 3").select(F.col("dst").alias("id")).join(f.where("src = 8").select(F.col("dst").alias("id")), "id")
    return both.join(m.entities(spark, d).select("id", "name"), "id")


@query(m.SQL + "SELECT t.event_id, a.name AS issuer, b.name AS subject, t.context FROM attestations t JOIN entities a ON a.id = t.attester JOIN entities b ON b.id = t.target")
def double_dim(spark, d):
    """One dimension joined twice: issuer and subject of attestations."""
    e = m.entities(spark, d)
    t = m.attestations(spark, d).join(e.select(F.col("id").alias("attester"), F.col("name").alias("issuer")), "attester")
    return t.join(e.select(F.col("id").alias("target"), F.col("name").alias("subject")), "target").select("event_id", "issuer", "subject", "context")


@query(m.SQL + "SELECT event_id, voter, post FROM votes WHERE voter IN (SELECT dst FROM follows WHERE src = 10)")
def semi_following(spark, d):
    followed = m.follows(spark, d).where("src = 10").select(F.col("dst").alias("voter"))
    return m.votes(spark, d).join(followed, "voter", "left_semi").select("event_id", "voter", "post")


@query(m.SQL + """
SELECT f2.dst AS id, count(*) AS through FROM follows f1 JOIN follows f2 ON f2.src = f1.dst
WHERE f1.src = 10 AND f2.dst <> 10 AND f2.dst NOT IN (SELECT dst FROM follows WHERE src = 10) GROUP BY 1
""")
def suggested_follows(spark, d):
    """Friends of friends that are not followed yet, by an anti join."""
    f = m.follows(spark, d)
    own = f.where("src = 10").select("dst")
    second = own.withColumnRenamed("dst", "src").join(f, "src").where("dst <> 10").join(own, "dst", "left_anti")
    return second.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("through"))


@query("""
SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS active_suppliers,
(SELECT sum(cast(round(o_totalprice * 100) AS BIGINT))::BIGINT FROM orders WHERE o_orderstatus = 'F') AS settled
""")
def scalar_stats(spark, d):
    """Unrelated totals side by side: one-row aggregates joined by a cross join of single rows."""
    parts = [load(spark, d, "customer").agg(F.count(F.lit(1)).alias("customers")), load(spark, d, "orders").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.when(F.col("o_orderstatus") == "F", cents("o_totalprice"))).alias("settled"))]
    active = load(spark, d, "lineitem").agg(F.count_distinct("l_suppkey").alias("active_suppliers"))
    return parts[0].crossJoin(parts[1]).crossJoin(active)


@query(m.SQL + "SELECT a.event_id, count(b.event_id) AS nearby FROM flags a JOIN flags b ON abs(a.us // 1000000 - b.us // 1000000) <= 300 AND a.event_id <> b.event_id GROUP BY 1 UNION ALL SELECT event_id, 0 FROM flags a WHERE NOT EXISTS (SELECT 1 FROM flags b WHERE abs(a.us // 1000000 - b.us // 1000000) <= 300 AND a.event_id <> b.event_id)")
def band_join_5min(spark, d):
    """Other flags within five minutes of each, through time buckets."""
    return band_counts(m.flags(spark, d).select("event_id", F.floor(F.col("us") / 1_000_000).alias("s")), "event_id", "s", 300)


@query(m.SQL + """
SELECT event_id, bool_or(hit) AS contested FROM (SELECT a.event_id, abs(a.weight - b.weight) > 0.30 AS hit FROM attestations a JOIN attestations b USING (context, attester)) GROUP BY 1
""")
def conflict_flag(spark, d):
    """Signals that differ by more than 0.30 from another of the same kind and provider: the group's extremes decide."""
    w = W.partitionBy("context", "attester")
    low, high = F.min("weight").over(w), F.max("weight").over(w)
    return m.attestations(spark, d).select("event_id", (F.greatest(high - F.col("weight"), F.col("weight") - low) > 0.30).alias("contested"))


@query(m.SQL + """
SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS clicks, coalesce(b.n, 0) AS purchases, coalesce(b.n, 0) / nullif(a.n, 0)::DOUBLE AS rate
FROM (SELECT k, count(*) AS n FROM ev WHERE event_type = 'click' GROUP BY 1) a FULL JOIN (SELECT k, count(*) AS n FROM ev WHERE event_type = 'purchase' GROUP BY 1) b USING (k)
""")
def full_outer_attribution(spark, d):
    """Two sources by campaign, either of which may be missing."""
    e = m.events(spark, d)
    counted = lambda kind, name: e.where(F.col("event_type") == kind).groupBy("k").agg(F.count(F.lit(1)).alias(name))
    both = counted("click", "clicks").join(counted("purchase", "purchases"), "k", "full_outer")
    return both.select("k", F.coalesce("clicks", F.lit(0)).alias("clicks"), F.coalesce("purchases", F.lit(0)).alias("purchases"), ratio(F.coalesce("purchases", F.lit(0)), F.col("clicks"), None).alias("rate"))


@query(m.SQL + """
SELECT k, n, name FROM (SELECT k, count(*) AS n FROM ev WHERE event_type = 'click' GROUP BY 1 ORDER BY n DESC, k LIMIT 10) JOIN entities ON id = k
""")
def top_of_aggregate(spark, d):
    """The ten most followed keys, then their names."""
    top = m.events(spark, d).where("event_type = 'click'").groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k").limit(10)
    return top.join(m.entities(spark, d).select(F.col("id").alias("k"), "name"), "k").select("k", "n", "name")


@query(m.SQL + "SELECT t.event_id, coalesce(s.score, 0.5) AS weight FROM attestations t LEFT JOIN (SELECT id, round(balance / 10000, 4) AS score FROM entities WHERE id % 5 <> 0) s ON s.id = t.attester")
def reweight(spark, d):
    """Attestations take their attester's current score, 0.5 where there is none."""
    s = m.entities(spark, d).where("id % 5 <> 0").select(F.col("id").alias("attester"), F.round(F.col("balance") / 10000, 4).alias("score"))
    return m.attestations(spark, d).join(s, "attester", "left").select("event_id", F.coalesce("score", F.lit(0.5)).alias("weight"))


@query("SELECT conv_id, turn, role, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS p FROM conversations) WHERE p = 1")
def latest_message(spark, d):
    return latest(load(spark, d, "conversations"), ["conv_id"], [F.desc("turn"), F.col("role")]).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


@query("SELECT l_orderkey, count(*) AS n, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS parts FROM lineitem GROUP BY ALL")
def nested_capabilities(spark, d):
    """An owner's few entries as one nested list, in order of their keys."""
    p = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("l_partkey")).alias("keys"))
    return p.select("l_orderkey", "n", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("parts"))


@query(m.SQL + "SELECT count(*) AS n, count(*) FILTER (WHERE a.framework IS DISTINCT FROM b.framework) AS crossing FROM attestations t JOIN entities a ON a.id = t.attester JOIN entities b ON b.id = t.target")
def cross_pair_rate(spark, d):
    e = m.entities(spark, d)
    t = m.attestations(spark, d).join(e.select(F.col("id").alias("attester"), F.col("framework").alias("f1")), "attester").join(e.select(F.col("id").alias("target"), F.col("framework").alias("f2")), "target")
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("f1").eqNullSafe(F.col("f2"))).alias("crossing"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users, sum(CASE WHEN event_type = 'purchase' THEN round(value * 100)::BIGINT ELSE 0 END)::BIGINT AS revenue FROM events GROUP BY 1")
def growth_daily(spark, d):
    """Events, users and revenue by day; days without events are absent."""
    e = load(spark, d, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.sum(F.when(F.col("event_type") == "purchase", cents("value")).otherwise(0)).alias("revenue"))


@query("SELECT CAST(floor(l_discount * 100 + 0.5) AS BIGINT) // 1 AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def hist_tenths(spark, d):
    """A histogram of fixed width."""
    return load(spark, d, "lineitem").groupBy(F.floor(F.col("l_discount") * 100 + 0.5).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l.label, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM customer), 4) AS percent FROM (VALUES ('debt'), ('low'), ('middle'), ('high'), ('top')) l(label)
LEFT JOIN (SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 2500 THEN 'low' WHEN c_acctbal < 5000 THEN 'middle' WHEN c_acctbal <= 100000 THEN 'high' ELSE 'top' END AS label, count(*) AS n FROM customer GROUP BY 1) USING (label)
""")
def hist_labelled(spark, d):
    """Labelled half-open buckets, with empty ones filled and shares of the total."""
    b = F.col("c_acctbal")
    label = F.when(b < 0, "debt").when(b < 2500, "low").when(b < 5000, "middle").when(b <= 100000, "high").otherwise("top")
    counts = load(spark, d, "customer").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    labels = spark.createDataFrame([(x,) for x in ("debt", "low", "middle", "high", "top")], "label string")
    total = counts.agg(F.sum("n").alias("total"))
    return labels.join(counts, "label", "left").crossJoin(F.broadcast(total)).select("label", F.coalesce("n", F.lit(0)).alias("n"), F.round(100.0 * F.coalesce("n", F.lit(0)) / F.col("total"), 4).alias("percent"))


@query("SELECT h::INT AS hour, count(e.event_id) AS n FROM range(24) t(h) LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase' ) e ON hour(e.ts) = h GROUP BY 1")
def hourly_zero_filled(spark, d):
    counts = load(spark, d, "events").where("event_type = 'purchase'").groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(24).select(F.col("id").cast("int").alias("hour")).join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS day, nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS "view", nullif(count(*) FILTER (WHERE event_type = 'click'), 0) AS click,
nullif(count(*) FILTER (WHERE event_type = 'purchase'), 0) AS purchase FROM events GROUP BY 1
""")
def daily_pivot(spark, d):
    """Day by type; combinations that do not occur stay null."""
    e = load(spark, d, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).pivot("event_type", ["view", "click", "purchase"]).count()


@query("""
SELECT step, event_type, n, n / nullif(lag(n) OVER (ORDER BY step), 0)::DOUBLE AS conversion FROM (
SELECT s.step, s.event_type, count(DISTINCT e.user_id) AS n FROM (VALUES (1, 'view'), (2, 'click'), (3, 'signup'), (4, 'purchase')) s(step, event_type) LEFT JOIN events e ON e.event_type = s.event_type GROUP BY ALL)
""")
def funnel(spark, d):
    """Users by ordered step and the share of the step before."""
    steps = spark.createDataFrame([(1, "view"), (2, "click"), (3, "signup"), (4, "purchase")], "step int, event_type string")
    users = load(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n"))
    n = steps.join(users, "event_type", "left").select("step", "event_type", F.coalesce("n", F.lit(0)).alias("n"))
    return n.withColumn("conversion", ratio(F.col("n"), F.lag("n").over(W.orderBy("step")), None))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def count_distinct(spark, d):
    return load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"))


@query("SELECT c_mktsegment, round(median(c_acctbal), 6) AS median, round(stddev_samp(c_acctbal), 6) AS sd, round(stddev_pop(c_acctbal), 6) AS sd_pop, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY 1")
def median_std(spark, d):
    """Exact median, sample and population deviation."""
    b, c = F.col("c_acctbal"), load(spark, d, "customer")
    middle = exact_percentile(c, ["c_mktsegment"], "c_acctbal").select("c_mktsegment", r6(F.col("percentile")).alias("median"))
    return middle.join(c.groupBy("c_mktsegment").agg(r6(F.stddev_samp(b)).alias("sd"), r6(F.stddev_pop(b)).alias("sd_pop"), r6(F.avg(b)).alias("mean")), "c_mktsegment")


@query("SELECT l_shipmode_like AS flag, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, sum(l_quantity) FILTER (WHERE l_tax = 0)::BIGINT AS untaxed FROM (SELECT *, l_returnflag AS l_shipmode_like FROM lineitem) GROUP BY 1")
def filtered_counts(spark, d):
    li = load(spark, d, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.sum(F.when(F.col("l_tax") == 0, F.col("l_quantity"))).cast("long").alias("untaxed"))


@query(m.SQL + "SELECT post, round(sum(coalesce(w, 1.0)), 6) AS weight FROM (SELECT f.post, CASE WHEN f.reporter % 5 = 0 THEN NULL ELSE e.balance / 10000 END AS w FROM flags f LEFT JOIN entities e ON e.id = f.reporter) GROUP BY 1 HAVING sum(coalesce(w, 1.0)) >= 5")
def weighted_flag_sum(spark, d):
    """Reports weighted by the reporter's trust, 1 where unknown; posts that reach 5 are hidden."""
    e = m.entities(spark, d).select(F.col("id").alias("reporter"), "balance")
    w = F.when(F.col("reporter") % 5 != 0, F.col("balance") / 10000)
    sums = m.flags(spark, d).join(e, "reporter", "left").groupBy("post").agg(F.sum(F.coalesce(w, F.lit(1.0))).alias("weight"))
    return sums.where("weight >= 5").select("post", r6(F.col("weight")).alias("weight"))


@query(m.SQL + "SELECT user_id, count(*) AS n, count(DISTINCT k) AS targets FROM ev, clock WHERE us > now - 86400000000 GROUP BY 1 HAVING count(*) > 3")
def having_flood(spark, d):
    """Users with more than three events in the last day."""
    e = m.events(spark, d).crossJoin(F.broadcast(m.now(spark, d))).where("us > now - 86400000000")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("targets")).where("n > 3")


@query("SELECT coalesce(f, 'unknown') AS label, count(*) AS n, count(*) / (SELECT count(*) FROM customer)::DOUBLE AS share FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS f FROM customer) GROUP BY 1 HAVING count(*) > 0.15 * (SELECT count(*) FROM customer)")
def share_alert(spark, d):
    """Frameworks beyond a share of the population."""
    c = load(spark, d, "customer")
    label = F.coalesce(F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")), F.lit("unknown"))
    return shares(c, label).where("share > 0.15")


@query(m.SQL + "SELECT event_type, recent, prior, recent / nullif(prior / 29.0, 0) AS times FROM (SELECT event_type, count(*) FILTER (WHERE us > now - 86400000000) AS recent, count(*) FILTER (WHERE us <= now - 86400000000) AS prior FROM ev, clock GROUP BY 1)")
def spike_ratio(spark, d):
    """The last day against the mean day of the 29 before."""
    e = m.events(spark, d).crossJoin(F.broadcast(m.now(spark, d)))
    last = F.col("us") > F.col("now") - 86_400_000_000
    n = e.groupBy("event_type").agg(F.count_if(last).alias("recent"), F.count_if(~last).alias("prior"))
    return n.withColumn("times", ratio(F.col("recent"), F.col("prior") / 29.0, None))


@query(m.SQL + """
SELECT id, partner, n, place FROM (SELECT id, partner, count(*) AS n, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, partner) AS place FROM (
SELECT attester AS id, target AS partner FROM attestations UNION ALL SELECT target, attester FROM attestations) GROUP BY 1, 2) WHERE place <= 3
""")
def top_partners(spark, d):
    """Three most frequent partners of each entity, in either direction."""
    t = m.attestations(spark, d)
    both = t.select(F.col("attester").alias("id"), F.col("target").alias("partner")).unionByName(t.select(F.col("target").alias("id"), F.col("attester").alias("partner")))
    n = both.groupBy("id", "partner").agg(F.count(F.lit(1)).alias("n"))
    return top_per_key(n, ["id"], [F.desc("n"), F.col("partner")], 3).withColumn("place", F.col("place").cast("long"))


@query(m.SQL + """
SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS days, round(avg(value), 6) AS mean_value, count(*) FILTER (WHERE event_type = 'click') AS clicks,
count(DISTINCT k) AS partners, count(DISTINCT hour(ts)) AS hours FROM ev, clock WHERE us > now - 7 * 86400000000 GROUP BY 1
""")
def weekly_baseline(spark, d):
    """A behaviour vector per user over the last week, by one aggregate."""
    e = m.events(spark, d).crossJoin(F.broadcast(m.now(spark, d))).where("us > now - 7 * 86400000000")
    return e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("kinds"), F.count_distinct(F.date_format("ts", "yyyy-MM-dd")).alias("days"), r6(F.avg("value")).alias("mean_value"),
        F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_distinct("k").alias("partners"), F.count_distinct(F.hour("ts")).alias("hours"),
    )


@query("SELECT s_suppkey, r::INT AS rating, count(l_orderkey) AS n FROM supplier CROSS JOIN range(1, 6) t(r) LEFT JOIN lineitem ON l_suppkey = s_suppkey AND 1 + l_quantity::INT % 5 = r GROUP BY 1, 2")
def rating_summary(spark, d):
    """The spread of each supplier's ratings from 1 to 5, zeros included: five counts in one aggregate."""
    n = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(*(F.count_if(1 + F.col("l_quantity").cast("int") % 5 == r).alias(str(r)) for r in range(1, 6)))
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rating"), F.coalesce(F.col(str(r)), F.lit(0)).alias("n")) for r in range(1, 6))))
    return load(spark, d, "supplier").select("s_suppkey").join(n, "s_suppkey", "left").select("s_suppkey", each.alias("e")).select("s_suppkey", "e.*")


@query(m.SQL + "SELECT (SELECT count(*) FROM follows) AS edges, n AS vertices, (SELECT count(*) FROM follows) / (n * (n - 1.0)) AS density FROM (SELECT count(*) AS n FROM (SELECT src FROM follows UNION SELECT dst FROM follows))")
def density(spark, d):
    f = m.follows(spark, d)
    n = f.select(F.col("src").alias("v")).union(f.select("dst")).distinct().agg(F.count(F.lit(1)).alias("vertices"))
    return f.agg(F.count(F.lit(1)).alias("edges")).crossJoin(n).select("edges", "vertices", (F.col("edges") / (F.col("vertices") * (F.col("vertices") - 1.0))).alias("density"))


@query("SELECT role, count(*) AS n, sum(length(text) // 4)::BIGINT AS tokens, sum(CASE role WHEN 'user' THEN 3 WHEN 'assistant' THEN 15 ELSE 1 END * (length(text) // 4))::BIGINT AS micros FROM conversations GROUP BY 1")
def token_cost(spark, d):
    """Tokens (four characters each) and their cost by role."""
    tokens = F.floor(F.length("text") / 4)
    price = F.when(F.col("role") == "user", 3).when(F.col("role") == "assistant", 15).otherwise(1)
    return load(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(tokens).alias("tokens"), F.sum(price * tokens).alias("micros"))


@query("SELECT p_type, p_brand, n, place FROM (SELECT p_type, p_brand, count(*) AS n, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_brand) AS place FROM part GROUP BY 1, 2) WHERE place <= 5")
def category_trends(spark, d):
    """The five leading providers of each category."""
    n = load(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return top_per_key(n, ["p_type"], [F.desc("n"), F.col("p_brand")], 5).withColumn("place", F.col("place").cast("long"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS volume FROM orders GROUP BY ALL")
def moderation_stats(spark, d):
    """Cases by status and reason."""
    return load(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(cents("o_totalprice")).alias("volume"))


@query("""
SELECT n_name, count(DISTINCT c_custkey) AS members, count(o_orderkey) AS orders, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS done, round(count(o_orderkey) / nullif(count(DISTINCT c_custkey), 0)::DOUBLE, 6) AS per_member
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
""")
def fleet_dashboard(spark, d):
    """Per organisation: members, facts, ratios; each fact table is aggregated to the member before the join."""
    o = load(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("o"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    c = load(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("members"), F.sum("o").alias("orders"), F.sum("f").alias("done"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = load(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", zero("members"), zero("orders"), zero("done"))
    return out.withColumn("per_member", r6(ratio(F.col("orders"), F.col("members"), None)))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey, l_suppkey) AS p FROM lineitem) WHERE p = 1")
def distinct_on_latest(spark, d):
    return latest(load(spark, d, "lineitem"), ["l_orderkey"], [F.desc("l_shipdate"), F.desc("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]).select("l_orderkey", "l_linenumber", "l_partkey")


@query(m.SQL + "SELECT target, count(*) AS n, round(sum(weight), 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY target, attester % 10 ORDER BY us, event_id) AS p FROM attestations) WHERE p <= 2 GROUP BY 1")
def cap_per_pair(spark, d):
    """At most two attestations of a group of attesters count for a target, the earliest."""
    t = m.attestations(spark, d).withColumn("group", F.col("attester") % 10)
    first = top_per_key(t, ["target", "group"], [F.col("us"), F.col("event_id")], 2)
    return first.groupBy("target").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("weight")).alias("weight"))


@query("""
WITH days AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type IN ('click', 'view')), runs AS (SELECT user_id, max(day) AS last, count(*) AS length FROM (
SELECT user_id, day, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS island FROM days) GROUP BY user_id, island)
SELECT user_id, max(length) AS longest, arg_max(length, last) AS "current", strftime(max(last), '%Y-%m-%d') AS last_day FROM runs GROUP BY 1
""")
def activity_streaks(spark, d):
    e = load(spark, d, "events").where("event_type in ('click', 'view')").select("user_id", F.to_date("ts").alias("day"))
    return streaks(e, "user_id", "day").withColumn("last_day", F.date_format("last_day", "yyyy-MM-dd"))


@query(m.SQL + "SELECT event_id, user_id, CASE WHEN value >= 75 AND before < 75 THEN 75 WHEN value >= 50 AND before < 50 THEN 50 ELSE 25 END AS milestone FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY us, event_id) AS before FROM ev) WHERE (value >= 75 AND before < 75) OR (value >= 50 AND before < 50) OR (value >= 25 AND before < 25)")
def milestones(spark, d):
    """Rises over 25, 50 or 75 from one reading to the next: the highest that was crossed."""
    e = m.events(spark, d).withColumn("before", F.lag("value").over(W.partitionBy("user_id").orderBy("us", "event_id")))
    up = lambda t: (F.col("value") >= t) & (F.col("before") < t)
    return e.where(up(75) | up(50) | up(25)).select("event_id", "user_id", F.when(up(75), 75).when(up(50), 50).otherwise(25).alias("milestone"))


@query("SELECT s_suppkey, round((s_acctbal - mean) / sd, 6) AS z FROM supplier, (SELECT avg(s_acctbal) AS mean, stddev_pop(s_acctbal) AS sd FROM supplier) WHERE abs((s_acctbal - mean) / sd) > 1.2")
def zscore_outliers(spark, d):
    return outliers(load(spark, d, "supplier"), "s_acctbal", 1.2).select("s_suppkey", r6(F.col("z")).alias("z"))


@query(m.SQL + "SELECT a.event_id, (SELECT count(*) FROM ev b WHERE b.user_id = a.user_id AND b.us // 1000000 BETWEEN a.us // 1000000 - 3600 AND a.us // 1000000) AS in_window FROM ev a")
def sliding_window(spark, d):
    """Events of the same user in the hour up to each event."""
    e = m.events(spark, d).select("event_id", "user_id", F.floor(F.col("us") / 1_000_000).alias("s"))
    return window_counts(e, "user_id", "s", 3600).select("event_id", "in_window")


@query(m.SQL + """
SELECT source, id, us FROM (SELECT 'vote' AS source, event_id AS id, us FROM votes UNION ALL SELECT 'attestation', event_id, us FROM attestations UNION ALL SELECT 'flag', event_id, us FROM flags) ORDER BY us DESC, id LIMIT 50
""")
def merge_timeline(spark, d):
    """The latest rows of several sources in one order; each source could be cut to 50 first, as the sort does per task."""
    parts = [t.select(F.lit(n).alias("source"), F.col("event_id").alias("id"), "us") for n, t in (("vote", m.votes(spark, d)), ("attestation", m.attestations(spark, d)), ("flag", m.flags(spark, d)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy(F.desc("us"), "id").limit(50)


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= 20 AS on_page FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 21 OFFSET 40)")
def page_with_more(spark, d):
    """A page by offset with one row more, which tells whether another page follows."""
    p = load(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(21)
    return p.select("o_orderkey", "o_totalprice", (F.row_number().over(W.orderBy(F.desc("o_totalprice"), "o_orderkey")) <= 20).alias("on_page"))


@query("SELECT o_orderkey FROM orders WHERE (o_totalprice, -o_orderkey) < (400000.0, -100) ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def keyset_page(spark, d):
    """A page after a (sort key, id) cursor, which never skips or repeats rows."""
    o = load(spark, d, "orders").where("o_totalprice < 400000.0 or (o_totalprice = 400000.0 and o_orderkey > 100)")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey")


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id LIMIT 200")
def nulls_last(spark, d):
    t = load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return t.orderBy(F.desc_nulls_last("quality"), "doc_id").limit(200)


@query(m.SQL + "SELECT src AS id FROM follows UNION SELECT dst FROM follows UNION SELECT voter FROM votes")
def union_distinct(spark, d):
    f = m.follows(spark, d)
    return f.select(F.col("src").alias("id")).union(f.select("dst")).union(m.votes(spark, d).select("voter")).distinct()


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM (SELECT o_orderdate FROM orders UNION ALL SELECT l_shipdate FROM lineitem) GROUP BY 1")
def union_all_dates(spark, d):
    both = load(spark, d, "orders").select(F.col("o_orderdate").alias("day")).unionByName(load(spark, d, "lineitem").select(F.col("l_shipdate").alias("day")))
    return both.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


_BAGS = "SELECT o_custkey AS id, list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderkey % 2 = 0))) AS a, list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderkey % 2 = 1))) AS b FROM orders GROUP BY 1"


@query(f"SELECT id, array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))), ',') AS removed, array_to_string(list_sort(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))), ',') AS added, array_to_string(list_sort(list_intersect(coalesce(a, []), coalesce(b, []))), ',') AS kept FROM ({_BAGS})")
def array_diff(spark, d):
    """Capabilities removed, added and kept between two versions."""
    o = load(spark, d, "orders")
    bag = lambda r: F.array_sort(F.collect_set(F.when(F.col("o_orderkey") % 2 == r, F.col("o_orderpriority"))))
    v = o.groupBy(F.col("o_custkey").alias("id")).agg(bag(0).alias("a"), bag(1).alias("b"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return v.select("id", text(F.array_except("a", "b")).alias("removed"), text(F.array_except("b", "a")).alias("added"), text(F.array_intersect("a", "b")).alias("kept"))


@query("""
WITH v AS (SELECT o_custkey AS id, o_orderpriority AS k, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS x, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS y FROM orders GROUP BY ALL)
SELECT id, string_agg(k || ':' || x || '>' || y, ',' ORDER BY k) AS changes FROM v WHERE x <> y GROUP BY 1
""")
def map_diff(spark, d):
    """Changed entries of two maps over the union of their keys, as from > to."""
    n = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("k")).agg(F.count_if(F.col("o_orderkey") % 2 == 0).alias("x"), F.count_if(F.col("o_orderkey") % 2 == 1).alias("y"))
    maps = n.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("a"), F.map_from_entries(F.collect_list(F.struct("k", "y"))).alias("b"))
    both = F.map_filter(F.map_zip_with("a", "b", lambda k, p, q: F.struct(p.alias("p"), q.alias("q"))), lambda k, v: ~v["p"].eqNullSafe(v["q"]))
    rows = F.array_sort(F.transform(F.map_entries(both), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["p"].cast("string"), F.lit(">"), e["value"]["q"].cast("string"))))
    return maps.select("id", F.array_join(rows, ",").alias("changes")).where("changes <> ''")


@query("""
WITH old AS (SELECT c_custkey AS id, c_acctbal AS score, 1 AS version FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS id, c_acctbal / 2 AS score, c_custkey % 4 AS version FROM customer WHERE c_custkey % 2 = 0)
SELECT id, score, version::INT AS version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, new DESC) AS p FROM (SELECT *, 0 AS new FROM old UNION ALL SELECT *, 1 FROM new)) WHERE p = 1
""")
def upsert_latest(spark, d):
    c = load(spark, d, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"), F.lit(1).alias("version"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 2).alias("score"), (F.col("c_custkey") % 4).cast("int").alias("version"))
    return upsert(old, new, ["id"], F.col("version"))


@query("SELECT user_id, sum(n)::BIGINT AS n, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM (SELECT user_id, 1 AS n, event_type, event_id FROM events) GROUP BY 1")
def upsert_count(spark, d):
    """Counters add up on conflict and the latest row's columns win."""
    e = load(spark, d, "events").select("user_id", F.lit(1).cast("long").alias("n"), "event_type", "event_id")
    return upsert_counting(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "n", "event_id")


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000)")
def insert_missing(spark, d):
    """Rows whose key is not in the target yet."""
    return insert_new(load(spark, d, "customer").where("c_acctbal > 3000").select(F.col("c_custkey").alias("id")), load(spark, d, "orders").select(F.col("o_custkey").alias("id")), ["id"])
