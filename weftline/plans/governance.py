"""Gates, catalogues, moderation and collusion queries: JSON and date predicates, thresholds, rollups, pruning."""

from pyspark.sql import functions as F

from weftline.functions.exprs import DAY_US, age_days, ladder, ratio
from weftline.operators import detectors as det
from weftline.operators import graph as g
from weftline.operators import scanner as sc
from weftline.operators import trust as t
from weftline.operators.tables import latest, maximal_sets, prune
from weftline.plans import model as m
from weftline.plans.registry import load, query
from weftline.plans.texts import _LINES
from weftline.sources.sinks import append_bounded, delivery_health, import_content
from weftline.sources.trees import LANGUAGES, SKIPPED, SOURCE, coverage, languages, source_files

r6 = lambda c: F.round(c, 6)
n_rows = lambda name="n": F.count(F.lit(1)).alias(name)


@query(m.SQL + """SELECT event_id FROM ev WHERE json_contains(('["' || event_type || '","t' || (k % 5) || '"]')::JSON, '["click","t3"]'::JSON)""")
def json_contains(spark, d):
    """A JSON list that contains all entries of another."""
    e = m.events(spark, d)
    tags = F.from_json(F.concat(F.lit('["'), "event_type", F.lit('","t'), (F.col("k") % 5).cast("string"), F.lit('"]')), "array<string>")
    return e.where(F.array_contains(tags, "click") & F.array_contains(tags, "t3")).select("event_id")


@query(m.SQL + """
SELECT CASE WHEN NOT json_exists(j, '$.a') THEN 'missing' WHEN json_type(j, '$.a') = 'NULL' THEN 'null' ELSE 'value' END AS kind, count(*) AS n
FROM (SELECT (CASE k % 3 WHEN 0 THEN '{"a":null}' WHEN 1 THEN '{"b":1}' ELSE '{"a":1}' END)::JSON AS j FROM ev) GROUP BY 1
""")
def json_null_or_missing(spark, d):
    """A key that is absent, one with a JSON null, and one with a value."""
    j = F.when(F.col("k") % 3 == 0, '{"a":null}').when(F.col("k") % 3 == 1, '{"b":1}').otherwise('{"a":1}')
    kind = F.when(~F.array_contains(F.json_object_keys("j"), "a"), "missing").when(F.get_json_object("j", "$.a").isNull(), "null").otherwise("value")
    return m.events(spark, d).select(j.alias("j")).groupBy(kind.alias("kind")).agg(n_rows())


@query(m.SQL + "SELECT target, count(*) AS n, count(*) FILTER (WHERE (event_id % 7 = 0 OR us + (event_id % 40) * 86400000000 > now) AND event_id % 11 <> 0) AS valid FROM attestations, clock GROUP BY 1")
def valid_attestations(spark, d):
    """Attestations that have not expired (some never do) and are not revoked."""
    a = m.attestations(spark, d).crossJoin(F.broadcast(m.now(spark, d)))
    expires = F.when(F.col("event_id") % 7 != 0, F.col("us") + F.col("event_id") % 40 * DAY_US)
    live = (expires.isNull() | (expires > F.col("now"))) & (F.col("event_id") % 11 != 0)
    return a.groupBy("target").agg(n_rows(), F.count_if(live).alias("valid"))


@query("SELECT doc_id, coalesce(quality, -1)::INT AS quality FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'en' AND lower(text) LIKE '%ing%' AND coalesce(toxic, 0) = 0")
def catalog_filter(spark, d):
    """Catalogue filters: a facet, a text, and a class of coalesced counts."""
    docs = load(spark, d, "documents").where((F.col("lang") == "en") & F.lower("text").contains("ing")).select("doc_id")
    both = docs.join(load(spark, d, "labels"), "doc_id", "left").where(F.coalesce("toxic", F.lit(0)) == 0)
    return both.select("doc_id", F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"))


_SORTS = {"best": (lambda: [F.coalesce(F.nullif(F.col("quality"), F.lit(0)), F.lit(-1)).desc(), F.col("doc_id")]), "worst": (lambda: [F.coalesce("quality", F.lit(999)), F.col("doc_id")])}


@query("""
SELECT 'best' AS sort, * FROM (SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) ORDER BY coalesce(nullif(quality, 0), -1) DESC, doc_id LIMIT 15)
UNION ALL SELECT 'worst', * FROM (SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) ORDER BY coalesce(quality, 999), doc_id LIMIT 15)
""")
def sentinel_sorts(spark, d):
    """Sorts with sentinels for missing values: -1 falling, where 0 counts as missing too, and 999 rising."""
    both = load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels"), "doc_id", "left")
    top = [both.orderBy(*_SORTS[s]()).limit(15).select(F.lit(s).alias("sort"), "doc_id") for s in ("best", "worst")]
    return top[0].unionByName(top[1])


@query("""
WITH o AS (SELECT o_custkey AS id, min(epoch_us(o_orderdate)) AS first FROM orders GROUP BY 1), clk AS (SELECT max(epoch_us(o_orderdate)) AS now FROM orders)
SELECT c_custkey, s IS NULL OR s >= 0.3 OR coalesce((now - first) // 86400000000 < 7, false) AS allowed FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 > 0 THEN c_acctbal / 10000 END AS s FROM customer) LEFT JOIN o ON id = c_custkey, clk
""")
def publish_check(spark, d):
    """May publish: enough trust, no score yet, or in the first week."""
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    first, now = o.groupBy("c_custkey").agg(F.min("us").alias("first")), o.agg(F.max("us").alias("now"))
    c = load(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 > 0, F.col("c_acctbal") / 10000).alias("s")).join(first, "c_custkey", "left").crossJoin(F.broadcast(now))
    return c.select("c_custkey", t.may_publish(F.col("s"), age_days(F.col("first"), F.col("now"))).alias("allowed"))


@query(f"""
SELECT action, count(*) AS n, count(*) FILTER (WHERE c_acctbal / 10000 >= least) AS allowed FROM customer, (VALUES {", ".join(f"('{a}', {v})" for a, v in t.ACTION_GATES.items())}) need(action, least) GROUP BY 1
""")
def action_gates(spark, d):
    """Entities that pass the gate of each action: one pass with a count for each."""
    s = load(spark, d, "customer").select((F.col("c_acctbal") / 10000).alias("s"))
    one = s.agg(n_rows(), *(F.count_if(F.col("s") >= v).alias(a) for a, v in t.ACTION_GATES.items()))
    return one.unpivot(["n"], list(t.ACTION_GATES), "action", "allowed").select("action", "n", "allowed")


@query(m.SQL + "SELECT k, greatest(count(*) FILTER (WHERE event_type = 'click') - count(*) FILTER (WHERE event_type = 'view'), 0) AS members FROM ev GROUP BY 1")
def clamped_counter(spark, d):
    """A counter of joins less leaves that never falls below zero."""
    return m.events(spark, d).groupBy("k").agg(F.greatest(F.count_if(F.col("event_type") == "click") - F.count_if(F.col("event_type") == "view"), F.lit(0)).alias("members"))


@query("SELECT o_custkey, count(*) AS expired FROM orders, (SELECT max(epoch_us(o_orderdate)) AS now FROM orders) WHERE o_orderstatus = 'P' AND epoch_us(o_orderdate) + 30 * 86400000000 < now GROUP BY 1")
def provisional_expiry(spark, d):
    """Provisional rows whose term of 30 days is over."""
    o = load(spark, d, "orders").withColumn("us", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    over = o.where("o_orderstatus = 'P'").crossJoin(F.broadcast(o.agg(F.max("us").alias("now")))).where(F.col("us") + 30 * DAY_US < F.col("now"))
    return over.groupBy("o_custkey").agg(n_rows("expired"))


@query("SELECT c_custkey, v FROM (SELECT c_custkey, CASE WHEN c_custkey % 50 > 0 THEN c_acctbal END AS v FROM customer) ORDER BY v DESC NULLS FIRST, c_custkey LIMIT 30")
def nulls_first(spark, d):
    """Falling order with nulls first, as some databases have it by default."""
    return load(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 50 > 0, F.col("c_acctbal")).alias("v")).orderBy(F.desc_nulls_first("v"), "c_custkey").limit(30)


#: Sort keys that a caller may name.
LISTING_SORTS = {"newest": ["-p_partkey"], "price_low": ["p_retailprice", "p_partkey"], "price_high": ["-p_retailprice", "p_partkey"], "size": ["-p_size", "p_partkey"]}


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS sort, p_partkey FROM part ORDER BY {', '.join(k[1:] + ' DESC' if k[0] == '-' else k for k in keys)} LIMIT 10)" for name, keys in LISTING_SORTS.items()))
def enumerated_sorts(spark, d):
    """The first page under each sort of a fixed list."""
    p, out = load(spark, d, "part"), None
    for name, keys in LISTING_SORTS.items():
        page = p.orderBy(*(F.desc(k[1:]) if k[0] == "-" else F.asc(k) for k in keys)).limit(10).select(F.lit(name).alias("sort"), "p_partkey")
        out = page if out is None else out.unionByName(page)
    return out


@query(m.SQL + """
, s AS (SELECT reporter AS id, list_sort(list(DISTINCT post)) AS s FROM flags GROUP BY 1)
SELECT id, len(s) AS size FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE (len(b.s) > len(a.s) AND list_has_all(b.s, a.s)) OR (b.s = a.s AND b.id < a.id))
""")
def maximal_post_sets(spark, d):
    """Reporters whose set of posts no other reporter's set contains; of equal sets the first."""
    f = m.flags(spark, d).select(F.col("reporter").alias("id"), F.col("post").alias("item"))
    return maximal_sets(f).select("id", F.col("n").alias("size"))


@query("""
SELECT c_custkey, CASE WHEN mean = 0 THEN 'Not enough data to estimate percentile' WHEN r >= 2.0 THEN 'Top 5% — well above platform average' WHEN r >= 1.5 THEN 'Top 15% — significantly above average'
WHEN r >= 1.1 THEN 'Top 35% — above average' WHEN r >= 0.9 THEN 'Around average' WHEN r >= 0.6 THEN 'Below average — room for improvement' ELSE 'Bottom 20% — significant improvement possible' END AS standing
FROM (SELECT c_custkey, mean, CASE WHEN mean > 0 THEN round(c_acctbal / mean, 9) ELSE 0 END AS r FROM customer, (SELECT avg(c_acctbal) AS mean FROM customer))
""")
def percentile_text(spark, d):
    """A standing in words from the ratio to the mean."""
    c = load(spark, d, "customer").select("c_custkey", "c_acctbal")
    both = c.crossJoin(F.broadcast(c.agg(F.avg("c_acctbal").alias("mean"))))
    return both.select("c_custkey", t.standing(F.round(F.col("c_acctbal") / F.col("mean"), 9), F.col("mean")).alias("standing"))


@query("""
WITH c AS (SELECT c_custkey AS id, c_custkey % 3 = 1 AS human, CASE WHEN c_mktsegment = 'MACHINERY' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS m, (c_custkey % 5) / 4.0::DOUBLE AS v, (c_custkey % 7) / 6.0::DOUBLE AS a FROM customer),
u AS (SELECT id, 'verification' AS source, v AS raw, (0.35::DOUBLE + CASE WHEN human THEN 0.05::DOUBLE ELSE 0 END) * v * m AS w FROM c UNION ALL SELECT id, 'activity', a, 0.20::DOUBLE * a * m FROM c UNION ALL SELECT id, 'scan', a, CASE WHEN human THEN 0 ELSE 0.15::DOUBLE END * a * m FROM c)
SELECT id, source, round(raw, 6) AS raw, round(w, 4) AS weighted FROM u WHERE w <> 0
""")
def contributions(spark, d):
    """Components as weighted contributions; those of weight or value zero go."""
    k = F.col("c_custkey")
    human = k % 3 == 1
    parts = {"verification": ((k % 5) / 4.0, 0.35 + F.when(human, 0.05).otherwise(0.0)), "activity": ((k % 7) / 6.0, F.lit(0.20)), "scan": ((k % 7) / 6.0, F.when(human, 0.0).otherwise(0.15))}
    out = t.contributions(load(spark, d, "customer"), parts, F.when(F.col("c_mktsegment") == "MACHINERY", 0.8).otherwise(1.0))
    return out.select(k.alias("id"), "source", r6(F.col("raw")).alias("raw"), F.round("weighted", 4).alias("weighted"))


_LOG = lambda v, top: f"least(ln(1 + {v}) / ln({top}.0::DOUBLE), 1)"


@query(f"""
SELECT p_partkey, round(0.50 * {_LOG("p_partkey * 37", 100001)} + 0.30 * {_LOG("p_size", 51)} + 0.20 * least(p_partkey % 9 / 5.0, 1), 4)::DOUBLE AS npm,
round(0.40 * {_LOG("p_partkey * 37", 100001)} + 0.35 * {_LOG("p_size", 51)} + 0.25 * least(p_partkey % 14 / 10.0, 1), 4)::DOUBLE AS pypi,
round(0.45 * {_LOG("p_partkey * 37", 50001)} + 0.35 * {_LOG("p_partkey % 300", 201)} + 0.20 * (p_partkey % 2), 4)::DOUBLE AS model_hub,
round(0.60 * {_LOG("p_partkey * 911", 1000001)} + 0.25 * {_LOG("p_partkey % 600", 501)} + 0.15 * (p_partkey % 3 = 0)::INT, 4)::DOUBLE AS image_hub FROM part
""")
def package_reputations(spark, d):
    """Reputations of packages, models and images from log-normalised counts."""
    p, k = load(spark, d, "part"), F.col("p_partkey")
    kinds = {
        "npm": t.npm_reputation(k * 37, F.col("p_size"), k % 9), "pypi": t.pypi_reputation(k * 37, F.col("p_size"), k % 14),
        "model_hub": t.model_reputation(k * 37, k % 300, k % 2 == 1), "image_hub": t.image_reputation(k * 911, k % 600, k % 3 == 0),
    }
    return p.select("p_partkey", *(F.round(c, 4).alias(n) for n, c in kinds.items()))


@query(m.SQL.replace("WITH ev", "WITH RECURSIVE ev") + """
, u AS (SELECT src, dst FROM follows UNION SELECT dst, src FROM follows), t(id, hops) AS (SELECT 7::BIGINT, 0 UNION SELECT u.dst, hops + 1 FROM t JOIN u ON u.src = t.id WHERE hops < 3)
SELECT id, min(hops) AS hops FROM t GROUP BY 1
""")
def ego_both_ways(spark, d):
    """Three hops around an entity along follows in either direction."""
    return g.bfs(m.follows(spark, d), 7, 3, directed=False).select("id", "hops")


@query(m.SQL.replace("WITH ev", "WITH RECURSIVE ev") + """
, r AS (SELECT DISTINCT target AS src, attester AS dst FROM attestations), t(id, hops) AS (SELECT 11::BIGINT, 0 UNION SELECT r.dst, hops + 1 FROM t JOIN r ON r.src = t.id WHERE hops < 5), l AS (SELECT id, min(hops) AS hops FROM t GROUP BY 1)
SELECT l.id, l.hops, min(p.id) AS parent FROM l LEFT JOIN r ON r.dst = l.id AND l.hops > 0 LEFT JOIN l p ON p.id = r.src AND p.hops = l.hops - 1 GROUP BY 1, 2
""")
def trust_levels(spark, d):
    """Attesters of an entity to five levels, each at its least depth under its least parent."""
    r = m.attestations(spark, d).select(F.col("target").alias("src"), F.col("attester").alias("dst"))
    return g.levels(r, 11, 5).select("id", "hops", "parent")


@query(m.SQL + """
, members AS (SELECT id FROM entities WHERE framework = 'MACHINERY'), inner_ AS (SELECT src, dst FROM follows WHERE src IN (SELECT id FROM members) AND dst IN (SELECT id FROM members))
SELECT id, (SELECT count(*) FROM inner_ WHERE src = id) AS follows_inside, (SELECT count(*) FROM inner_ WHERE dst = id) AS followed_inside FROM members
""")
def cluster_detail(spark, d):
    """Members of a cluster with their edges inside it."""
    members = m.entities(spark, d).where("framework = 'MACHINERY'").select("id")
    f = m.follows(spark, d)
    inside = f.join(members.withColumnRenamed("id", "src"), "src", "left_semi").join(members.withColumnRenamed("id", "dst"), "dst", "left_semi")
    ends = inside.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(inside.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    n = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return members.join(n, "id", "left").select("id", F.coalesce("o", F.lit(0)).alias("follows_inside"), F.coalesce("i", F.lit(0)).alias("followed_inside"))


@query(m.SQL + """
, a AS (SELECT DISTINCT attester, target FROM attestations)
SELECT x.target AS id, count(*) AS attesters, count(y.attester) AS back, count(y.attester) / count(*)::DOUBLE > 0.30 AS flagged FROM a x LEFT JOIN a y ON y.attester = x.target AND y.target = x.attester GROUP BY 1
""")
def collusion_check(spark, d):
    """Of each entity's attesters, those that it attests back; flagged above 30 percent."""
    n = det.reciprocity(m.attestations(spark, d), "attester", "target")
    return n.select("id", "attesters", "back", (F.col("back") / F.col("attesters") > 0.30).alias("flagged"))


@query(m.SQL + """
, c AS (SELECT f.src AS id, count(*) AS crossing FROM follows f JOIN entities a ON a.id = f.src JOIN entities b ON b.id = f.dst WHERE a.framework <> b.framework GROUP BY 1), st AS (SELECT avg(crossing) AS mean, stddev_pop(crossing) AS sd FROM c)
SELECT id, crossing, round(z, 6) AS z, CASE WHEN abs(z) >= 4 THEN 'high' WHEN abs(z) >= 3 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT id, crossing, CASE WHEN sd > 0 THEN (crossing - mean) / sd ELSE 0 END AS z FROM c, st) WHERE crossing > 10
""")
def cluster_anomaly(spark, d):
    """Entities with more than ten follows out of their cluster, with their z-score among all that have any."""
    labels = m.entities(spark, d).select("id", F.col("framework").alias("cluster"))
    c = g.cross_degree(m.follows(spark, d), labels)
    stats = c.agg(F.avg("crossing").alias("mean"), F.stddev_pop("crossing").alias("sd"))
    z = F.when(F.col("sd") > 0, (F.col("crossing") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return c.crossJoin(F.broadcast(stats)).where("crossing > 10").select("id", "crossing", r6(z).alias("z"), det.severity_of(z).alias("severity"))


@query(m.SQL + """
, born AS (SELECT user_id, min(us) AS us FROM ev GROUP BY 1), s AS (SELECT count(*) FILTER (WHERE born.us >= now - 86400000000) AS recent, count(*) FILTER (WHERE born.us < now - 86400000000 AND born.us >= now - 30 * 86400000000) / 30.0::DOUBLE AS daily FROM born, clock)
SELECT recent, round(daily, 6) AS daily, round(recent / nullif(daily, 0), 6) AS ratio, CASE WHEN recent / nullif(daily, 0) >= 6 THEN 'high' WHEN recent / nullif(daily, 0) > 3 THEN 'medium' ELSE 'none' END AS severity FROM s
""")
def registration_spike(spark, d):
    """Registrations of the last day against the daily mean of the month before: above three times is a spike."""
    born = m.events(spark, d).groupBy("user_id").agg(F.min("us").alias("us")).crossJoin(F.broadcast(m.now(spark, d)))
    day = F.col("now") - DAY_US
    s = born.agg(F.count_if(F.col("us") >= day).alias("recent"), (F.count_if((F.col("us") < day) & (F.col("us") >= F.col("now") - 30 * DAY_US)) / 30.0).alias("daily"))
    r = ratio(F.col("recent"), F.col("daily"), None)
    return s.select("recent", r6(F.col("daily")).alias("daily"), r6(r).alias("ratio"), F.when(r >= 6, "high").when(r > 3, "medium").otherwise("none").alias("severity"))


@query(m.SQL + """
SELECT target, context, nullif(count(*) FILTER (WHERE tier = 'public'), 0) AS "public", nullif(count(*) FILTER (WHERE tier = 'verified'), 0) AS verified, nullif(count(*) FILTER (WHERE tier = 'private'), 0) AS "private" FROM attestations JOIN entities ON id = attester GROUP BY 1, 2
""")
def capability_tiers(spark, d):
    """Endorsements of each capability by the tier of their authors."""
    e = m.entities(spark, d).select(F.col("id").alias("attester"), "tier")
    return m.attestations(spark, d).join(e, "attester").groupBy("target", "context").pivot("tier", ["public", "verified", "private"]).count()


@query(m.SQL + """
, p AS (SELECT user_id, count(*) AS acts FROM ev GROUP BY 1)
SELECT framework, count(*) AS n, count(*) FILTER (WHERE tier = 'verified') / nullif(count(*), 0)::DOUBLE AS verified_share, coalesce(sum(acts), 0)::BIGINT AS acts, coalesce(sum(acts), 0) / nullif(count(acts), 0)::DOUBLE AS acts_each FROM entities LEFT JOIN p ON user_id = id GROUP BY 1
""")
def type_breakdown(spark, d):
    """Entities by type with guarded ratios."""
    acts = m.events(spark, d).groupBy(F.col("user_id").alias("id")).agg(n_rows("acts"))
    s = m.entities(spark, d).join(acts, "id", "left").groupBy("framework").agg(n_rows(), F.count_if(F.col("tier") == "verified").alias("v"), F.coalesce(F.sum("acts"), F.lit(0)).alias("acts"), F.count("acts").alias("active"))
    return s.select("framework", "n", ratio(F.col("v"), F.col("n"), None).alias("verified_share"), "acts", ratio(F.col("acts"), F.col("active"), None).alias("acts_each"))


@query(m.SQL + "SELECT event_type, framework, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT k) AS targets FROM ev JOIN entities ON id = user_id GROUP BY 1, 2")
def social_usage(spark, d):
    """Use of each social feature by type of entity."""
    e = m.events(spark, d).join(m.entities(spark, d).select(F.col("id").alias("user_id"), "framework"), "user_id")
    return e.groupBy("event_type", "framework").agg(n_rows(), F.count_distinct("user_id").alias("users"), F.count_distinct("k").alias("targets"))


@query(m.SQL + "SELECT context, count(*) AS n, count(DISTINCT attester) AS attesters, count(DISTINCT target) AS targets, round(avg(weight), 6) AS weight FROM attestations GROUP BY 1")
def attestation_network(spark, d):
    """Size of the attestation network by context."""
    return m.attestations(spark, d).groupBy("context").agg(n_rows(), F.count_distinct("attester").alias("attesters"), F.count_distinct("target").alias("targets"), r6(F.avg("weight")).alias("weight"))


@query(_LINES + """
, pf AS (SELECT id, count(*) AS n, bool_or(severity = 'critical') AS c, bool_or(severity = 'high') AS h FROM found GROUP BY 1)
SELECT source, count(*) AS files, count(n) AS affected, coalesce(sum(n), 0)::BIGINT AS findings, count(*) FILTER (WHERE c) AS critical_files, count(*) FILTER (WHERE h) AS high_files FROM documents LEFT JOIN pf ON id = doc_id GROUP BY 1
""")
def scan_summary(spark, d):
    """Summary of a scanned corpus by source: findings are counted per file before the join."""
    docs = load(spark, d, "documents")
    per_file = sc.findings(docs).groupBy(F.col("id").alias("doc_id")).agg(n_rows("n"), F.bool_or(F.col("severity") == "critical").alias("c"), F.bool_or(F.col("severity") == "high").alias("h"))
    s = docs.select("doc_id", "source").join(per_file, "doc_id", "left").groupBy("source")
    return s.agg(n_rows("files"), F.count("n").alias("affected"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), F.count_if("c").alias("critical_files"), F.count_if("h").alias("high_files"))


_PATHS = """(SELECT doc_id, source, n_chars AS bytes, source || '/' || CASE doc_id % 7 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'tests/' WHEN 2 THEN '.venv/' ELSE 'src/' END || doc_id || ['.py', '.min.js', '.png', '.ts', '.PY', '', '.kt', '.lock', '/Dockerfile', '.ipynb', '.svg'][doc_id % 11 + 1] AS path FROM documents)"""


def _paths(spark, d):
    k = F.col("doc_id")
    folder = F.when(k % 7 == 0, "node_modules/").when(k % 7 == 1, "tests/").when(k % 7 == 2, ".venv/").otherwise("src/")
    endings = (".py", ".min.js", ".png", ".ts", ".PY", "", ".kt", ".lock", "/Dockerfile", ".ipynb", ".svg")
    ending = F.try_element_at(F.array(*map(F.lit, endings)), (k % len(endings) + 1).cast("int"))
    return load(spark, d, "documents").select("doc_id", "source", F.col("n_chars").alias("bytes"), F.concat("source", F.lit("/"), folder, k.cast("string"), ending).alias("path"))


@query(f"""
SELECT doc_id, path FROM (SELECT doc_id, path, row_number() OVER (PARTITION BY source ORDER BY path) AS p FROM {_PATHS} WHERE bytes <= 500000 AND NOT regexp_matches(path, '{SKIPPED}') AND regexp_matches(path, '{SOURCE}')) WHERE p <= 200
""")
def tree_files(spark, d):
    """Source files of a tree: no vendored folders, generated or other files, at most 200 a tree."""
    return source_files(_paths(spark, d), "source").select("doc_id", "path")


@query(f"""
SELECT source, count(*) FILTER (WHERE ok) AS scannable, least(count(*) FILTER (WHERE ok AND bytes <= 500000), 200) AS scanned, count(*) FILTER (WHERE ok) > 200 AS truncated
FROM (SELECT *, NOT regexp_matches(path, '{SKIPPED}') AND regexp_matches(path, '{SOURCE}') AS ok FROM {_PATHS}) GROUP BY 1
""")
def tree_coverage(spark, d):
    """How much of each tree a scan reads."""
    return coverage(_paths(spark, d), "source")


@query(f"SELECT source, arg_max(language, (n, language)) AS language FROM (SELECT source, CASE lower(regexp_extract(path, '(\\.[A-Za-z]+)$', 1)) {' '.join(f"WHEN '{e}' THEN '{n}'" for e, n in LANGUAGES.items())} END AS language, count(*) AS n FROM {_PATHS} GROUP BY ALL) WHERE language IS NOT NULL GROUP BY 1")
def tree_languages(spark, d):
    """The main language of each tree by file endings."""
    return languages(_paths(spark, d), "source")


@query("""
WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
k AS (SELECT * FROM l WHERE regexp_matches(content, '\\S') AND NOT regexp_matches(content, '^\\s*(#|//|\\*|/\\*)')),
f AS (SELECT id, min(line) FILTER (WHERE regexp_matches(content, 'AKIA[A-Z0-9]{16}|(?i:password|token|secret)\\s*[:=]')) AS sensitive, min(line) FILTER (WHERE regexp_matches(content, '(?i)licen')) AS file_read, min(line) FILTER (WHERE regexp_matches(content, '[0-9]{2}')) AS untrusted, min(line) FILTER (WHERE regexp_matches(content, ',')) AS outbound FROM k GROUP BY 1)
SELECT id, CASE WHEN sensitive IS NOT NULL THEN 'high' ELSE 'medium' END AS severity, coalesce(sensitive, file_read)::BIGINT AS line FROM f WHERE untrusted IS NOT NULL AND outbound IS NOT NULL AND (sensitive IS NOT NULL OR file_read IS NOT NULL)
""")
def toxic_flow(spark, d):
    """Files that join three capabilities, one finding each: private or file data, untrusted input, an outbound channel."""
    legs = {"sensitive": r"AKIA[A-Z0-9]{16}|(?i:password|token|secret)\s*[:=]", "file_read": "(?i)licen", "untrusted": "[0-9]{2}", "outbound": ","}
    return sc.composite(load(spark, d, "documents"), legs)


@query(r"""
WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), k AS (SELECT id, line, content AS s FROM l WHERE NOT regexp_matches(content, '^\s*(#|//|\*)'))
SELECT id, name, min(line)::BIGINT AS line, any_value(severity) AS severity FROM k JOIN (VALUES ('mail', '[a-z]+@[a-z]+', 'high'), ('licence', '(?i)licensed under', 'medium'), ('link', 'https?://', 'low')) r(name, pattern, severity) ON regexp_matches(s, pattern) GROUP BY 1, 2
""")
def listed_findings(spark, d):
    """The first match of each listed pattern in a file, as a dependency list is matched."""
    return sc.first_matches(load(spark, d, "documents"), (("mail", "high", "[a-z]+@[a-z]+"), ("licence", "medium", "(?i)licensed under"), ("link", "low", "https?://")))


@query(_LINES + r"""
, pf AS (SELECT id, count(*) FILTER (WHERE severity = 'critical') AS c, count(*) FILTER (WHERE severity = 'high') AS h, count(*) FILTER (WHERE severity = 'medium') AS m, count(*) AS n FROM found GROUP BY 1),
s AS (SELECT source, count(*) AS files, count(pf.n) AS affected, sum(coalesce(c, 0))::BIGINT AS c, sum(coalesce(h, 0))::BIGINT AS h, sum(coalesce(m, 0))::BIGINT AS m, coalesce(sum(pf.n), 0)::BIGINT AS n,
 bool_or(regexp_matches(text, '(?i)licensed under'))::INT + bool_or(contains(text, 'https://'))::INT + bool_or(regexp_matches(text, '[0-9]{4}-[0-9]{2}'))::INT AS positives, bool_or(regexp_matches(text, '(?i)copyright')) AS practice, sum(len(regexp_extract_all(text, '###')))::BIGINT AS marks FROM documents LEFT JOIN pf ON id = doc_id GROUP BY 1)
SELECT source, greatest(0, least(100, CASE WHEN c + h + m = 0 THEN 80 ELSE 70 END - CASE WHEN n = 0 THEN 0 ELSE trunc((c * 15 + h * 8 + m * 3) * least(1.0, 0.4 + affected / files::DOUBLE * 2.4)) END + least(positives * 5, 35) + CASE WHEN practice THEN 5 ELSE 0 END - 3 * greatest(marks - 3, 0)))::BIGINT AS score FROM s
""")
def scan_score_full(spark, d):
    """The score with positive signals, good practices and the penalty for suppressions."""
    docs = load(spark, d, "documents")
    facts = docs.select(F.col("doc_id").alias("id"), "source", F.array(F.col("text").rlike("(?i)licensed under"), F.col("text").contains("https://"), F.col("text").rlike("[0-9]{4}-[0-9]{2}")).alias("positives"), F.array(F.col("text").rlike("(?i)copyright")).alias("practices"), F.regexp_count("text", F.lit("###")).alias("suppressions"))
    return sc.scan_score_full(sc.findings(docs), facts, 3, 1)


@query(m.SQL + """
, s AS (SELECT k, count(*) AS checks, 100.0::DOUBLE * count(*) FILTER (WHERE event_type <> 'error') / count(*) AS up, avg(value) * 6 AS ms FROM ev GROUP BY 1)
SELECT k, checks, round(up, 6) AS uptime, round(CASE WHEN checks < 3 THEN 0 ELSE least(CASE WHEN up >= 99 THEN 0.8 WHEN up >= 95 THEN 0.6 WHEN up >= 90 THEN 0.4 WHEN up >= 80 THEN 0.2 ELSE 0 END + CASE WHEN ms < 200 THEN 0.2 WHEN ms < 500 THEN 0.1 ELSE 0 END, 1.0) END, 4)::DOUBLE AS score FROM s
""")
def poll_rollup(spark, d):
    """Polls of endpoints rolled up to uptime, and the reputation from it."""
    s = m.events(spark, d).groupBy("k").agg(n_rows("checks"), (100.0 * F.count_if(F.col("event_type") != "error") / F.count(F.lit(1))).alias("up"), (F.avg("value") * 6).alias("ms"))
    return s.select("k", "checks", r6(F.col("up")).alias("uptime"), F.round(t.endpoint_reputation(F.col("up"), F.col("ms"), F.col("checks")), 4).alias("score"))


@query(m.SQL + ", c AS (SELECT quantile_disc(us, 0.5) AS cursor FROM ev) SELECT event_id, us FROM ev, c WHERE us < cursor ORDER BY us DESC, event_id DESC LIMIT 51")
def feed_page(spark, d):
    """Newest first below an exclusive score, with one row more than the page to tell whether there is another."""
    e = m.events(spark, d)
    cursor = e.agg(F.percentile_disc(0.5).within_group("us") if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY us)").alias("cursor"))
    return e.crossJoin(F.broadcast(cursor.toDF("cursor"))).where("us < cursor").orderBy(F.desc("us"), F.desc("event_id")).limit(51).select("event_id", "us")


@query("""
WITH u AS (SELECT 'document' AS kind, doc_id AS id, text, n_chars AS score FROM documents UNION ALL SELECT 'message', conv_id, text, length(text) FROM conversations WHERE turn = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(substr(text, 1, 40)) ORDER BY score DESC, kind, id) AS p FROM u WHERE regexp_matches(text, '(?i)tion') AND length(text) > 0)
SELECT kind, id, score::BIGINT AS score FROM r WHERE p = 1 ORDER BY score DESC, kind, id LIMIT 40
""")
def news_merge(spark, d):
    """Two sources merged: the relevant, one of each opening, the best."""
    a = load(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text", F.col("n_chars").cast("long").alias("score"))
    b = load(spark, d, "conversations").where("turn = 0").select(F.lit("message").alias("kind"), F.col("conv_id").alias("id"), "text", F.length("text").cast("long").alias("score"))
    u = a.unionByName(b).where(F.col("text").rlike("(?i)tion")).select("kind", "id", "score", F.lower(F.substring("text", 1, 40)).alias("key"))
    return latest(u, ["key"], [F.desc("score"), F.col("kind"), F.col("id")]).select("kind", "id", "score").orderBy(F.desc("score"), "kind", "id").limit(40)


@query(m.SQL + "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE us > now - 86400000000) AS day, count(*) FILTER (WHERE us > now - 7 * 86400000000) AS week FROM ev, clock GROUP BY 1")
def recent_facets(spark, d):
    """Facet counts, with those of the last day and week."""
    e = m.events(spark, d).crossJoin(F.broadcast(m.now(spark, d)))
    return e.groupBy("event_type").agg(n_rows(), F.count_if(F.col("us") > F.col("now") - DAY_US).alias("day"), F.count_if(F.col("us") > F.col("now") - 7 * DAY_US).alias("week"))


@query(m.SQL + """
, log AS (SELECT user_id AS subscription, us AS attempt_at, event_type <> 'error' AS ok FROM ev), last AS (SELECT subscription, max(attempt_at) AS last_ok FROM log WHERE ok GROUP BY 1)
SELECT subscription, count(*) AS attempts, round(avg(ok::INT), 6) AS success, count(*) FILTER (WHERE NOT ok AND (last_ok IS NULL OR attempt_at > last_ok)) AS failing FROM log LEFT JOIN last USING (subscription) GROUP BY 1
""")
def delivery_log(spark, d):
    """Deliveries by subscription: attempts, success and failures since the last success."""
    log = m.events(spark, d).select(F.col("user_id").alias("subscription"), F.col("us").alias("attempt_at"), (F.col("event_type") != "error").alias("ok"))
    return delivery_health(log).select("subscription", "attempts", r6(F.col("success")).alias("success"), "failing")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY")
def retention_prune(spark, d):
    """Rows of the last 365 days before the latest."""
    o = load(spark, d, "orders")
    return prune(o.crossJoin(F.broadcast(o.agg(F.max("o_orderdate").alias("now")))), "o_orderdate", F.col("now"), 365).select("o_orderkey")


@query("""
SELECT l_orderkey, array_to_string(list_slice(a || b, greatest(len(a || b) - 3, 1), len(a || b)), ',') AS kept FROM (SELECT l_orderkey, coalesce(list(l_partkey ORDER BY l_linenumber, l_partkey) FILTER (WHERE l_linenumber <= 3), []) AS a, coalesce(list(l_partkey ORDER BY l_linenumber, l_partkey) FILTER (WHERE l_linenumber > 3), []) AS b FROM lineitem GROUP BY 1)
""")
def bounded_append(spark, d):
    """The last four entries of a list after another is appended; an order's lines are few."""
    part = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("l_linenumber", "l_partkey")))), lambda x: x["l_partkey"].cast("string"))
    n = F.col("l_linenumber")
    lists = load(spark, d, "lineitem").groupBy("l_orderkey").agg(part(n <= 3).alias("a"), part(n > 3).alias("b"))
    return lists.select("l_orderkey", F.array_join(append_bounded(F.col("a"), F.col("b"), 4), ",").alias("kept"))


@query("SELECT doc_id, substr(trim(text), 1, 10000) AS text FROM documents WHERE doc_id % 3 <> 0 AND trim(text) <> ''")
def imported_content(spark, d):
    """Content that is not stored yet, trimmed and cut to the length that is stored."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    return import_content(docs, docs.where("doc_id % 3 = 0"), "doc_id", "text")[0]


@query(m.SQL + "SELECT k, label, n FROM (SELECT k, count(*) AS n FROM ev GROUP BY 1) JOIN (VALUES (0, 'quiet'), (1, 'busy')) b(i, label) ON i = (n >= 8)::INT")
def activity_label(spark, d):
    """A label from a ladder over a count."""
    n = m.events(spark, d).groupBy("k").agg(n_rows())
    return n.select("k", ladder(F.col("n"), [(8, "busy")], "quiet").alias("label"), "n")


@query("""
WITH r AS (SELECT *, max(epoch_us(o_orderdate)) OVER () AS now FROM orders)
SELECT 'records' AS kind, count(*) AS n FROM r UNION ALL SELECT 'entities', count(DISTINCT o_custkey) FROM r UNION ALL SELECT 'last 30 days', count(*) FILTER (WHERE epoch_us(o_orderdate) >= now - 30 * 86400000000::BIGINT) FROM r
UNION ALL SELECT 'type ' || o_orderpriority, count(*) FROM r GROUP BY o_orderpriority
""")
def evolution_stats(spark, d):
    """Records of change: how many, of how many entities, of late, and by type: one pass counts by type and entity."""
    o = load(spark, d, "orders").select("o_custkey", "o_orderpriority", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    o = o.crossJoin(F.broadcast(o.agg(F.max("us").alias("now"))))  # one row
    per = o.groupBy("o_orderpriority").agg(n_rows("n"), F.count_if(F.col("us") >= F.col("now") - 30 * 86_400_000_000).alias("late"))
    kinds = per.select(F.concat(F.lit("type "), "o_orderpriority").alias("kind"), "n")
    totals = per.agg(F.sum("n").alias("records"), F.sum("late").alias("late")).crossJoin(o.agg(F.count_distinct("o_custkey").alias("entities")))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("n")) for k, c in (("records", "records"), ("entities", "entities"), ("last 30 days", "late"))]))
    return totals.select(rows.alias("r")).select("r.kind", "r.n").unionByName(kinds)


@query("SELECT event_id, round(greatest(value / 100, (event_id % 97) / 100.0::DOUBLE), 4) AS score, CASE WHEN greatest(value / 100, (event_id % 97) / 100.0::DOUBLE) >= 0.85 THEN 'block' WHEN greatest(value / 100, (event_id % 97) / 100.0::DOUBLE) >= 0.70 THEN 'flag' ELSE 'pass' END AS decision FROM events")
def moderation_scores(spark, d):
    """Block or flag by the greatest of a text's scores."""
    top = F.greatest(F.col("value") / 100, F.col("event_id") % 97 / 100.0)
    return load(spark, d, "events").select("event_id", F.round(top, 4).alias("score"), sc.moderation(top).alias("decision"))
