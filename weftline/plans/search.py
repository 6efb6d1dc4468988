"""Search queries: prefixes, all terms, ranks, facets, suggestions, an index join."""

from pyspark.sql import functions as F

from weftline.operators import fulltext as ft
from weftline.operators import search as s
from weftline.plans import model as m
from weftline.plans.registry import load, query
from weftline.sources.folders import stored

_WORDS = r"(SELECT doc_id, source, lang, text, regexp_extract_all(lower(text), '([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)', 1) AS w FROM documents)"


@query(f"SELECT doc_id, lang FROM {_WORDS} WHERE len(list_filter(w, lambda x: starts_with(x, 'licen'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'vers'))) > 0")
def prefix_search(spark, d):
    """Every term of the query begins some word."""
    return load(spark, d, "documents").where(s.text_has(F.col("text"), s.prefixes("Licen & VERS"), whole=False)).select("doc_id", "lang")


@query(f"SELECT doc_id, round(1000.0 * len(list_filter(w, lambda x: x IN ('the', 'and', 'that'))) / len(w), 6) AS rank FROM {_WORDS} WHERE list_contains(w, 'the') AND list_contains(w, 'and') AND list_contains(w, 'that') ORDER BY rank DESC, doc_id LIMIT 40")
def all_terms_search(spark, d):
    """All terms occur; ranked by their frequency."""
    terms = ["the", "and", "that"]
    t = load(spark, d, "documents").where(s.text_has(F.col("text"), terms))
    return t.select("doc_id", s.text_rank(F.col("text"), terms).alias("rank")).orderBy(F.desc("rank"), "doc_id").limit(40)


@query(f"""
SELECT 'documents' AS kind, count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS english FROM {_WORDS} WHERE list_contains(w, 'that')
UNION ALL SELECT 'messages', count(*), count(*) FILTER (WHERE role = 'user') FROM conversations WHERE lower(text) LIKE '%that%'
""")
def facets(spark, d):
    """Hits by kind with a conditional count each."""
    docs = load(spark, d, "documents").where(s.text_has(F.col("text"), ["that"])).agg(F.lit("documents").alias("kind"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("english"))
    talk = load(spark, d, "conversations").where(F.lower("text").contains("that")).agg(F.lit("messages").alias("kind"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "user").alias("english"))
    return docs.unionByName(talk)


@query("SELECT p_name AS suggestion, count(*) AS n FROM part WHERE lower(p_name) LIKE 'r%' GROUP BY 1 ORDER BY n DESC, suggestion LIMIT 8")
def suggest(spark, d):
    n = load(spark, d, "part").where(F.lower("p_name").startswith("r")).groupBy(F.col("p_name").alias("suggestion")).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "suggestion").limit(8)


@query(f"""
WITH i AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM {_WORDS}) GROUP BY ALL), q AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(text), '([^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+)', 1)) AS term FROM benchmark WHERE item_id = 3))
SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS hits FROM i JOIN q USING (term) GROUP BY 1 ORDER BY terms DESC, hits DESC, doc_id LIMIT 25
""")
def index_search(spark, d):
    """A query's terms joined with an inverted index."""
    q = load(spark, d, "benchmark").where("item_id = 3").select(F.explode(F.array_distinct(s.tokens(F.col("text")))).alias("term")).distinct()
    hits = s.postings(load(spark, d, "documents"), "doc_id", "text", q).groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("hits"))
    return hits.orderBy(F.desc("terms"), F.desc("hits"), "doc_id").limit(25)


@query(m.SQL + """
SELECT kind, id, label, rank FROM (SELECT 'entity' AS kind, id, name AS label, round(balance / 10000, 6) AS rank FROM entities WHERE lower(name) LIKE '%00000001%'
UNION ALL SELECT 'listing', p_partkey, p_name, round(p_retailprice / 100000, 6) FROM part WHERE lower(p_name) LIKE '%widget%') ORDER BY rank DESC, kind, id LIMIT 30
""")
def union_search(spark, d):
    """Hits of two kinds ranked together."""
    e = m.entities(spark, d).where(F.lower("name").contains("00000001")).select(F.lit("entity").alias("kind"), "id", F.col("name").alias("label"), F.round(F.col("balance") / 10000, 6).alias("rank"))
    p = load(spark, d, "part").where(F.lower("p_name").contains("widget")).select(F.lit("listing").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.round(F.col("p_retailprice") / 100000, 6).alias("rank"))
    return e.unionByName(p).orderBy(F.desc("rank"), "kind", "id").limit(30)


@query()
def headlines(spark, d):
    """A fragment of up to 30 words around the first hit."""
    hit = load(spark, d, "documents").where(F.array_contains(s.tokens(F.col("text")), "thereth") | F.col("text").contains("there"))
    return hit.select("doc_id", s.headline("text", F.lit("there")).alias("fragment"))


_FORMS = "'^licens(e|es|ed|ing)$'"


@query(f"""
SELECT doc_id, list_min(places)::INT AS first, len(places) AS hits FROM (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: regexp_matches(w[i], {_FORMS})) AS places FROM {_WORDS})
WHERE len(places) > 0 AND len(list_filter(w, lambda x: regexp_matches(x, '^(permission|permissions)$'))) = 0
""")
def english_search(spark, d):
    """Texts with a word of the stem of licence and none of that of permission: where it stands first, and how often."""
    found = ft.search(load(spark, d, "documents"), ft.parse("licensing & !permissions"))
    at = F.col("places")[0]
    return found.select("doc_id", F.array_min(at).alias("first"), F.size(at).cast("long").alias("hits"))


@query()
def english_ranked(spark, d):
    """The best texts for a query with a phrase, with their rank and headline."""
    docs = load(spark, d, "documents")
    best = ft.search(docs, ft.parse("(licensed <-> under | copyright) & (version | rights:*)")).orderBy(F.desc("rank"), "doc_id").limit(50)
    best = stored(best, "best")
    return ft.headlines(docs, best).select("doc_id", F.round("rank", 6).alias("rank"), "fragment")
