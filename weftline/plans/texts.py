"""Text queries: rule scanning, scores, filters, extraction, digests."""

from pyspark.sql import functions as F

from weftline.functions.exprs import redact
from weftline.operators import scanner as sc
from weftline.operators.tables import latest
from weftline.plans.registry import load, query

_LINES = """
WITH l AS (SELECT doc_id AS id, source, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
k AS (SELECT * FROM l WHERE NOT regexp_matches(content, '^\\s*#') AND NOT contains(content, 'scan: ignore')),
f AS (SELECT id, line, 'secret' AS category, CASE WHEN regexp_matches(content, 'AKIA[A-Z0-9]{16}') THEN 'critical' WHEN regexp_matches(content, '(?i)(password|token|secret)\\s*[:=]') THEN 'high' END AS severity FROM k
UNION ALL SELECT id, line, 'unsafe_exec', CASE WHEN regexp_matches(content, '(?i)\\b(eval|exec|system)\\s*\\(') THEN 'high' END FROM k
UNION ALL SELECT id, line, 'exfiltration', CASE WHEN regexp_matches(content, 'https?://') THEN 'medium' END FROM k
UNION ALL SELECT id, line, 'obfuscation', CASE WHEN regexp_matches(content, '[A-Za-z0-9+/]{80,}') THEN 'medium' END FROM k
UNION ALL SELECT id, line, 'fs_access', CASE WHEN regexp_matches(content, '(?i)\\bopen\\(') THEN 'low' END FROM k),
found AS (SELECT * FROM f WHERE severity IS NOT NULL)
"""


@query(_LINES + "SELECT id, line, category, severity FROM found")
def line_findings(spark, d):
    return sc.findings(load(spark, d, "documents"))


@query(_LINES + """
, pf AS (SELECT id, count(*) FILTER (WHERE severity = 'critical') AS c, count(*) FILTER (WHERE severity = 'high') AS h, count(*) FILTER (WHERE severity = 'medium') AS m FROM found GROUP BY 1),
s AS (SELECT source, count(*) AS files, count(c) AS affected, sum(coalesce(c, 0))::BIGINT AS c, sum(coalesce(h, 0))::BIGINT AS h, sum(coalesce(m, 0))::BIGINT AS m FROM documents LEFT JOIN pf ON id = doc_id GROUP BY 1)
SELECT source, files, affected, greatest(0, least(100, CASE WHEN c + h + m = 0 THEN 80 ELSE 70 - floor((c * 15 + h * 8 + m * 3) * least(1.0, 0.4 + affected / files::DOUBLE * 2.4)) END))::BIGINT AS score FROM s
""")
def scan_score(spark, d):
    docs = load(spark, d, "documents")
    return sc.scan_score(sc.findings(docs), docs.select(F.col("doc_id").alias("id"), "source"))


@query(_LINES + "SELECT id, category, greatest(0, 100 - sum(CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 3 END))::BIGINT AS score FROM found GROUP BY ALL")
def category_scores(spark, d):
    return sc.category_scores(sc.findings(load(spark, d, "documents")))


@query("""
WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), k AS (SELECT * FROM l WHERE NOT regexp_matches(content, '^\\s*#') AND NOT contains(content, 'scan: ignore'))
SELECT a.id, min(abs(a.line - b.line)) AS distance FROM k a JOIN k b ON a.id = b.id WHERE regexp_matches(a.content, '[Ll]icensed under') AND regexp_matches(b.content, 'tion') AND abs(a.line - b.line) <= 40 GROUP BY 1
""")
def proximity_40(spark, d):
    """Files in which lines of two kinds stand within 40 lines of each other."""
    rules = (("licence", "low", "[Ll]icensed under"), ("common", "low", "tion"))
    return sc.near_lines(sc.findings(load(spark, d, "documents"), rules=rules), "licence", "common", 40)


@query(r"""
WITH t AS (SELECT doc_id, text, regexp_matches(text, '(?i)(buy|sell|cheap|discount|free money).{0,20}(click|visit|http)|(earn|make)\s+\$\d+|(viagra|cialis|pharmacy|crypto\s*airdrop)|(bit\.ly|tinyurl|t\.co|shorturl)[\s/]|(subscribe|follow)\s+(my|our)\s+(channel|page)') AS spam,
regexp_matches(text, '[A-Z]{20,}|a{10}|b{10}|c{10}|d{10}|e{10}|f{10}|g{10}|h{10}|i{10}|j{10}|k{10}|l{10}|m{10}|n{10}|o{10}|p{10}|q{10}|r{10}|s{10}|t{10}|u{10}|v{10}|w{10}|x{10}|y{10}|z{10}|0{10}|1{10}|2{10}|3{10}|4{10}|5{10}|6{10}|7{10}|8{10}|9{10}|-{10}|={10}|\.{10}|\*{10}|#{10}|_{10}| {10}') AS noise,
regexp_matches(text, '(?i)ignore\s+(all\s+)?previous\s+instructions|you\s+are\s+now\s+(a|an)\s+|system\s*:\s*|<\|?(system|assistant|user)\|?>') AS injection,
len(regexp_extract_all(text, 'https?://')) > CASE WHEN length(text) < 2000 THEN 3 ELSE 15 END AS links FROM documents)
SELECT doc_id, spam, noise, injection, links FROM t
""")
def content_filter(spark, d):
    """Flags of the content filter; personal data has its own query."""
    f = sc.content_filter(F.col("text"))
    return load(spark, d, "documents").select("doc_id", *(f[k].alias(k) for k in ("spam", "noise", "injection", "links")))


@query()
def content_scores(spark, d):
    """Score and verdict of the content filter, card numbers checked."""
    f = sc.content_filter(F.col("text"))
    return load(spark, d, "documents").select("doc_id", f["pii"].alias("pii"), f["score"].alias("score"), f["clean"].alias("clean"))


@query("SELECT page_id, len(regexp_extract_all(html, 'href=')) AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]*)\"', 1) AS lang FROM pages")
def title_extract(spark, d):
    """Link counts and meta data by patterns."""
    return load(spark, d, "pages").select("page_id", F.regexp_count("html", F.lit("href=")).cast("long").alias("links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("lang"))


@query("""
WITH b AS (SELECT source, doc_id % 1024 AS part, sha256(string_agg(doc_id::VARCHAR || '=' || sha256(text), chr(10) ORDER BY doc_id::VARCHAR || '=' || sha256(text))) AS digest FROM documents GROUP BY 1, 2)
SELECT source, sha256(string_agg(part::VARCHAR || '=' || digest, chr(10) ORDER BY part::VARCHAR || '=' || digest)) AS digest FROM b GROUP BY 1
""")
def manifest_digest(spark, d):
    """One digest of a source from those of 1024 parts, each from the sorted digests of its files: no group holds a source."""
    digest = lambda k, v: F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(k.cast("string"), F.lit("="), v))), "\n"), 256).alias("digest")
    parts = load(spark, d, "documents").groupBy("source", (F.col("doc_id") % 1024).alias("part")).agg(digest(F.col("doc_id"), F.sha2("text", 256)))
    return parts.groupBy("source").agg(digest(F.col("part"), F.col("digest")))


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '—')) AS dashes, len(regexp_extract_all(text, '!')) AS exclaims, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s) <> '' AND len(string_split(trim(s), ' ')) <= 7)) AS short_sentences FROM documents
""")
def style_tells(spark, d):
    """Counts behind a style check: dashes, exclamation marks, sentences of seven words or fewer."""
    short = F.filter(F.split("text", "[.!?]+"), lambda s: (F.trim(s) != "") & (F.size(F.split(F.trim(s), " ")) <= 7))
    return load(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("—")).cast("long").alias("dashes"), F.regexp_count("text", F.lit("!")).cast("long").alias("exclaims"), F.size(short).cast("long").alias("short_sentences"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(regexp_replace(substr(text, 1, 80), '[^A-Za-z0-9]+', ' ', 'g')) ORDER BY doc_id) AS p FROM documents) WHERE p = 1")
def dedup_title(spark, d):
    """The first document of each normalised 80-character opening."""
    key = F.lower(F.regexp_replace(F.substring("text", 1, 80), "[^A-Za-z0-9]+", " "))
    return latest(load(spark, d, "documents").select("doc_id", key.alias("key")), ["key"], [F.col("doc_id")]).select("doc_id")


@query(r"SELECT doc_id, CASE WHEN length(s) <= 8 THEN '****' ELSE left(s, 4) || '...' || right(s, 4) END AS shown FROM (SELECT doc_id, regexp_extract(text, '(AKIA[A-Z0-9]{16}|[0-9a-f]{40})', 1) AS s FROM documents) WHERE s <> ''")
def redacted_secrets(spark, d):
    t = load(spark, d, "documents").select("doc_id", F.regexp_extract("text", "(AKIA[A-Z0-9]{16}|[0-9a-f]{40})", 1).alias("s")).where("s <> ''")
    return t.select("doc_id", redact(F.col("s")).alias("shown"))


@query("SELECT doc_id, quality, toxic, CASE WHEN toxic = 1 AND quality = 0 THEN 'block' WHEN toxic = 1 THEN 'flag' ELSE 'pass' END AS decision FROM labels")
def moderation_threshold(spark, d):
    return load(spark, d, "labels").select("doc_id", "quality", "toxic", F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "block").when(F.col("toxic") == 1, "flag").otherwise("pass").alias("decision"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g') AS text FROM pages")
def strip_html(spark, d):
    """Markup removed by patterns; references stay as they are."""
    t = F.regexp_replace("html", r"<(script|style)[^>]*>[^<]*</(script|style)>", " ")
    return load(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"\s+", " ").alias("text"))
