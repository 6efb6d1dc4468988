"""Queries over records: registries, imports, canonical texts, signatures, exports, histories, readmes, links."""

import uuid

from pyspark.sql import functions as F

from weftline.functions.canonical import canonical_json, hmac_sha256, uuid5
from weftline.functions.exprs import luhn_valid
from weftline.operators import records as r
from weftline.operators import scanner as sc
from weftline.operators import search as s
from weftline.operators import style as st
from weftline.operators.baseline import behaviour
from weftline.plans import model as m
from weftline.plans.registry import load, query
from weftline.plans.texts import _LINES
from weftline.sources.folders import shared_folder
from weftline.sources.registries import COUNTS, FIELDS, normalise, read_surfaces
from weftline.sources.sinks import backoff_seconds, export, subject_data, write_history

n_rows = lambda name="n": F.count(F.lit(1)).alias(name)
_q = lambda t: "'" + t.replace("'", "''") + "'"


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Captured responses: each part in the format of one registry by turns, the last a profile page.
_REGISTRIES = [*FIELDS, "profile"]
_VALUES = {"name": "p_name", "description": "p_type", "stars": "p_size", "forks": "p_partkey % 17", "likes": "p_partkey % 23", "downloads": "p_partkey * 31"}


def _body_parts(registry):
    """A response as a list of SQL terms: JSON nested along the registry's paths, or a page."""
    if registry == "profile":
        return [_q('<html><head><title> x </title><meta property="og:title" content="'), "p_name", _q('"/><meta name="og:description" content="'), "p_brand", _q('"/></head></html>')]
    tree = {}
    for field, path in FIELDS[registry].items():
        *heads, last = path.removeprefix("$.").split(".")
        node = tree
        for h in heads:
            node = node.setdefault(h, {})
        node[last] = field

    def terms(node):
        out, sep = [_q("{")], ""
        for key, v in node.items():
            out.append(_q(f'{sep}"{key}":'))
            out += terms(v) if isinstance(v, dict) else [_q('"'), _VALUES[v], _q('"')] if v in ("name", "description") else [f"CAST({_VALUES[v]} AS STRING)"]
            sep = ","
        return [*out, _q("}")]

    return terms(tree)


_BODY = "CASE p_partkey % {} {} END".format(len(_REGISTRIES), " ".join(f"WHEN {i} THEN concat({', '.join(_body_parts(g))})" for i, g in enumerate(_REGISTRIES)))


def _field(field):
    whens = [f"WHEN {i} THEN {_VALUES[field]}" for i, g in enumerate(_REGISTRIES) if field in FIELDS.get(g, ()) or (g == "profile" and field == "name")]
    whens += [f"WHEN {i} THEN p_brand" for i, g in enumerate(_REGISTRIES) if g == "profile" and field == "description"]
    if field == "description":
        whens += [f"WHEN {i} THEN NULL" for i, g in enumerate(_REGISTRIES) if g in FIELDS and field not in FIELDS[g]]
    return f"CASE p_partkey % {len(_REGISTRIES)} {' '.join(whens)} END"


@query(f"SELECT [{', '.join(map(_q, _REGISTRIES))}][p_partkey % {len(_REGISTRIES)} + 1] AS registry, {', '.join(f'{_field(f)} AS {f}' for f in ('name', 'description'))}, {', '.join(f'({_field(f)})::BIGINT AS {f}' for f in COUNTS)} FROM part")
def registry_records(spark, d):
    """Responses in the formats of all registries, and profile pages, as one record type."""
    p = load(spark, d, "part")
    registry = F.try_element_at(F.array(*map(F.lit, _REGISTRIES)), (F.col("p_partkey") % len(_REGISTRIES) + 1).cast("int"))
    return normalise(p.select(registry.alias("registry"), F.expr(_BODY).alias("body")))


@query("SELECT 'nations' AS surface, n_nationkey::BIGINT AS key, n_name AS name, NULL::BIGINT AS suppliers FROM nation UNION ALL SELECT 'regions', r_regionkey, NULL, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) FROM region")
def surface_results(spark, d):
    """Result files of two surfaces, each with its own fields, read as one table; the files are lists of 25 and 5 rows."""
    nation = load(spark, d, "nation")
    parts = {
        "nations": nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")),
        "regions": load(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey")).join(nation, "n_regionkey", "left").groupBy(F.col("n_regionkey").alias("key")).agg(F.count("n_nationkey").alias("suppliers")),
    }
    files = {}
    for name, rows in parts.items():
        files[name] = _folder(spark, f"surface-{name}")
        rows.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("results"))).alias("value")).write.text(files[name])
    return read_surfaces(spark, files).select("surface", "key", "name", "suppliers")


@query("""SELECT p_partkey, '{"a":{"price":' || regexp_replace(p_retailprice::VARCHAR, '\\.0$', '') || ',"size":' || p_size || '},"b":[1,"' || p_name || '",null,true],"z":"' || p_brand || '"}' AS canonical FROM part""")
def canonical_records(spark, d):
    """JSON with unsorted keys, spaces and long numbers in its canonical form."""
    text = F.concat(F.lit('{ "z":"'), "p_brand", F.lit('", "b": [1.0, "'), "p_name", F.lit('", null, true], "a" : {"size": '), F.col("p_size").cast("string"), F.lit('.00, "price":'), F.col("p_retailprice").cast("string"), F.lit("0}}"))
    return load(spark, d, "part").select("p_partkey", canonical_json(text).alias("canonical"))


_KEY = "delivery-key"
_pad = lambda x: bytes(b ^ x for b in _KEY.encode().ljust(64, b"\0")).hex()


@query(f"SELECT o_orderkey, sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode('order.' || o_orderkey || '.' || o_orderstatus)))) AS signature FROM orders")
def signed_payloads(spark, d):
    """Payloads signed by a keyed hash."""
    payload = F.concat(F.lit("order."), F.col("o_orderkey").cast("string"), F.lit("."), "o_orderstatus")
    return load(spark, d, "orders").select("o_orderkey", hmac_sha256(payload, F.lit(_KEY)).alias("signature"))


_BASE = "https://profiles.example/"
_UUID5 = lambda name: f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', strpos('0123456789abcdef', substr(h, 17, 1)) % 4 + CASE WHEN strpos('0123456789abcdef', substr(h, 17, 1)) % 4 = 0 THEN 4 ELSE 0 END, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT sha1(unhex('{uuid.NAMESPACE_URL.hex}') || encode({name})) AS h))"


@query(f"""
SELECT {_UUID5(f"'{_BASE}' || CASE WHEN c_custkey % 4 = 1 THEN 'u' || c_custkey ELSE 'c' || c_custkey END")} AS id, CASE WHEN c_custkey % 4 < 2 THEN 'u' || c_custkey ELSE '' END AS username,
 CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'u' || c_custkey WHEN 2 THEN substr(repeat(c_mktsegment, 20), 1, 100) ELSE 'Unknown' END AS display_name, CASE c_custkey % 4 WHEN 0 THEN 'from ' || c_mktsegment ELSE '' END AS bio,
 '{_BASE}' || CASE WHEN c_custkey % 4 < 2 THEN 'u' || c_custkey ELSE '' END AS source_url
FROM customer WHERE c_custkey % 4 <> 3 AND c_custkey % 10 <> 2 UNION ALL
SELECT {_UUID5(f"'{_BASE}' || 'c' || c_custkey")}, '', 'Unknown', '', 'https://own.example/' || c_custkey FROM customer WHERE c_custkey % 8 = 3 AND c_custkey % 10 <> 2
""")
def imported_profiles(spark, d):
    """Profiles of several shapes, one of each imported twice, as records with derived ids; those that are known are left out."""
    c, k = load(spark, d, "customer"), F.col("c_custkey").cast("string")
    u, own = F.concat(F.lit("u"), k), F.concat(F.lit("c"), k)
    shapes = F.to_json(
        F.when(F.col("c_custkey") % 4 == 0, F.struct(own.alias("id"), u.alias("username"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("display_name"), F.concat(F.lit("from "), "c_mktsegment").alias("description"), F.lit("").alias("url")))
        .when(F.col("c_custkey") % 4 == 1, F.struct(F.lit("").alias("id"), u.alias("username"), F.lit("").alias("name"), F.lit("").alias("display_name"), F.lit("").alias("description"), F.lit("").alias("url")))
        .when(F.col("c_custkey") % 4 == 2, F.struct(own.alias("id"), F.lit(None).cast("string").alias("username"), F.lit("x").alias("name"), F.repeat("c_mktsegment", F.lit(20)).alias("display_name"), F.lit("").alias("description"), F.lit("").alias("url")))
        .when(F.col("c_custkey") % 8 == 3, F.struct(own.alias("id"), F.lit("").alias("username"), F.lit("").alias("name"), F.lit("").alias("display_name"), F.lit("").alias("description"), F.concat(F.lit("https://own.example/"), k).alias("url")))
        .otherwise(F.struct(F.lit("").alias("id"), F.lit("").alias("username"), F.lit("nobody").alias("name"), F.lit("").alias("display_name"), F.lit("").alias("description"), F.lit("").alias("url")))
    )
    raw = c.select(shapes.alias("json"))
    name = F.concat(F.lit(_BASE), F.when(F.col("c_custkey") % 4 == 1, u).otherwise(own))
    known = c.where("c_custkey % 10 = 2").select(uuid5(name).alias("id"))
    return r.profiles(raw.unionByName(raw), known, _BASE)


@query("""
SELECT o_orderkey, (list_sum(list_transform(range(16), lambda i: CASE WHEN i % 2 = 0 THEN digits[16 - i]::INT WHEN digits[16 - i]::INT > 4 THEN digits[16 - i]::INT * 2 - 9 ELSE digits[16 - i]::INT * 2 END)) % 10 = 0) AS valid
FROM (SELECT o_orderkey, lpad((o_orderkey * 7919 + 4111111111111)::VARCHAR, 16, '4') AS digits FROM orders)
""")
def card_numbers(spark, d):
    """Digit strings with a valid checksum."""
    digits = F.lpad((F.col("o_orderkey") * 7919 + 4111111111111).cast("string"), 16, "4")
    return load(spark, d, "orders").select("o_orderkey", luhn_valid(digits).alias("valid"))


@query("""
SELECT '[' || coalesce((SELECT string_agg('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}', ',') FROM customer WHERE c_custkey = 7), '') || ']' AS entity,
 '[' || coalesce((SELECT string_agg(j, ',' ORDER BY j) FROM (SELECT '{"c_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS j FROM orders WHERE o_custkey = 7)), '') || ']' AS orders
""")
def subject_export(spark, d):
    """All rows of one subject in two tables, as one nested record."""
    tables = {"entity": load(spark, d, "customer").select("c_custkey", "c_mktsegment"), "orders": load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")}
    return subject_data("c_custkey", tables, 7)


@query("SELECT '2024-01-01' AS as_of, c_nationkey, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT '2024-01-02', c_nationkey, count(*) FROM customer WHERE c_acctbal > 0 GROUP BY 2")
def snapshot_history(spark, d):
    """Snapshots by date; the second date is written twice and holds the later rows alone."""
    path, c = _folder(spark, "history"), load(spark, d, "customer")
    for day, rows in (("2024-01-01", c), ("2024-01-02", c), ("2024-01-02", c.where("c_acctbal > 0"))):
        write_history(rows.groupBy("c_nationkey").agg(n_rows()), path, day)
    return spark.read.parquet(path).select(F.col("as_of").cast("string").alias("as_of"), "c_nationkey", "n")


@query("SELECT kind, p_partkey, p_name, '[' || '\"' || p_brand || '\",\"' || p_type || '\"]' AS tags FROM part, (VALUES ('csv'), ('json')) k(kind)")
def exported_rows(spark, d):
    """Rows with a nested column, exported as CSV and as JSON lines and read again."""
    p, out = load(spark, d, "part").select("p_partkey", "p_name", F.array("p_brand", "p_type").alias("tags")), None
    for kind in ("csv", "json"):
        path = _folder(spark, kind)
        export(p, path, kind)
        if kind == "csv":
            back = spark.read.option("header", True).option("escape", "\\").schema("p_partkey long, p_name string, tags string").csv(path)
        else:
            back = spark.read.schema(p.schema).json(path).withColumn("tags", F.to_json("tags"))
        back = back.select(F.lit(kind).alias("kind"), "p_partkey", "p_name", "tags")
        out = back if out is None else out.unionByName(back)
    return out


@query("SELECT l_orderkey, max(l_linenumber) AS attempts, max(least(power(2.0, l_linenumber), 60.0))::DOUBLE AS longest, sum(least(power(2.0, l_linenumber), 60.0))::DOUBLE AS waited FROM lineitem GROUP BY 1")
def retry_delays(spark, d):
    """Attempts of each delivery, with the longest delay before a retry and all delays."""
    delay = backoff_seconds(F.col("l_linenumber"))
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("attempts"), F.max(delay).alias("longest"), F.sum(delay).alias("waited"))


_README = r"""concat('# ', p_name, '\n\n', CASE WHEN p_partkey % 3 = 0 THEN '![badge](x)\n[![ci](y)\n' ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('A ', p_type, '  \n  by ', p_brand, CASE p_partkey % 2 WHEN 0 THEN '\n## Next' ELSE '\n' END, '\n\n') END, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '## Features\n' WHEN 2 THEN '## WHAT IT DOES \n\n' ELSE '##Capabilities\n' END, '- ', p_brand, '\ntext\n * ', p_type, '\n-- no\n- \n', repeat('- more\n', p_size % 13), '\n## Other\n- not this')"""
_README_SQL = _README.replace("\\n", "' || chr(10) || '")


@query(rf"""
WITH t AS (SELECT p_partkey, {_README_SQL} AS text FROM part),
cap AS (SELECT p_partkey, list_filter(list_transform(list_filter(list_transform(string_split(regexp_extract(text, '(?is)##\s*(?:features|capabilities|what it does)\s*\n(.*?)(?:\n##|$)', 1), chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^[-*] ')), lambda x: regexp_replace(x, '^[-* ]+', '')), lambda x: x <> '') AS c FROM t),
l AS (SELECT p_partkey, trim(unnest(string_split(text, chr(10)))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t), f AS (SELECT *, x <> '' AND NOT regexp_matches(x, '^(#|!\[|\[!)') AS prose FROM l),
b AS (SELECT p_partkey, min(i) FILTER (WHERE prose) AS b FROM f GROUP BY 1), e AS (SELECT p_partkey, b, min(i) FILTER (WHERE NOT prose AND i > b) AS e FROM f JOIN b USING (p_partkey) GROUP BY 1, 2),
para AS (SELECT p_partkey, string_agg(x, ' ' ORDER BY i) AS paragraph FROM f JOIN e USING (p_partkey) WHERE i >= b AND (e IS NULL OR i < e) GROUP BY 1)
SELECT p_partkey, array_to_string(list_slice(c, 1, 10), '|') AS capabilities, coalesce(substr(paragraph, 1, 500), '') AS paragraph FROM cap LEFT JOIN para USING (p_partkey)
""")
def readme_facts(spark, d):
    """Capabilities and first paragraph of readmes."""
    t = load(spark, d, "part").select("p_partkey", F.expr(_README).alias("text"))
    return t.select("p_partkey", F.array_join(r.capabilities(F.col("text")), "|").alias("capabilities"), r.first_paragraph(F.col("text")).alias("paragraph"))


_DEPENDENCIES = ("requests==2", "LangChain>=0.1 openai", "openai", '"@modelcontextprotocol/sdk"', "anthropic mcp", "crewai autogen", "Anthropic", "")


@query(f"SELECT framework, count(*) AS n FROM (SELECT CASE {' '.join(f'WHEN contains(t, {_q(p)}) THEN {_q(n)}' for p, n in r.FRAMEWORKS)} END AS framework FROM (SELECT lower([{', '.join(map(_q, _DEPENDENCIES))}][p_partkey % {len(_DEPENDENCIES)} + 1]) AS t FROM part)) GROUP BY 1")
def framework_adoption(spark, d):
    """Projects by the framework that their dependencies name."""
    t = F.try_element_at(F.array(*map(F.lit, _DEPENDENCIES)), (F.col("p_partkey") % len(_DEPENDENCIES) + 1).cast("int"))
    return load(spark, d, "part").groupBy(r.framework(t).alias("framework")).agg(n_rows())


def _id(key, mark):
    """SQL for a derived id in the form of a UUID; engines mark groups by different signs."""
    return f"regexp_replace(md5(CAST({key} AS STRING)), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.*)$', '{'-'.join(mark + n for n in '12345')}')"


_POST = "concat(text, ' see @nation_', CAST(doc_id % 30 AS STRING), ', @Nation_', CAST(doc_id % 7 AS STRING), ' and ', {a}, ' or ', {b})"


@query(f"""
WITH p AS (SELECT doc_id AS id, doc_id % 25 AS author, lower({_POST.format(a=_id('doc_id // 3', chr(92)), b=_id('doc_id', chr(92)))}) AS text FROM documents),
m AS (SELECT DISTINCT id, author, unnest(regexp_extract_all(text, '@([\\p{{L}}\\p{{N}}_]+)', 1)) AS name FROM p), u AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, '\\b([0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}})\\b', 1)) AS uuid FROM p)
SELECT id, 'mentions' AS kind, n_nationkey::BIGINT AS target FROM m JOIN nation ON lower(n_name) = name AND n_nationkey <> author
UNION ALL SELECT id, 'references', doc_id FROM u JOIN documents ON uuid = {_id('doc_id', chr(92))} AND doc_id <> id
""")
def cross_links(spark, d):
    """Links from posts to the entities that they mention and the posts that they refer to."""
    docs = load(spark, d, "documents")
    text = F.expr(_POST.format(a=_id("doc_id div 3", "$"), b=_id("doc_id", "$")))
    posts = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 25).alias("author"), text.alias("text"))
    names = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("target"), F.col("n_name").alias("name"))
    return r.cross_links(posts, names, docs.select(F.col("doc_id").alias("target"), F.expr(_id("doc_id", "$")).alias("uuid")))


@query(_LINES + """
, pf AS (SELECT id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS warning, count(*) FILTER (WHERE severity NOT IN ('critical', 'high')) AS other FROM found GROUP BY 1),
s AS (SELECT source, lang, count(*) AS items, coalesce(sum(critical), 0)::BIGINT AS critical, coalesce(sum(warning), 0)::BIGINT AS warning, coalesce(sum(other), 0)::BIGINT AS other FROM documents LEFT JOIN pf ON id = doc_id GROUP BY 1, 2)
SELECT *, CASE WHEN critical + warning + other = 0 THEN 'clean' WHEN critical > 0 THEN 'critical' ELSE 'warnings' END AS severity,
 CASE WHEN critical + warning + other = 0 THEN 'All ' || items || ' items passed security scan' WHEN critical > 0 THEN critical || ' critical, ' || warning || ' warning vulnerabilities found across ' || items || ' items' ELSE (critical + warning + other) || ' warning(s) found across ' || items || ' items' END AS details FROM s
""")
def bridge_verdicts(spark, d):
    """A verdict in words over the scan of each source and language."""
    docs = load(spark, d, "documents")
    per = sc.findings(docs).groupBy(F.col("id").alias("doc_id")).agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("warning"), F.count_if(~F.col("severity").isin("critical", "high")).alias("other"))
    n = docs.select("doc_id", "source", "lang").join(per, "doc_id", "left").groupBy("source", "lang")
    return r.verdict(n.agg(n_rows("items"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("critical", "warning", "other"))))


@query("SELECT c_nationkey, n_name, count(*) AS members FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name ILIKE '%n\\_1%' ESCAPE '\\' GROUP BY 1, 2 ORDER BY members DESC, c_nationkey LIMIT 20")
def community_search(spark, d):
    """Communities whose name has a text in either case, those with most members first: members are counted before the join."""
    members = load(spark, d, "customer").groupBy("c_nationkey").agg(n_rows("members"))
    named = load(spark, d, "nation").where(F.lower("n_name").contains("n_1")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return members.join(named, "c_nationkey").select("c_nationkey", "n_name", "members").orderBy(F.desc("members"), "c_nationkey").limit(20)


@query("SELECT 'q' AS term, doc_id FROM documents WHERE contains(lower(text), 'q') UNION ALL SELECT 'the', doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '([^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+)', 1), 'the')")
def short_query_search(spark, d):
    """A query of one character matches anywhere, longer ones match whole words."""
    docs, out = load(spark, d, "documents"), None
    for term in ("q", "the"):
        hit = docs.where(F.lower("text").contains(term) if len(term) < 2 else s.text_has(F.col("text"), [term])).select(F.lit(term).alias("term"), "doc_id")
        out = hit if out is None else out.unionByName(hit)
    return out


_DRAFTS = (
    "We delve into it.", "It's worth noting that this is so.", "It is not just fast, but also small.", "They ship early, ensuring a good day.", "So it is. Moreover, it rains.",
    "She plays an odd role.", "Ever wondered why?", "a -- b -- c -- d — e -- f -- g -- h", "It serves as one, boasts two and embodies three.", "Plain words.", "   ", "An ever-evolving field",
)
_HARD = {"blocklist_word": f"regexp_matches(t, {_q('(?i)' + chr(92) + 'b(' + '|'.join(st.WORDS) + ')' + chr(92) + 'b')})", "blocklist_phrase": " OR ".join(f"contains(low, {_q(p)})" for p in st.PHRASES), **{n: " OR ".join(f"regexp_matches(t, {_q(p)})" for p in ps) for n, ps in st.PATTERNS.items()}}
_SOFT = {
    "high_em_dash_density": f"len(regexp_extract_all(t, {_q(st.DASHES)})) * 500 > length(t) * {st.MOST_DASHES}",
    "no_short_sentence": "len(parts) >= 3 AND len(list_filter(parts, lambda x: len(regexp_split_to_array(x, '\\s+')) <= 7)) = 0",
    "high_copula_avoidance": " + ".join(f"(length(low) - length(replace(low, {_q(c)}, ''))) / {len(c)}" for c in st.COPULAS) + " > 2",
}
_names = lambda rules: f"list_filter([{', '.join(f'CASE WHEN {c} THEN {_q(n)} END' for n, c in rules.items())}], lambda x: x IS NOT NULL)"


@query(rf"""
WITH d AS (SELECT doc_id, {'['}{', '.join(map(_q, _DRAFTS))}][doc_id % {len(_DRAFTS)} + 1] || chr(10) || CASE WHEN doc_id % {len(_DRAFTS)} = 10 THEN '' ELSE text END AS t FROM documents),
p AS (SELECT *, lower(t) AS low, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM d),
h AS (SELECT doc_id, CASE WHEN regexp_matches(t, '\S') THEN {_names(_HARD)} ELSE [] END AS hard, CASE WHEN regexp_matches(t, '\S') THEN {_names(_SOFT)} ELSE [] END AS soft FROM p)
SELECT doc_id, array_to_string(hard || soft, ',') AS reasons, CASE WHEN len(hard) > 0 THEN 'block' WHEN len(soft) > 0 THEN 'warn' ELSE 'ok' END AS severity FROM h
""")
def style_verdicts(spark, d):
    """Drafts with the rules of style that they break."""
    k = F.col("doc_id") % len(_DRAFTS)
    draft = F.concat(F.try_element_at(F.array(*map(F.lit, _DRAFTS)), (k + 1).cast("int")), F.lit("\n"), F.when(k == 10, "").otherwise(F.col("text")))
    return st.check(load(spark, d, "documents").select("doc_id", draft.alias("text"))).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "severity")


@query(m.SQL + """
, w AS (SELECT ev.* FROM ev, clock WHERE us > now - 7 * 86400000000),
acts AS (SELECT user_id AS id, CASE event_type WHEN 'purchase' THEN 'post' WHEN 'view' THEN 'vote' WHEN 'click' THEN 'follow' WHEN 'signup' THEN 'attested' ELSE 'change' END AS kind, floor(value) AS length, event_id % 3 = 0 AS reply FROM w UNION ALL SELECT k, 'received', NULL, false FROM w WHERE event_type = 'signup'),
n AS (SELECT id, count(*) FILTER (WHERE kind = 'post') AS posts, count(*) FILTER (WHERE kind = 'vote') AS votes, count(*) FILTER (WHERE kind = 'follow') AS follows, count(*) FILTER (WHERE kind = 'attested') AS given, count(*) FILTER (WHERE kind = 'received') AS received, count(*) FILTER (WHERE kind = 'change') AS changes,
 count(*) FILTER (WHERE kind = 'post' AND reply) AS replies, avg(length) FILTER (WHERE kind = 'post') AS length FROM acts GROUP BY 1),
pairs AS (SELECT id, partner, count(*) AS times FROM (SELECT user_id AS id, k AS partner FROM w UNION ALL SELECT k, user_id FROM w) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY times DESC, partner) AS place FROM pairs),
met AS (SELECT id, count(*) AS partners, string_agg(partner || ':' || times, ',' ORDER BY place) FILTER (WHERE place <= 5) AS best FROM ranked GROUP BY 1)
SELECT id, round(coalesce(posts, 0) / 7.0::DOUBLE, 2) AS posts_per_day, round(coalesce(votes, 0) / 7.0::DOUBLE, 2) AS votes_per_day, round(coalesce(follows, 0) / 7.0::DOUBLE, 2) AS follows_per_day, coalesce(given, 0) AS attestations_given, coalesce(received, 0) AS attestations_received,
 round(coalesce(length, 0.0::DOUBLE), 1) AS avg_post_length, round(coalesce(replies / nullif(posts, 0)::DOUBLE, 0.0::DOUBLE), 4) AS reply_ratio, coalesce(partners, 0) AS unique_partners, coalesce(best, '') AS top_partners, coalesce(changes, 0) AS capability_changes, 0.0::DOUBLE AS trust_score_delta, round(c_acctbal / 10000, 4)::DOUBLE AS trust_score
FROM n FULL JOIN met USING (id) LEFT JOIN customer ON c_custkey = id
""")
def behaviour_vectors(spark, d):
    """Twelve metrics of each entity over the last week."""
    w = m.events(spark, d).crossJoin(F.broadcast(m.now(spark, d))).where("us > now - 7 * 86400000000")
    kind = F.when(F.col("event_type") == "purchase", "post").when(F.col("event_type") == "view", "vote").when(F.col("event_type") == "click", "follow").when(F.col("event_type") == "signup", "attested").otherwise("change")
    acts = w.select(F.col("user_id").alias("id"), kind.alias("kind"), F.floor("value").alias("length"), (F.col("event_id") % 3 == 0).alias("reply"))
    received = w.where("event_type = 'signup'").select(F.col("k").alias("id"), F.lit("received").alias("kind"), F.lit(None).cast("long").alias("length"), F.lit(False).alias("reply"))
    scores = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10000).alias("score"))
    return behaviour(acts.unionByName(received), w.select(F.col("user_id").alias("a"), F.col("k").alias("b")), scores, 7)


@query("""
WITH f AS (SELECT o_orderstatus AS status, o_orderpriority AS reason, ['post', 'entity', 'listing'][o_custkey % 3 + 1] AS target FROM orders)
SELECT 'status' AS breakdown, status AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'reason', reason, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'target', target, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*) FROM f
""")
def moderation_breakdown(spark, d):
    """Cases by status, by reason, by kind of target and in all, in one pass of grouping sets."""
    target = F.try_element_at(F.array(F.lit("post"), F.lit("entity"), F.lit("listing")), (F.col("o_custkey") % 3 + 1).cast("int"))
    f = load(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("reason"), target.alias("target"))
    sets = f.groupingSets([[f.status], [f.reason], [f.target], []], "status", "reason", "target").agg(n_rows(), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 3, "status").when(F.col("g") == 5, "reason").when(F.col("g") == 6, "target").otherwise("total")
    return sets.select(name.alias("breakdown"), F.coalesce("status", "reason", "target").alias("value"), "n")
