"""Facts of texts and profiles: readme sections, frameworks, mentions and cross-links, import records, verdicts over scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.canonical import uuid5
from weftline.functions.exprs import bound

# Parts of dependency files that name a framework, the first that occurs counts.
FRAMEWORKS = (
    ("langchain", "langchain"),
    ("crewai", "crewai"),
    ("autogen", "autogen"),
    ("@modelcontextprotocol", "mcp"),
    ("mcp", "mcp"),
    ("anthropic", "anthropic"),
    ("openai", "native"),
)
#: Headings whose list items are capabilities, and the most that are kept of one readme.
CAPABILITY_SECTION = r"(?is)##\s*(?:features|capabilities|what it does)\s*\n(.*?)(?:\n##|\z)"
MOST_CAPABILITIES = 10
#: Letters and digits of any script.
MENTION = r"@([\p{L}\p{N}_]+)"
UUID = r"\b([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\b"


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\r?\n"), lambda s: F.btrim(s, F.lit(" \t\n\x0b\f\r")))


def capabilities(readme: Column) -> Column:
    """List items under the first capability heading, without their marks; empty where there is none or the text is null."""
    section = F.regexp_extract(F.coalesce(readme, F.lit("")), CAPABILITY_SECTION, 1)
    items = F.filter(_lines(section), lambda s: s.rlike("^[-*•] "))
    names = F.transform(items, lambda s: F.regexp_replace(s, "^[-*• ]+", ""))
    return F.slice(F.filter(names, lambda s: s != ""), 1, MOST_CAPABILITIES)


def first_paragraph(readme: Column, most: int = 500) -> Column:
    """The first run of lines that are neither blank, headings nor badges, as one line of at most ``most`` characters."""

    def of(lines: Column, prose: Column) -> Column:
        begin = F.greatest(F.array_position(prose, True).cast("int"), F.lit(1))
        rest = F.slice(prose, begin, F.size(prose))
        stop = F.array_position(rest, False).cast("int")
        length = F.when(stop == 0, F.size(rest)).otherwise(stop - 1)  # 0 where no line is prose
        return F.substring(F.array_join(F.slice(lines, begin, length), " "), 1, most)

    plain = lambda s: (s != "") & ~(s.startswith("#") | s.startswith("![") | s.startswith("[!"))
    return bound(_lines(F.coalesce(readme, F.lit(""))), lambda lines: bound(F.transform(lines, plain), lambda prose: of(lines, prose)))


def framework(dependencies: Column) -> Column:
    """The framework that a dependency file names; null where it names none."""
    low = F.lower(dependencies)
    return F.coalesce(*(F.when(low.contains(part), F.lit(name)) for part, name in FRAMEWORKS))


def cross_links(posts: DataFrame, names: DataFrame, items: DataFrame) -> DataFrame:
    """(id, kind, target) once each: mentions of ``names(target, name)`` in either case, references to ``items(target, uuid)``.

    ``posts(id, author, text)``; no link to a post's author by name nor to the post itself. Of entities that share a name
    the least is meant, so a hot name makes one row a post. Mentions and references are made distinct before the joins.
    """
    by_name = names.groupBy(F.lower("name").alias("name")).agg(F.min("target").alias("least"))
    second = names.select(F.lower("name").alias("name"), "target").join(by_name, "name").where("target <> least").groupBy("name").agg(F.min("target").alias("next"))
    known = by_name.join(second, "name", "left")
    said = posts.select("id", "author", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(MENTION), 1))).alias("name"))
    hit = said.join(known, "name").select("id", F.when(F.col("least") == F.col("author"), F.col("next")).otherwise(F.col("least")).alias("target"))
    mentions = hit.where("target IS NOT NULL").select("id", F.lit("mentions").alias("kind"), "target")
    refs = posts.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(UUID), 1))).alias("uuid"))
    references = refs.join(items, "uuid").where("target <> id").select("id", F.lit("references").alias("kind"), "target")
    return mentions.unionByName(references).distinct()


PROFILE = "id string, username string, display_name string, name string, bio string, description string, profile_url string, url string"


def profiles(raw: DataFrame, known: DataFrame, base: str) -> DataFrame:
    """Records to import from ``raw(json)``: (id, username, display_name, bio, source_url), those of ``known(id)`` left out.

    Empty fields count as missing. A profile without an id and username is dropped; names are cut to 100 characters and
    biographies to 5000. The id is derived from the profile's own, so a repeated import adds nothing; of equal ids the
    record that is least by all fields stays.
    """
    p = raw.select(F.from_json("json", PROFILE).alias("p")).select("p.*")
    some = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))
    username = F.coalesce("username", F.lit(""))
    name = F.coalesce(some("display_name", "name", "username"), F.lit("Unknown"))
    url = F.coalesce(some("profile_url", "url"), F.concat(F.lit(base), username))
    own = p.select(
        some("id", "username").alias("own"), username.alias("username"), F.substring(name, 1, 100).alias("display_name"),
        F.substring(F.coalesce(some("bio", "description"), F.lit("")), 1, 5000).alias("bio"), url.alias("source_url"),
    ).where("own IS NOT NULL")
    one = own.groupBy("own").agg(F.min(F.struct("username", "display_name", "bio", "source_url")).alias("r")).select(uuid5(F.concat(F.lit(base), "own")).alias("id"), "r.*")
    return one.join(known.select("id"), "id", "left_anti")


def verdict(counts: DataFrame, items: str = "items", critical: str = "critical", warning: str = "warning", other: str = "other") -> DataFrame:
    """A severity and a sentence for counts of findings by severity over scanned items."""
    n = F.col(critical) + F.col(warning) + F.col(other)
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    severity = F.when(n == 0, "clean").when(F.col(critical) > 0, "critical").otherwise("warnings")
    details = (
        F.when((n == 0) & (F.col(items) == 0), "No code to scan")
        .when(n == 0, text("All ", F.col(items), " items passed security scan"))
        .when(F.col(critical) > 0, text(F.col(critical), " critical, ", F.col(warning), " warning vulnerabilities found across ", F.col(items), " items"))
        .otherwise(text(n, " warning(s) found across ", F.col(items), " items"))
    )
    return counts.withColumns({"severity": severity, "details": details})
