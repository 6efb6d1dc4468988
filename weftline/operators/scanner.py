"""Rule-based scanning of text: line findings, scores, content filter, style tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.exprs import luhn_valid
from weftline.functions.lines import found_lines

#: Our own small rule table: category, severity, pattern (Java and RE2 syntax), in order of precedence within a category.
RULES = (
    ("secret", "critical", r"AKIA[A-Z0-9]{16}"),
    ("secret", "high", r"(?i)(password|token|secret)\s*[:=]"),
    ("unsafe_exec", "high", r"(?i)\b(eval|exec|system)\s*\("),
    ("exfiltration", "medium", r"https?://"),
    ("obfuscation", "medium", r"[A-Za-z0-9+/]{80,}"),
    ("fs_access", "low", r"(?i)\bopen\("),
)
SEVERITY = {"critical": 15, "high": 8, "medium": 3}
CATEGORY = {"critical": 25, "high": 15, "medium": 8, "low": 3}
SUPPRESS = "scan: ignore"
COMMENT = r"^\s*(#|//|\*|/\*)"
#: Tests, documents, examples, and files that describe builds: what they hold is not shipped code.
SIDE_PATHS = "|".join((
    r"(?:^|/)(?:tests|test|spec|__tests__|testing|docs|doc|examples|example|samples|\.github|\.gitlab|\.agents|\.circleci|\.buildkite)(?:/|$)",
    r"(?i:(?:^|/)(?:test_[^/]*|[^/]*_(?:test|spec)(?:\.[^./]*)?|conftest(?:\.[^./]*)?)$)",
    r"(?i:\.(?:example|sample|template))",
    r"(?:^|/)Dockerfile(?:\.[^/]*)?$|(?i:\.dockerfile$)",
    r"(?i:(?:^|/)(?:\.gitlab-ci\.yml|\.travis\.yml|azure-pipelines\.yml|cloudbuild\.yaml)$)",
    r"(?:^|/)workflows/(?:.*/)?[^/]*\.(?i:ya?ml)$",
))


def lines(docs: DataFrame, id_col: str, text_col: str, finds: str | None = None, *more: Column) -> DataFrame:
    """A row per line, numbered from 0; with ``finds``, a pattern in RE2's syntax, only of lines in which it is found."""
    every = F.inline(found_lines(text_col, finds)) if finds else F.posexplode(F.split(text_col, "\n", -1))
    return docs.select(F.col(id_col).alias("id"), *more, every.alias("line", "content"))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """At most one finding per line and category, the first rule of the category; comments and suppressed lines have none.

    All categories are tested in one pass over the lines: a native expression each, no join and no Python.
    """
    parts = []
    for category in dict.fromkeys(r[0] for r in rules):
        own = [r for r in rules if r[0] == category]
        sev = F.when(F.col("content").rlike(own[0][2]), own[0][1])
        for r in own[1:]:
            sev = sev.when(F.col("content").rlike(r[2]), r[1])
        parts.append(F.struct(F.lit(category).alias("category"), sev.alias("severity")))
    kept = lines(docs, id_col, text_col).where(~F.col("content").rlike(r"^\s*#") & ~F.contains("content", F.lit(SUPPRESS)))
    hit = kept.select("id", "line", F.explode(F.array(*parts)).alias("f")).where("f.severity is not null")
    return hit.select("id", (F.col("line") + 1).cast("long").alias("line"), "f.category", "f.severity")


def scan_score(found: DataFrame, files: DataFrame) -> DataFrame:
    """Score from 0 to 100 of each source of ``files(id, source)`` from its files' findings.

    Deductions by severity shrink where few files are affected, with truncation; a clean source starts higher.
    """
    n = lambda s: F.count_if(F.col("severity") == s)
    per_file = found.groupBy("id").agg(n("critical").alias("c"), n("high").alias("h"), n("medium").alias("m"))
    s = files.join(per_file, "id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.count("c").alias("affected"), *(F.sum(F.coalesce(x, F.lit(0))).alias(x) for x in ("c", "h", "m")))
    raw = F.col("c") * SEVERITY["critical"] + F.col("h") * SEVERITY["high"] + F.col("m") * SEVERITY["medium"]
    total = F.col("c") + F.col("h") + F.col("m")
    scale = F.least(F.lit(1.0), 0.4 + F.col("affected") / F.col("files") * 2.4)
    score = F.when(total == 0, 80).otherwise(70 - F.floor(raw * scale))
    return s.select("source", "files", "affected", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long").alias("score"))


def category_scores(found: DataFrame) -> DataFrame:
    """100 less the weights of a file's findings by category, at least 0."""
    weight = F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv])[F.col("severity")]
    return found.groupBy("id", "category").agg(F.greatest(F.lit(0), 100 - F.sum(weight)).cast("long").alias("score"))


def nearest(lines: DataFrame, key: str, a: str, b: str, within: int) -> DataFrame:
    """Keys with a line of flag ``a`` and one of flag ``b`` at most ``within`` apart: the first of ``a`` and the least distance.

    Each line takes its nearest ones from a window over the key's own lines, so no pairs are built.
    """
    order = W.partitionBy(key).orderBy("line")
    before, after = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col(b), F.col("line"))
    seen = lines.select(key, "line", a, F.last(at, True).over(before).alias("_before"), F.first(at, True).over(after).alias("_after")).where(F.col(a))
    gap = F.least(F.col("line") - F.col("_before"), F.col("_after") - F.col("line"))
    return seen.groupBy(key).agg(F.min("line").alias("first"), F.min(gap).alias("distance")).where(F.col("distance") <= within)


def near_lines(found: DataFrame, first: str, second: str, within: int) -> DataFrame:
    """Files in which findings of two categories stand at most ``within`` lines apart."""
    flagged = found.select("id", "line", (F.col("category") == first).alias("_a"), (F.col("category") == second).alias("_b")).where("_a or _b")
    return nearest(flagged, "id", "_a", "_b", within).select("id", "distance")


def composite(docs: DataFrame, legs: dict[str, str], id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, allowed: Column | None = None, finds: str | None = None) -> DataFrame:
    """One finding for each file that has untrusted input, an outbound channel, and a read of private data or of files.

    ``legs`` has the patterns of sensitive, file_read, untrusted and outbound lines. Comments and blank lines don't
    count. The finding stands at the first private read (high) or else file read (medium); with ``path_col`` it is medium
    in tests, documents and builds. Rows for which ``allowed`` holds have none. Only files whose whole text has all that are
    split into lines; a file is one group of four minima, combined before the shuffle. With ``finds``, a pattern in RE2's
    syntax that is found in each line of any leg, one pass over the texts chooses the lines instead.
    """
    own = docs
    if not finds:
        whole = {n: F.col(text_col).rlike(p) for n, p in legs.items()}
        own = docs.where(whole["outbound"] & whole["untrusted"] & (whole["sensitive"] | whole["file_read"]))
    if allowed is not None:
        own = own.where(~allowed)
    side = F.coalesce(F.col(path_col), F.lit("")).rlike(SIDE_PATHS) if path_col else F.lit(False)
    kept = lines(own, id_col, text_col, finds, side.alias("side")).where(F.col("content").rlike(r"\S") & ~F.col("content").rlike(COMMENT))
    first = kept.groupBy("id").agg(F.bool_and("side").alias("side"), *(F.min(F.when(F.col("content").rlike(p), F.col("line") + 1)).alias(n) for n, p in legs.items()))
    hit = first.where("untrusted is not null and outbound is not null and (sensitive is not null or file_read is not null)")
    severity = F.when(F.col("sensitive").isNotNull() & ~F.col("side"), "high").otherwise("medium")
    return hit.select("id", severity.alias("severity"), F.coalesce("sensitive", "file_read").cast("long").alias("line"))


def first_matches(docs: DataFrame, listed, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, names: tuple[str, ...] = (), finds: str | None = None) -> DataFrame:
    """For each file the first line outside comments that matches each (name, severity, pattern) of a list.

    With ``path_col`` only files of the given ``names`` (in either case) are read. ``finds`` is a pattern in RE2's syntax
    that is found in each line that any of them matches.
    """
    if path_col:
        docs = docs.where(F.lower(F.regexp_extract(path_col, r"([^/]*)$", 1)).isin(*names))
    kept = lines(docs, id_col, text_col, finds).where(~F.col("content").rlike(r"^\s*(#|//|\*)"))
    first = kept.groupBy("id").agg(*(F.min(F.when(F.col("content").rlike(p), F.col("line") + 1)).cast("long").alias(n) for n, _, p in listed))
    severity = F.create_map(*[F.lit(x) for n, s, _ in listed for x in (n, s)])
    return first.unpivot(["id"], [n for n, *_ in listed], "name", "line").where("line is not null").select("id", "name", "line", severity[F.col("name")].alias("severity"))


def scan_score_full(found: DataFrame, facts: DataFrame, positives: int, practices: int) -> DataFrame:
    """The score of each source with bonuses and the penalty for suppressions.

    ``facts(id, source, positives, practices, suppressions)`` holds for each file arrays of so many flags and a count.
    Each positive signal that any file has adds 5, up to 35; each good practice 5; each suppression beyond three takes 3.
    A source with low findings only starts as high as one without any.
    """
    n = lambda s: F.count_if(F.col("severity") == s)
    per_file = found.groupBy("id").agg(n("critical").alias("c"), n("high").alias("h"), n("medium").alias("m"), F.count(F.lit(1)).alias("n"))
    any_of = lambda name, k: sum((F.coalesce(F.bool_or(F.col(name)[i]), F.lit(False)).cast("int") for i in range(k)), F.lit(0))
    s = facts.join(per_file, "id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("files"), F.count("n").alias("affected"), *(F.sum(F.coalesce(x, F.lit(0))).alias(x) for x in ("c", "h", "m")),
        any_of("positives", positives).alias("positives"), any_of("practices", practices).alias("practices"), F.sum("suppressions").alias("suppressions"),
    )
    raw = F.col("c") * SEVERITY["critical"] + F.col("h") * SEVERITY["high"] + F.col("m") * SEVERITY["medium"]
    return s.select("source", _score(raw).cast("long").alias("score"))


def _score(raw: Column) -> Column:
    """From 0 to 100 out of a source's sums: c, h, m, affected, files, positives, practices, suppressions, and its raw deduction."""
    clean = F.col("c") + F.col("h") + F.col("m") == 0
    scale = F.least(F.lit(1.0), 0.4 + F.col("affected") / F.col("files") * 2.4)
    taken = F.when(clean | (F.col("files") == 0), raw).otherwise(F.floor(raw * scale))
    score = F.when(clean, 80).otherwise(70) - taken + F.least(F.col("positives") * 5, F.lit(35)) + F.col("practices") * 5 - 3 * F.greatest(F.col("suppressions") - 3, F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


#: Categories that a tool server, or a tool for sound and video, has by its nature.
EXPECTED = {"server": ("fs_access", "unsafe_exec"), "media": ("fs_access",)}


def source_scores(found: DataFrame, sources: DataFrame) -> DataFrame:
    """The score of each source out of all its findings, of whatever scanner.

    ``found(source, path, category, severity)``; ``sources(source, files, positives, practices, suppressions, server, media)``
    has a row each: positives and practices are numbers of distinct signals and good practices. For tool servers and media
    tools expected categories take a tenth: 0.8 for a high and 0.3 for a medium finding, nothing for a critical one.
    """
    n = lambda s, e: F.count_if((F.col("severity") == s) & F.col("category").isin(*EXPECTED[e]) if e else F.col("severity") == s)
    kinds = {"c": "critical", "h": "high", "m": "medium"}
    per_file = found.groupBy("source", "path").agg(*(n(s, e).alias(k + (e or "")) for k, s in kinds.items() for e in (None, "server", "media")))
    per = per_file.groupBy("source").agg(F.count(F.lit(1)).alias("affected"), *(F.sum(c).alias(c) for c in per_file.columns[2:]))
    s = sources.join(per, "source", "left").na.fill(0, ["affected", *per_file.columns[2:]])
    own = {k: F.when(F.col("server"), F.col(k + "server")).when(F.col("media"), F.col(k + "media")).otherwise(0) for k in kinds}
    full = sum(((F.col(k) - own[k]) * SEVERITY[kinds[k]] for k in kinds), F.lit(0))
    raw = full + F.floor(own["h"] * 8 / 10) + F.floor(own["m"] * 3 / 10)
    return s.select("source", _score(raw).cast("long").alias("score"))


#: Scores of a text from which it is blocked, and from which it is flagged.
BLOCK_SCORE, FLAG_SCORE = 0.85, 0.70


def moderation(score: Column, block: float = BLOCK_SCORE, flag: float = FLAG_SCORE) -> Column:
    """What becomes of a text by its greatest score; without one it passes."""
    return F.when(score >= block, "block").when(score >= flag, "flag").otherwise("pass")


#: Fixed patterns of the content filter.
SPAM = r"(?i)(buy|sell|cheap|discount|free money).{0,20}(click|visit|http)|(earn|make)\s+\$\d+|(viagra|cialis|pharmacy|crypto\s*airdrop)|(bit\.ly|tinyurl|t\.co|shorturl)[\s/]|(subscribe|follow)\s+(my|our)\s+(channel|page)"
NOISE = r"[A-Z]{20,}"
INJECTION = r"(?i)ignore\s+(all\s+)?previous\s+instructions|you\s+are\s+now\s+(a|an)\s+|system\s*:\s*|<\|?(system|assistant|user)\|?>"
SSN, CARD, PHONE = r"\b\d{3}-\d{2}-\d{4}\b", r"\b(\d[ -]*?){13,19}\b", r"\b(\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b"


def repeats_char(text: Column) -> Column:
    """The same character ten times or more in a row."""
    return text.rlike(r"(.)\1{9,}")


def pii_kind(text: Column) -> Column:
    """The first kind of personal data: a social security number, a card number with a valid checksum, a phone number."""
    card = F.regexp_replace(F.regexp_extract(text, CARD, 0), r"[^0-9]", "")
    return F.when(text.rlike(SSN), "ssn").when(luhn_valid(card), "credit_card").when(text.rlike(PHONE), "phone")


def content_filter(text: Column) -> dict[str, Column]:
    """Flags with their weights; a text is clean below 0.5 in total, and the score is at most 1. Blank texts are clean."""
    links = F.regexp_count(text, F.lit(r"https?://"))
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    flag = lambda c: ~blank & F.coalesce(c, F.lit(False))
    flags = {"spam": flag(text.rlike(SPAM)), "noise": flag(text.rlike(NOISE) | repeats_char(text)), "injection": flag(text.rlike(INJECTION)), "links": flag(links > F.when(F.length(text) < 2000, 3).otherwise(15)), "pii": flag(pii_kind(text).isNotNull())}
    weights = {"spam": 0.6, "noise": 0.6, "injection": 0.8, "links": 0.6, "pii": 0.7}
    total = sum((F.when(c, weights[k]).otherwise(0.0) for k, c in flags.items()), F.lit(0.0))
    return {**flags, "score": F.round(F.least(total, F.lit(1.0)), 4), "clean": total < 0.5}
