"""A check of drafts for worn phrases and rhythm, as one expression per rule."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.exprs import computed_once

# Words and phrases that block, phrases in place of a plain verb, and patterns.
WORDS = """
delve delves delving tapestry tapestries testament landscape landscapes intricate intricacies pivotal crucial crucially
meticulous meticulously nuanced multifaceted underscore underscores underscoring bolster bolsters bolstered bolstering
garner garners garnered showcase showcases showcased foster fosters fostering interplay vibrant robust seamless
seamlessly leverage leverages leveraged leveraging navigate navigates navigating harness harnesses harnessing endeavor
endeavors facet facets myriad plethora realm paramount indispensable quintessential noteworthy compelling pristine
stunning breathtaking captivating elevate elevates elevating streamline streamlines streamlining supercharge
supercharges supercharging unlock unlocks unlocking unleash unleashes unleashing empower empowers empowering
transformative unparalleled effortless effortlessly revolutionize revolutionizes revolutionizing redefine redefines
redefining reimagine reimagines reimagining turbocharge turbocharged ever-evolving cornerstone powerhouse
""".split()
PHRASES = (
    "it's worth noting", "it is worth noting", "it's important to note", "it is important to note", "it's important to recognize", "one could argue",
    "in today's ever-evolving", "in today's fast-paced", "in today's digital age", "in an era of", "in an era where", "in the realm of", "at its core",
    "at the heart of", "in conclusion", "in summary", "in essence", "as we move forward", "moving forward", "the future of", "certainly!", "absolutely!",
    "i'd be happy to", "i would be happy to", "great question", "cutting-edge", "game-changing", "groundbreaking", "revolutionary", "state-of-the-art",
    "best-in-class", "dive into", "let's dive", "deep dive", "let's explore", "let's unpack", "let's break it down", "let's break this down",
    "here's the thing", "here's the kicker", "here's the best part", "the best part?", "the result?", "but here's the catch", "needless to say",
    "rest assured", "look no further", "say goodbye to", "buckle up", "when it comes to", "at the end of the day", "the bottom line", "more than ever",
    "now more than ever", "the power of", "the key to", "a game changer", "a testament to", "plays a key role", "plays a vital role",
    "plays a crucial role", "plays a pivotal role", "plays a significant role", "in a world where", "imagine a world", "picture this", "in short",
    "in a nutshell", "long story short",
)
COPULAS = ("serves as", "stands as", "represents a", "marks a", "boasts", "embodies", "exemplifies")
PATTERNS = {
    "neg_parallelism": (
        r"(?i)\bit'?s\s+not\s+just\s+\w[\w\s]{0,40}[,;—–-]\s*it'?s\b",
        r"(?i)\bnot\s+just\s+\w[\w\s]{0,40}[,;]?\s+but(?:\s+also)?\b",
        r"(?i)\bnot\s+(?:a|an|the|simply|merely)\s+\w[\w\s]{0,30}[,;]\s+but\s+\w",
        r"(?i)\b\w+\s+isn'?t\s+just\s+\w[\w\s]{0,40}[,;—–-]\s*it'?s\b",
    ),
    "participial_tail": (r"(?i),\s+(ensuring|allowing|enabling|empowering|helping|making|providing|offering|delivering|driving|fostering|creating|unlocking|streamlining|paving)\b",),
    "signpost_transition": (r"(?:^|[.!?]\s+|\n)(Moreover|Furthermore|Additionally|Notably|Importantly|Consequently|Subsequently|That said),",),
    "plays_a_role": (r"(?i)\bplays?\s+an?\s+\w+\s+role\b",),
    "rhetorical_opener": (r"(?i)^\s*(Ever\s+(wonder|wondered|thought)|Ready\s+to|What\s+if|Tired\s+of|Want\s+to|Have\s+you\s+ever|Imagine\s+if)\b[^.?!]*\?",),
}
DASHES = "—|--"
MOST_DASHES = 2.5
SHORT_WORDS = 7
MOST_COPULAS = 2


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def _has_word(low: Column) -> Column:
    """Any of the words: plain ones by a set over the text's words, others by a pattern where the text has them."""
    plain = [w for w in WORDS if w.isalpha()]
    out = F.arrays_overlap(F.split(low, r"\W+"), F.array(*map(F.lit, plain)))
    for w in WORDS:
        if not w.isalpha():
            out = out | (low.contains(w) & low.rlike(rf"\b{w}\b"))
    return out


def _sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def check(df: DataFrame, text: str = "text", short_form: bool = False, strict: bool = True) -> DataFrame:
    """``df`` with reasons (names in order of the rules) and severity: ok, warn or block.

    Words, phrases and patterns block, or warn where not ``strict``; many dashes, no short sentence among three or more
    and many stand-ins for plain verbs warn. Null and blank texts are ok. Classes in patterns are of ASCII characters.
    """
    df = computed_once(df, _text=F.coalesce(F.col(text), F.lit("")), _low=F.lower(F.coalesce(F.col(text), F.lit(""))))
    t, low = F.col("_text"), F.col("_low")
    patterns = {name: _any(t, p) for name, p in PATTERNS.items()}
    patterns["neg_parallelism"] = (low.contains("not") | low.contains("isn")) & patterns["neg_parallelism"]
    hard = {"blocklist_word": _has_word(low), "blocklist_phrase": reduce(or_, (low.contains(p) for p in PHRASES)), **patterns}
    long = lambda s: F.size(F.split(s, r"\s+")) > SHORT_WORDS
    sentences = _sentences(t)
    copulas = sum((F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))) / len(c) for c in COPULAS)
    soft = {
        "high_em_dash_density": F.regexp_count(t, F.lit(DASHES)) * 500.0 > F.length(t) * MOST_DASHES,
        "no_short_sentence": F.lit(not short_form) & (F.size(sentences) >= 3) & F.forall(sentences, long),
        "high_copula_avoidance": copulas > MOST_COPULAS,
    }
    blank = ~t.rlike(r"\S")
    name = lambda rules: F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    out = df.withColumn("_hard", F.when(~blank, name(hard)).otherwise(F.array().cast("array<string>"))).withColumn("_soft", F.when(~blank, name(soft)).otherwise(F.array().cast("array<string>")))
    severity = F.when(F.size("_hard") > 0, "block" if strict else "warn").when(F.size("_soft") > 0, "warn").otherwise("ok")
    return out.withColumns({"reasons": F.concat("_hard", "_soft"), "severity": severity}).drop("_hard", "_soft", "_text", "_low")
