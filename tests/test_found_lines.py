"""Choosing the lines on which the scanners' patterns are tried: nothing that a pattern matches is left out, nothing else is exploded."""

import random
import re
from re import _parser as parser

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from weftline.functions.lines import found_lines
from weftline.operators import file_scan as fs
from weftline.operators import rule_values as v
from weftline.operators import scanner as sc

SPACES = " \t\x0b"


def example(nodes, r) -> str:
    """A random text of a parsed pattern; what stands before and after it is not looked at."""
    out = []
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(arg))
        elif name in ("ANY", "NOT_LITERAL"):
            out.append("~")
        elif name == "IN":
            refused, known = str(arg[0][0]) == "NEGATE", [x for x in arg if str(x[0]) != "NEGATE"]
            kind, value = r.choice(known)
            inner = {"CATEGORY_SPACE": r.choice(SPACES), "CATEGORY_WORD": "w", "CATEGORY_DIGIT": "7", "CATEGORY_NOT_SPACE": "x"}
            out.append("~" if refused else chr(value) if str(kind) == "LITERAL" else chr(r.randint(*value)) if str(kind) == "RANGE" else inner[str(value)])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, sub = arg
            out += [example(sub, r) for _ in range(r.randint(low, min(int(high), low + 2)))]
        elif name == "SUBPATTERN":
            out.append(example(arg[3], r))
        elif name == "BRANCH":
            out.append(example(r.choice(arg[1]), r))
    return "".join(out)


LISTS = {
    "rules": (fs.RULE_WORDS, [p for c, rules in v.RULES.items() if c != "hidden_unicode" for _, _, p, _ in rules] + [r"\x1B\["]),
    "near": (fs.NEAR_CODE, [v.NET_READ, v.EXEC_SINK]),
    "legs": (fs.FLOW_WORDS, list(v.LEGS.values())),
    "signals": (fs.SIGNAL_WORDS, [p for _, p in v.SIGNALS]),
    "dependencies": (fs.DEPENDENCY_WORDS, [p for _, _, p in v.DEPENDENCIES]),
}


@pytest.mark.parametrize("name", LISTS)
def test_words_find_whatever_a_pattern_matches(name):
    words, patterns = LISTS[name]
    r = random.Random(7)
    for p in patterns:
        tree, seen = parser.parse(p), []
        for _ in range(400):
            text = example(tree, r)
            if tree.state.flags & re.I:
                text = "".join(r.choice((c.lower(), c.upper())) for c in text)
            seen += [t for t in (text, f" {text} ") if "\n" not in t and re.search(p, t)]
        assert len(seen) > 20, p
        missed = pc.filter(pa.array(seen), pc.invert(pc.match_substring_regex(pa.array(seen), words)))
        assert len(missed) == 0, (p, missed[0])


def test_hidden_characters_are_found(spark):
    odd = [0xE0000, 0xE0041, 0xE007F, *range(0x202A, 0x202F), *range(0x2066, 0x206A), 0x200B, 0x200C, 0x200D, 0x2060, 0x180E]
    df = spark.createDataFrame([(f"{c:x}", f"a\nb{chr(c)}") for c in odd], "path string, text string")
    assert {(r.path, r.line, r.category) for r in fs.file_findings(df).collect()} == {(f"{c:x}", 2, "hidden_unicode") for c in odd}


def test_lines_and_numbers(spark):
    texts = [None, "", "\n", "eval(\n", "a\r\n\neval(x)\n日本 Eval(\nb", None, "none", "EVAL( \r", "x\neval("]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(2)
    got = {r.id: [(x.line, x.content) for x in r.found] for r in df.select("id", found_lines("text", r"(?i)eval\(").alias("found")).collect()}
    assert got == {i: [(k, s) for k, s in enumerate((t or "").split("\n")) if "eval(" in s.lower()] for i, t in enumerate(texts)}
    assert df.where("id < 0").select(found_lines("text", "a")).collect() == []


def test_broken_bytes_hide_nothing(spark):
    df = spark.sql("SELECT 'src/a.py' AS path, cast(concat(X'61FF0A', cast('eval(' AS binary), X'FFC3', cast(') + 1' AS binary), X'0AFE') AS string) AS text")
    one = lambda gated: [(r.line, r.category, r.name) for r in fs.file_findings(df, gated=gated).collect()]
    assert one(True) == one(False) == [(2, "unsafe_exec", "eval() call")]


def generated(plan) -> int:
    """Rows that a run plan made out of rows: lines of texts."""
    children = plan.children()
    own = plan.metrics().get("numOutputRows").get().value() if plan.nodeName() == "Generate" else 0
    return own + sum(generated(children.apply(i)) for i in range(children.size()))


def test_lines_without_a_word_are_not_exploded(spark):
    prose = "\n".join(["the house stands near the water and nobody asks (yet) why"] * 5000)
    df = spark.createDataFrame([("src/a.py", prose + "\neval(x)"), ("src/b.py", prose)], "path string, text string")
    found = fs.file_findings(df)
    assert [(r.path, r.line, r.category) for r in found.collect()] == [("src/a.py", 5001, "unsafe_exec")]
    assert 0 < generated(found._jdf.queryExecution().executedPlan()) < 20


def test_flows_and_lists_are_the_same_with_and_without_words(spark):
    from weftline.plans import scanning as q

    r = random.Random(3)
    rows = [(f"{r.choice(q.FOLDERS)}{i}/{r.choice((*q.NAMES, *q.LISTS))}", "\n".join(r.choices((*q.SNIPPETS, *q.REQUIRED, "words of prose", "", " # os.environ requests.get"), k=30))) for i in range(150)]
    df = spark.createDataFrame(rows, "path string, text string")
    flow = lambda **k: sorted(map(tuple, sc.composite(df, v.LEGS, "path", path_col="path", **k).collect()))
    listed = lambda **k: sorted(map(tuple, sc.first_matches(df, v.DEPENDENCIES, "path", path_col="path", names=v.DEPENDENCY_FILES, **k).collect()))
    assert flow() and flow() == flow(finds=fs.FLOW_WORDS)
    assert listed() and listed() == listed(finds=fs.DEPENDENCY_WORDS)
    code = lambda t: [x for x in t.split("\n") if not re.search(sc.COMMENT, x)]
    want = {p: ([any(re.search(s, x) for x in code(t) if not re.search("(?i)example|placeholder", x)) for _, s in v.SIGNALS], sum(sc.SUPPRESS in x for x in code(t))) for p, t in rows}
    assert {x.path: (x.signals, x.suppressions) for x in fs.file_signals(df).collect()} == want
    side = {x.path for x in df.where(F.col("path").rlike(sc.SIDE_PATHS)).collect()}
    first = {}
    for p, t in rows:
        reads, runs = ([k for k, x in enumerate(t.split("\n"), 1) if re.search(s, x)] for s in (v.NET_READ, v.EXEC_SINK))
        if p not in side and any(abs(a - b) <= 3 for a in reads for b in runs):
            first[p] = min(reads)
    assert first and {x.path: x.line for x in fs.remote_then_run(df, 3).collect()} == first
