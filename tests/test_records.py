"""Record operators on hand-made rows: nulls, empty texts, shared names, repeats, empty tables."""

import json
import random
import uuid

from pyspark.sql import functions as F

from weftline.operators import records as r
from weftline.operators import style
from weftline.operators.baseline import behaviour


def texts(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string")


def test_capabilities(spark):
    rows = [None, "", "# A\n## Features\n- a\n* b\n• c\nx\n-d\n- \n## More\n- no", "## features\r\n- one\r\n- two", "## Other\n- no", "## What it does\n" + "- x\n" * 20]
    got = [list(x[0]) for x in texts(spark, rows).orderBy("id").select(r.capabilities(F.col("text"))).collect()]
    assert got == [[], [], ["a", "b", "c"], ["one", "two"], [], ["x"] * 10]


def paragraph(text):
    out = []
    for line in map(str.strip, (text or "").split("\n")):
        if not line or line.startswith(("#", "![", "[!")):
            if out:
                break
        else:
            out.append(line)
    return " ".join(out)[:500]


def test_first_paragraph_against_a_loop(spark):
    rng = random.Random(5)
    rows = [None, "", "#", "a", "y" * 900] + ["\n".join(rng.choice(["", "  ", "# h", "![b](c)", "[![x]", "one", " two ", "[a]"]) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    got = [x[0] for x in texts(spark, rows).orderBy("id").select(r.first_paragraph(F.col("text"))).collect()]
    assert got == [paragraph(t) for t in rows]


def test_framework(spark):
    got = [x[0] for x in texts(spark, [None, "", "OpenAI", "openai langchain", "@modelcontextprotocol/sdk"]).orderBy("id").select(r.framework(F.col("text"))).collect()]
    assert got == [None, None, "native", "langchain", "mcp"]


def test_cross_links(spark):
    ids = [str(uuid.UUID(int=i)) for i in range(4)]
    posts = spark.createDataFrame([(0, 1, f"@ann @ANN {ids[1]} {ids[0]} {ids[1].upper()}"), (1, 9, "@Ann mail@béa.example @nobody"), (2, 2, None), (3, 5, "")], "id long, author long, text string")
    names = spark.createDataFrame([(1, "Ann"), (5, "ann"), (7, "Béa"), (8, None)], "target long, name string")
    items = spark.createDataFrame([(i, u) for i, u in enumerate(ids)], "target long, uuid string")
    got = sorted(tuple(x) for x in r.cross_links(posts, names, items).collect())
    assert got == [(0, "mentions", 5), (0, "references", 1), (1, "mentions", 1), (1, "mentions", 7)]
    assert r.cross_links(posts.limit(0), names, items).count() == 0
    assert r.cross_links(posts, names.limit(0), items.limit(0)).count() == 0


def test_profiles(spark):
    base = "https://x.example/"
    rows = [{"id": "a", "name": "n" * 200, "bio": "b" * 6000}, {"id": "a", "name": "n" * 200, "bio": "b" * 6000}, {"username": "u"}, {"name": "no id"}, {"id": "known"}]
    raw = spark.createDataFrame([(json.dumps(x),) for x in rows] + [(None,), ("no json",)], "json string")
    of = lambda own: str(uuid.uuid5(uuid.NAMESPACE_URL, base + own))
    known = spark.createDataFrame([(of("known"),)], "id string")
    got = {x.id: x for x in r.profiles(raw, known, base).collect()}
    assert set(got) == {of("a"), of("u")}
    assert (len(got[of("a")].display_name), len(got[of("a")].bio)) == (100, 5000)
    assert tuple(got[of("u")])[1:] == ("u", "u", "", base + "u")
    assert r.profiles(raw.limit(0), known, base).count() == 0


def test_verdict(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0), (3, 0, 0, 0), (3, 1, 2, 4), (3, 0, 2, 4)], "items long, critical long, warning long, other long")
    assert [(x.severity, x.details) for x in r.verdict(rows).orderBy("items", "critical", "warning").collect()] == [
        ("clean", "No code to scan"), ("clean", "All 3 items passed security scan"), ("warnings", "6 warning(s) found across 3 items"), ("critical", "1 critical, 2 warning vulnerabilities found across 3 items"),
    ]


def test_style(spark):
    rows = [None, "", "  \n", "Delve!", "landscaped", "Fine. It's worth noting it.", "a -- b", "one two three four five six seven eight. " * 3, "It serves as one, stands as two and boasts.", "What if we go?"]
    df = texts(spark, rows)
    got = [(x.severity, list(x.reasons)) for x in style.check(df).orderBy("id").collect()]
    assert got == [
        ("ok", []), ("ok", []), ("ok", []), ("block", ["blocklist_word"]), ("ok", []), ("block", ["blocklist_phrase"]), ("warn", ["high_em_dash_density"]),
        ("warn", ["no_short_sentence"]), ("warn", ["high_copula_avoidance"]), ("block", ["rhetorical_opener"]),
    ]
    lenient = [x.severity for x in style.check(df, short_form=True, strict=False).orderBy("id").collect()]
    assert lenient == ["ok", "ok", "ok", "warn", "ok", "warn", "warn", "ok", "warn", "warn"]
    assert style.check(df.limit(0)).count() == 0


def test_behaviour(spark):
    acts = spark.createDataFrame([(1, "post", 10, True), (1, "post", 21, False), (1, "vote", None, None), (2, "received", None, None)], "id long, kind string, length long, reply boolean")
    met = spark.createDataFrame([(1, i % 7) for i in range(2, 16)] + [(3, 1)], "a long, b long")
    scores = spark.createDataFrame([(1, 0.12345)], "id long, score double")
    got = {x.id: x for x in behaviour(acts, met, scores, 7).collect()}
    one = got[1]
    assert (one.posts_per_day, one.votes_per_day, one.avg_post_length, one.reply_ratio, one.unique_partners) == (0.29, 0.14, 15.5, 0.5, 7)
    assert one.top_partners == "1:4,3:3,0:2,2:2,4:2" and one.trust_score in (0.1234, 0.1235)
    assert (got[2].attestations_received, got[2].unique_partners, got[2].trust_score) == (1, 1, None)
    assert (got[3].posts_per_day, got[3].top_partners) == (0.0, "1:3")
    assert behaviour(acts.limit(0), met.limit(0), scores, 7).count() == 0
