"""Stems by a table, queries against a brute-force evaluator, ranks and headlines against plain loops."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions.english import STOP, stem
from weftline.operators import fulltext as ft
from weftline.operators.search import TOKEN

#: Words and stems of the published sample.
STEMS = """consigned consign consistency consist consolation consol consolatory consolatori consolingly consol conspicuously conspicu conspirators conspir
constables constabl constancy constanc knackeries knackeri knavish knavish kneaded knead kneeling kneel knightly knight knitted knit knives knive knots knot
generate generat general general generically generic generous generous national nation hopping hop hoping hope happy happi cry cri by by say say ties tie cries cri
gas gas this this gaps gap kiwis kiwi falling fall failing fail filing file luxuriated luxuri skis ski inning inning succeed succeed exceeding exceed
relational relat conditional condit rational ration digitizer digit radically radic differently differ analogously analog predication predic operator oper
feudalism feudal decisiveness decis hopefulness hope sensibiliti sensibl triplicate triplic formative format electrical electr goodness good revival reviv
allowance allow inference infer adjustable adjust irritant irrit replacement replac dependent depend adoption adopt activate activ effective effect
rate rate cease ceas controll control roll roll yes yes boy boy enjoying enjoy dog's dog news news early earli dying die""".split()


def test_stems():
    assert [(w, stem(w)) for w in STEMS[::2]] == list(zip(STEMS[::2], STEMS[1::2], strict=True))
    assert stem("ß12") == "ß12" and stem("日本語") == "日本語" and stem("at") == "at" and len(STOP) == 127


def test_parse():
    t = ft.Term
    assert ft.parse("cats & dog:*") == ft.Node("and", (t("cat"), t("dog", True)))
    assert ft.parse("a | !b & (c <-> d) | the") == ft.Node("or", (ft.Node("and", (ft.Node("not", (t("b"),)), ft.Node("phrase", (t("c"), t("d"))))),))[1][0]
    assert ft.parse("king <-> of <-> spain") == ft.Node("phrase", (t("king"), t("spain")), 2)
    assert ft.parse("big-apple") == ft.Node("phrase", (t("big"), t("appl")))
    assert ft.parse("the & of") is None and ft.parse("") is None and ft.parse("the <-> x") == t("x")
    assert ft.beginnings("Foo ba!z") == ft.Node("and", (t("foo", True), t("baz", True))) and ft.all_words("the cats, the dogs") == ft.Node("and", (t("cat"), t("dog")))
    for bad in ("x &", "& x", "(x", "x)", "x y", "!", "(x & y) <-> z", "x :* y"):
        with pytest.raises(ValueError):
            ft.parse(bad)


def found_in(text, query):
    """Positions of the terms and whether the query holds, straight from the text."""
    words = [w.lower() for w in re.findall(TOKEN, text)]
    at = {}
    for term in ft.leaves(query):
        at[term] = [i for i, w in enumerate(words, 1) if w not in STOP and (stem(w).startswith(term.lexeme) if term.prefix else stem(w) == term.lexeme)]

    def ok(q, here=None):
        if isinstance(q, ft.Term):
            return bool(at[q])
        if q.op == "phrase":
            return any(spans(q, i) for i in range(1, len(words) + 1))
        if q.op == "not":
            return not ok(q.parts[0])
        return (all if q.op == "and" else any)(ok(p) for p in q.parts)

    def spans(q, i):
        """Ends of matches of a word or phrase that begins at i."""
        if isinstance(q, ft.Term):
            return {i} if i in at[q] else set()
        return {e for m in spans(q.parts[0], i) for e in spans(q.parts[1], m + q.distance)}

    return ok(query), at


QUERIES = ["run", "runs & jump", "run | jumping", "!run", "!run & sea", "run <-> jump", "run <2> jump", "run <-> the <-> jump", "(run <-> jump) <-> sea", "run <-> (jump <-> sea)", "ru:* & !jump:*", "connect & (sea | !run)", "!(run | sea)", "happy <3> sea | !happy:*", "zebra", "zebra & !run"]


def test_queries_against_brute_force(spark):
    rng = random.Random(9)
    words = ["run", "running", "Runs", "jump", "jumps", "jumping", "sea", "seas", "the", "of", "connection", "connected", "happy", "happiness", "rubber", "x1", "ünder", "--"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 14)))) for i in range(1000)] + [(2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).persist()
    for q in QUERIES:
        tree = ft.parse(q)
        got = {r.doc_id: (round(r.rank, 9), r.places) for r in ft.search(docs, tree).collect()}
        want = {}
        for i, text in rows:
            hit, at = found_in(text or "", tree)
            if hit:
                want[i] = (round(slow_rank(tree, [at[t] for t in ft.leaves(tree)]), 9), [at[t] for t in ft.leaves(tree)])
        assert got == want, q
    assert ft.search(docs, None).count() == 0 and ft.search(docs.limit(0), ft.parse("!run")).count() == 0
    docs.unpersist()


def slow_rank(tree, places, w=0.1):
    if isinstance(tree, ft.Node) and tree.op in ("and", "phrase") and len(places) > 1:
        out = -1.0
        for (i, a), (k, b) in itertools.combinations(enumerate(places), 2):
            for x in a:
                for y in b:
                    if x != y:
                        d = abs(x - y)
                        c = math.sqrt(w * w * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))))
                        out = c if out < 0 else 1 - (1 - out) * (1 - c)
        return out if out >= 0 else 1e-20
    return sum(sum(w / k**2 for k in range(1, len(p) + 1)) / 1.64493406685 for p in places) / len(places)


def slow_window(places, most):
    spots = sorted({p for own in places for p in own})
    best = None
    for a in spots:
        for b in spots:
            if a <= b < a + most:
                n = sum(any(a <= p <= b for p in own) for own in places)
                key = (-n, b - a, a)
                best = min(best, (key, a, b)) if best else (key, a, b)
    return best[1:] if best else (1, 0)


def test_headlines(spark):
    rng = random.Random(1)
    for _ in range(400):
        places = [sorted(rng.sample(range(1, 60), rng.randrange(0, 6))) for _ in range(rng.randrange(1, 4))]
        most = rng.choice([1, 3, 10, 30])
        assert ft.best_window(places, most) == slow_window(places, most)
    text = "One two, three four-five six. The seven runs eight ran nine jumping ten eleven twelve"
    tree = ft.parse("run & jump")
    docs = spark.createDataFrame([(1, text), (2, "nothing here"), (3, "run\n\njump")], "doc_id long, text string")
    got = {r.doc_id: r.fragment for r in ft.headlines(docs, ft.search(docs, tree), most=6).collect()}
    assert got == {1: "seven <b>runs</b> eight ran nine <b>jumping</b>", 3: "<b>run</b> <b>jump</b>"}
    assert ft.fragment("", [[]]) == "" and ft.fragment("a b c", [[]], 2) == "a b"
    long = " ".join(f"w{i}" for i in range(200)) + " run " + " ".join(f"v{i}" for i in range(200))
    cut = ft.fragment(long, [[201]], 30)
    assert len(cut.split()) == 30 and "<b>run</b>" in cut and cut.split()[15] == "<b>run</b>"


def test_one_hot_word(spark):
    """A word of every text, and one very long text."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, F.repeat(F.lit("run jump "), 30000)).otherwise("run far away").alias("text"))
    got = ft.search(docs, ft.parse("run & jumped")).collect()
    assert [r.doc_id for r in got] == [7] and 0.99 < got[0].rank <= 1
