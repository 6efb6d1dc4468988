"""Tandem runs, boosted trees and hard negatives against brute force; samples and the pipeline on repeated ids."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import hard_negatives as hn
from weftline.llm import quality_rules, quality_trees, shared, toxicity
from weftline.llm import queries as registered
from weftline.llm import tandem_runs as tr

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


# tandem runs


def brute_runs(s, least=24, exponent=3):
    n, out = len(s), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            length = j - i + q
            part = s[i : i + length]
            if j > i and length >= max(least, exponent * q) and not any(all(part[x] == part[x + p] for x in range(length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def split(text):
    words, now = [], ""
    for c in text:
        if c in SPACES:
            words += [now] if now else []
            now = ""
        else:
            now += c
    return words + ([now] if now else [])


def brute_digest(doc_id, text):
    w = split(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *tail, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def periodic(rng):
    k = rng.choice([1, 2, 2, 3, 50])
    s = [rng.randrange(k) for _ in range(rng.randrange(140))]
    for _ in range(rng.randrange(4)):
        root = [rng.randrange(k) for _ in range(rng.randrange(1, 14))]
        at = rng.randrange(len(s) + 1)
        s[at:at] = (root * 9)[: rng.randrange(1, 80)]
    return s


@pytest.mark.parametrize(("least", "exponent"), [(24, 3), (1, 2), (6, 2)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(least)
    fibonacci = [0, 1]
    while len(fibonacci) < 170:
        fibonacci = [*fibonacci, *fibonacci[: len(fibonacci) - len(fibonacci) // 3]] if False else fibonacci + [x for x in fibonacci[: max(1, round(len(fibonacci) * 0.618))]]
    for trial in range(120):
        docs = [periodic(rng) for _ in range(rng.randrange(1, 6))] + ([fibonacci, [0] * 90, []] if trial % 20 == 0 else [])
        first = np.cumsum([0, *map(len, docs)])
        got = tr.chunk_runs(np.array(sum(docs, []), np.int64), first, least, exponent)
        assert [tuple(x) for x in got.tolist()] == [(r, *x) for r, d in enumerate(docs) for x in brute_runs(d, least, exponent)]


def test_runs_of_long_texts_in_small_batches(monkeypatch):
    monkeypatch.setattr(tr, "PAIRS", 100)
    monkeypatch.setattr(tr, "TOGETHER", 50)
    rng = random.Random(8)
    docs = [periodic(rng) for _ in range(12)]
    got = tr.chunk_runs(np.array(sum(docs, []), np.int64), np.cumsum([0, *map(len, docs)]))
    assert [tuple(x) for x in got.tolist()] == [(r, *x) for r, d in enumerate(docs) for x in brute_runs(d)]
    n = 300_000
    assert tr.chunk_runs(np.arange(n) % 7, np.array([0, n])).tolist() == [[0, 0, n, 7]]
    assert tr.chunk_runs(np.arange(n) % (n // 3), np.array([0, n])).tolist() == [[0, 0, n, n // 3]]


def test_run_digests(spark):
    rng = random.Random(4)
    rows = [(None, "a b " * 30), (-5, "x " * 40), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (7, "ß é ü 😀 " * 20), (7, "ß é ü 😀 " * 20)]
    rows += [(100 + i, " \n\t\x0b"[i % 4].join(f"w{x}" for x in periodic(rng))) for i in range(80)] + [(500 + i, "\n ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 200)))) for i in range(60)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, runs string, n_words int").repartition(3)
    got = tr.run_digests(df)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((brute_digest(*r) for r in rows), key=repr)
    whole = {r.doc_id: r for r in tr.tandem_runs(df).where("doc_id in (-5, 4)").collect()}
    assert whole[-5].collapsed == "x" and [tuple(r) for r in whole[-5].runs] == [(0, 40, 1)] and whole[4].collapsed == "one" and not whole[4].runs
    assert tr.run_digests(df.limit(0)).count() == 0


def test_run_digests_of_the_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect() if len(split(r.text)) < 700]
    got = {r.doc_id: tuple(r) for r in registered.op11_tandem_runs(spark, d).collect()}
    assert len(docs) > 120 and all(got[i] == brute_digest(i, t) for i, t in docs)


# boosted trees


def test_trees_step_by_step():
    """Flat traversal equals walking each tree node by node; xor needs depth two."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, (3000, 4)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 2] > 3)).astype(float)
    m = quality_trees.fit(x[:2000], y[:2000], trees=30, depth=3)
    walked = []
    for row in x[:200]:
        total = m.prior
        for t in range(len(m.feature)):
            node = 0
            while node < m.feature.shape[1]:
                node = 2 * node + 1 + (row[m.feature[t, node]] >= m.threshold[t, node])
            total += m.value[t, node - m.feature.shape[1]]
        walked.append(1 / (1 + np.exp(-total)))
    assert quality_trees.apply(m, x[:200], together=64) == pytest.approx(walked)
    assert ((quality_trees.apply(m, x[2000:]) >= 0.5) == (y[2000:] == 1)).mean() > 0.99
    first = quality_trees.fit(x, y, trees=1, depth=1)  # the best single split, found by trying all of them
    p = y.mean() + 0 * y
    g, h = p - y, p * (1 - p)
    score = lambda hit: g[hit].sum() ** 2 / (h[hit].sum() + 1) + g[~hit].sum() ** 2 / (h[~hit].sum() + 1)
    best = max(score(x[:, f] < c) for f in range(4) for c in range(1, 12))
    assert score(x[:, first.feature[0, 0]] < first.threshold[0, 0]) == pytest.approx(best, rel=1e-3)


def test_trees_without_both_classes():
    x = np.zeros((5, 3))
    assert quality_trees.apply(quality_trees.fit(x, np.ones(5)), x[:2]) == pytest.approx([6 / 7] * 2)
    assert quality_trees.apply(quality_trees.fit(x[:0], np.ones(0)), x[:2]) == pytest.approx([0.5] * 2)


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = registered.op12_quality_classifier(spark, d).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) > 0.97 * len(got) > 100
    rank = sorted(got, key=lambda r: r.score)
    good = [i for i, r in enumerate(rank) if r.quality == 1]
    area = (sum(good) - len(good) * (len(good) - 1) / 2) / (len(good) * (len(got) - len(good)))
    assert area > 0.98


def test_quality_edges(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "one two three."), (3, "one two three."), (4, "x " * 200_000)]
    df = spark.createDataFrame([(i, t, "z", 0.5) for i, t in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (1, None), (3, 1)], "doc_id long, quality int")
    got = quality_trees.quality_scores(df, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows_out = got.collect()
    assert len(rows_out) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows_out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows_out)
    assert len({r.score for r in rows_out if r.doc_id == 3}) == 1 and len({r.score for r in rows_out if r.doc_id in (1, 2)}) == 1
    assert quality_trees.quality_scores(df.limit(0), labels.limit(0)).count() == 0


# hard negatives


def brute_negatives(rows, positives=5, negatives=10):
    kept = []
    for n, (i, e, label) in enumerate(rows):
        if i is None or label is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        kept.append((n, i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in e]))
    out = []
    for n, i, label, e in kept:
        if i % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(e, f, strict=False)), j, other) for m, j, other, f in kept if m != n), key=lambda s: s[:2])
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            found = [(s, k) for s, k, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(found, 1)]
    return sorted(out)


def vectors(rng, n, width, clusters):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(clusters)]
    return [[float(np.float32(c + rng.gauss(0, 0.4))) for c in rng.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize(("n", "width", "clusters", "ids"), [(700, 6, 5, 1), (400, 16, 1, 1), (60, 2, 2, 100)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, n, width, clusters, ids):
    for name, value in (("BLOCK", 32), ("CELLS", 500), ("PENDING", 64), ("SLICE_BYTES", 200)):
        monkeypatch.setattr(hn, name, value)
    rng = random.Random(n)
    rows = [(i * ids, e, rng.randrange(4)) for i, e in enumerate(vectors(rng, n, width, clusters))]
    rows[5], rows[6] = (rows[5][0], None, 1), (rows[6][0], [*rows[6][1][:-1], float("nan")], 1)
    rows[7], rows[8], rows[9] = (rows[7][0], rows[7][1], None), (None, rows[8][1], 2), (rows[9][0], [None, *rows[9][1][1:]], 1)
    rows[10] = (rows[10][0], [float("inf"), *rows[10][1][1:]], 1)
    rows += [(100, rows[20][1], 1), rows[30], rows[30], (rows[31][0], rows[30][1], rows[30][2]), (300, [0.0] * width, 3), (-200, rows[40][1], 0)]
    df = spark.createDataFrame([(i, e, label, "x", 1.0) for i, e, label in rows], "vec_id long, embedding array<float>, label int, key string, pivot double").repartition(3)
    got = sorted(map(tuple, hn.mine(df).collect()))
    assert got == brute_negatives(rows) and got


def test_hard_negatives_of_the_table(spark):
    d = "/root/testdata/sf0.01"
    path = f"{d}/embeddings.parquet"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(path).collect()]
    got = sorted(map(tuple, registered.op13_hard_negatives(spark, d).collect()))
    assert got == brute_negatives(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{path}'")
    assert sorted(con.sql(registered.SQL["op13_hard_negatives"]).fetchall()) == got


def test_hard_negatives_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hn.mine(spark.createDataFrame([], schema)).count() == 0
    assert hn.mine(spark.createDataFrame([(100, None, 1), (200, [1.0], None)], schema)).count() == 0
    assert hn.mine(spark.createDataFrame([(100, [], 1), (200, [], 1), (1, [], 2)], schema)).collect()[0][2:] == (1, 1, 0, 0)
    assert hn.mine(spark.createDataFrame([(100, [1.0, 2.0], 1)], schema)).count() == 0
    ragged = [(100, [1.0, 2.0], 1), (101, [2.0], 1), (102, [1.0], 2), (103, [0.5, 0.1], 3)]
    assert sorted(map(tuple, hn.mine(spark.createDataFrame(ragged, schema)).collect())) == brute_negatives([(i, [*e, 0.0][:2], x) for i, e, x in ragged])
    large = [(100, [3e5, 1.0], 1), (101, [2e5, 1.0], 1), (102, [1e5, 7.0], 2)]  # products beyond 2 ** 52
    assert sorted(map(tuple, hn.mine(spark.createDataFrame(large, schema)).collect())) == brute_negatives(large)
    with pytest.raises(ValueError, match="64 bits"):
        hn.mine(spark.createDataFrame([(100, [1e12], 1)], schema))


def test_rings_scan_fewer_blocks(spark, monkeypatch):
    """On clustered vectors the later rounds are mostly unread, and the result is that of a full scan."""
    monkeypatch.setattr(hn, "BLOCK", 64)
    rng = random.Random(2)
    rows = [(i, e, i % 3) for i, e in enumerate(vectors(rng, 3000, 8, 30))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    index = hn.build_index(df)
    assert index.rows.count() == 3000 and len(index.rings) == 3
    anchors = index.rows.where("vec_id % 100 = 0").select("rid", "vec", "label").orderBy("rid").toArrow()
    vec = hn._matrix(anchors["vec"].combine_chunks(), index.kind, index.width)
    s = hn.Search(anchors["rid"].to_numpy(), vec, anchors["label"].to_numpy(), True, np.full((len(vec), 1), -(2.0**63)), np.full((len(vec), 1), 2.0**63), 5)
    want = hn.search(index._replace(rings=[float("inf")]), s).orderBy("anchor", "rank").collect()
    assert hn.search(index, s).orderBy("anchor", "rank").collect() == want and len(want) == 5 * len(vec)
    table = index.rows.select("vec_id", "label", "pivot", "low", "high", "rid", "vec").toArrow()
    floor = np.array([[min(r.score for r in want if r.anchor == a)] for a in range(len(vec))], float)
    scanned = total = 0
    scan = hn.Scan(s._replace(floor=floor), (index.kind, index.width, index.norm, index.pivots), -1.0, float("inf"))
    low, pivot, high = table["low"].to_numpy(), table["pivot"].to_numpy(), table["high"].to_numpy()
    for a, b in hn._stretches(pivot, low, high):
        away = scan.away[:, pivot[a]]
        gap = np.maximum(0, np.maximum(low[a] - away, away - high[a]))
        total += len(vec)
        scanned += int(((scan.reach - gap**2) / 2 + scan.slack >= floor[:, 0]).sum())
    assert scanned < 0.6 * total


# samples, repeated ids


def test_samples_are_never_empty_nor_wide(spark):
    labels = spark.range(200_000).select((F.col("id") % 3).alias("doc_id"), (F.col("id") % 3 == 1).cast("int").alias("quality"))
    for limit in (1000, 20_000):
        assert shared.hash_sample(labels, "doc_id", limit).count() == 3
    many = spark.range(100_000).select("id", F.lit(1).alias("label"))
    got = shared.hash_sample(many.repartition(7), "id", 500)
    assert got.count() == 500 and set(map(tuple, got.collect())) == set(map(tuple, shared.hash_sample(many.orderBy(F.desc("id")), "id", 500).collect()))
    copies = spark.range(120_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("word "), (F.col("id") % 5).cast("string")).alias("text"))
    one = shared.labelled_texts(copies, spark.createDataFrame([(7, 1), (7, 0), (8, 1)], "doc_id long, quality int"), "doc_id", "text", "quality", 100)
    assert [tuple(r) for r in one.collect()] == [(7, 0, "word 0")]


def test_learning_from_repeated_ids(spark):
    """Many label rows of few ids still teach; copies of a labelled document do not widen what is learned from."""
    docs = spark.createDataFrame([(i, ("word %d and more of it here. " % i) * 3 if i % 2 else "## $$ ## $$ " * 30) for i in range(60)], "doc_id long, text string")
    labels = spark.range(60_000).select((F.col("id") % 60).alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), (1 - F.col("id") % 2).cast("int").alias("toxic"))
    assert quality_rules.train(docs, labels, sample=1000)
    assert len(quality_trees.train(docs, labels, sample=1000).feature) and len({round(r.score, 3) for r in quality_trees.quality_scores(docs, labels).collect()}) > 1
    assert toxicity.train(docs.withColumn("text", F.regexp_replace("text", r"## \$\$", "you foulword")), labels, sample=1000).weights


def test_pipeline_loses_no_text_on_repeated_ids(spark):
    import corpus_pipeline

    text = {x: " ".join(f"{x}{k}" for k in range(40)) for x in "abc"}
    rows = [(1, text["a"]), (2, text["a"]), (2, text["b"]), (3, text["b"] + " more"), (4, text["c"]), (4, text["c"]), (None, text["a"]), (None, None), (5, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=repr)
    assert got == sorted([(1, text["a"]), (2, text["b"]), (4, text["c"]), (None, None), (5, ""), (5, "")], key=repr)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.withColumn("row_", F.lit(1)), "").columns == [*docs.columns, "row_"]
