"""What queries shuffle, and how they answer where items or events are very frequent."""

import json
import os
import random
import time
from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from weftline.operators import detectors, tables
from weftline.operators import fulltext as ft
from weftline.operators import records as r
from weftline.operators import search as s
from weftline.plans.catalog import QUERIES, SQL
from weftline.sources import deliveries as dl


def shuffled_mb(spark, df):
    """The rows of a table, and the MB that its jobs write for shuffles."""

    def total():
        time.sleep(1)
        found = spark._jsc.sc().statusStore().executorList(True).iterator()
        out = 0
        while found.hasNext():
            out += found.next().totalShuffleWrite()
        return out / 1e6

    before = total()
    rows = df().collect()
    return rows, total() - before


def test_maximal_sets_of_frequent_items_build_no_pairs(spark):
    """all sets share items with all others."""
    rng = random.Random(2)
    sets = {i: frozenset(rng.sample(range(60), rng.randrange(8, 19))) for i in range(1300)}
    sets |= {i: frozenset(sorted(sets[i - 1300])[:9]) for i in range(1300, 1350)}
    members = spark.createDataFrame([(i, x) for i, v in sets.items() for x in v], "id long, item long")
    rows, mb = shuffled_mb(spark, lambda: tables.maximal_sets(members))
    want = {(i, len(v)) for i, v in sets.items() if not any(v < o or (v == o and k < i) for k, o in sets.items())}
    assert {(r.id, r.n) for r in rows} == want and mb < 1, mb


def test_maximal_sets_with_shared_bits_and_dealt_items(spark):
    """a larger set with the same bits is no superset; items of more than 4,096 sets are dealt."""
    bits = {}
    for r in spark.range(2000).select("id", F.pmod(F.xxhash64("id"), F.lit(256)).alias("b")).collect():
        bits.setdefault(r.b, []).append(r.id)
    a, b = next(v for v in bits.values() if len(v) > 1)[:2]
    sets = {1: {a, 5001}, 2: {a, 5001, 5002}, 3: {b, 5001, 5003}, 4: {a, 5004}, 5: {b, 5004, 5005}}
    rows = tables.maximal_sets(spark.createDataFrame([(i, x) for i, v in sets.items() for x in v], "id long, item long")).collect()
    assert {r.id for r in rows} == {2, 3, 4, 5}
    every = spark.range(1, 4501).select("id", F.explode(F.array(F.lit(7), F.col("id") + 10)).alias("item")).union(spark.createDataFrame([(9999, 7)], "id long, item long"))
    rows = tables.maximal_sets(every).collect()
    assert len(rows) == 4500 and all(r.n == 2 for r in rows)


def test_voting_pairs_carry_no_sets_of_chance_meetings(spark):
    """F2: all voters meet in some rare post; few pairs overlap by 0.8."""
    rng = random.Random(3)
    sets = {i: set(rng.sample(range(2000), 150)) for i in range(240)}
    for i in range(240, 250):
        sets[i] = set(sorted(sets[i - 240])[: 140 - i % 5 * 7]) | set(range(3000 + 20 * i, 3010 + 20 * i))
    votes = spark.createDataFrame([(i, x) for i, v in sets.items() for x in v], "voter long, post long")
    rows, mb = shuffled_mb(spark, lambda: detectors.voting_pairs(votes))
    want = {(a, b, c, len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and (c := len(sets[a] & sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b]))}
    assert {tuple(r) for r in rows} == want and len(want) > 4 and mb < 3, mb


def test_import_score_beyond_the_top(spark, tmp_path):
    """keys of 100,000 and more score above 1, as in the SQL."""
    part = spark.createDataFrame([(k, k % 50 + 1) for k in (1, 99999, 100057, 1200000)], "p_partkey long, p_size int")
    part.write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(SQL["import_score"]).fetchall()
    assert sorted(tuple(r) for r in QUERIES["import_score"](spark, str(tmp_path)).collect()) == sorted(want) and max(want)[1] > 1.2


def test_detectors_have_the_rows_of_their_first_sql(spark, tmp_path):
    """z above 1.5 and 2, shares above 0.2."""
    rows = [(u, "click", float(x), json.dumps({"k": k})) for u, (x, n) in enumerate(zip((0, 0, 1, 2, 2, 4), (1, 1, 1, 1, 1, 4))) for k in range(10, 10 + n)]
    events = spark.createDataFrame([(i, datetime(2024, 1, 1), *r) for i, r in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(s,) for s in "aabcd"], "c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {n: [tuple(r) for r in QUERIES[n](spark, str(tmp_path)).collect()] for n in ("velocity", "churn", "monoculture")}
    assert [r[0] for r in got["velocity"]] == [5] and 1.5 < got["velocity"][0][1] < 2
    assert [r[0] for r in got["churn"]] == [5] and 2 < got["churn"][0][1] < 3
    assert got["monoculture"] == [("a", 2, 0.4, "medium")]


def test_terms_in_texts_equal_the_tokens(spark):
    """no pattern per term; the same words as the token arrays."""
    rng = random.Random(5)
    texts = ["", " ", "the", "the the,the", "The-and.that", "thé the\x85and that", "other and that the_x", None] + [" ".join(rng.choice(["the", "and", "that", "x;", "\tthe\n", "it's"]) for _ in range(rng.randrange(12))) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for terms in (["the", "and", "that"], ["the"], ["th", "an"]):
        has, w = s.text_has(F.col("t"), terms), s.tokens(F.col("t"))
        both = df.select(has.alias("a"), s.matches_all(w, terms).alias("b"), s.text_has(F.col("t"), terms, whole=False).alias("c"), s.matches_prefixes(w, terms).alias("d"), s.text_rank(F.col("t"), terms).alias("e"), s.frequency_rank(w, terms).alias("f")).collect()
        assert all((x.a, x.c, x.e) == (x.b, x.d, x.f) for x in both)
        assert str(has).lower().count("rlike") == 0


def test_words_of_all_texts_are_not_shuffled(spark):
    """the words of a query are known before texts are joined with them."""
    docs = spark.createDataFrame([(i, "licensed under a version " + "word " * 50) for i in range(50)], "doc_id long, text string")
    found = ft.search(docs, ft.parse("licensing & version"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 50 and "hashpartitioning(word" not in plan and "BroadcastHashJoin" in plan


def test_first_paragraph_splits_once(spark):
    """the lines of a readme are computed once for the paragraph."""
    assert str(r.first_paragraph(F.col("t"))).count("split(") == 1


def test_deliveries_leave_a_file_a_task(spark, tmp_path):
    """marks are lines of one file a task, and a second run sends nothing again."""
    events = spark.createDataFrame([(i, "x", f"{i:04d}", "{}") for i in range(200)], "event_id long, event_type string, at string, payload string")
    subs = spark.createDataFrame([("a", "http://a", "k", ["x"])], "subscription string, address string, signing_key string, event_types array<string>")
    run = lambda n: dl.send_events(events, subs, f"{tmp_path}/d", n, "weftline.sources.deliveries:accept").groupBy("status").count().collect()
    assert [tuple(x) for x in run("run-1")] == [(204, 200)] and [tuple(x) for x in run("run-2")] == [(0, 200)]
    assert sum(len(files) for _, _, files in os.walk(f"{tmp_path}/d/marks")) <= 4
