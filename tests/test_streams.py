"""Streams over several files in any order, stopped and taken up again; cliques, sets and searches against brute force."""

import itertools
import random
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.operators import graph as g
from weftline.operators import search as s
from weftline.operators.detectors import reciprocity
from weftline.operators.tables import maximal_sets
from weftline.sources.folders import shared_folder
from weftline.streaming import streams as st

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def rows(first, last):
    return [(i, datetime(2024, 1, 1) + timedelta(hours=3 * i), i % 7, "error") for i in range(first, last)]


def test_once_keeps_late_rows_and_drops_repeats(spark, tmp_path):
    path = f"{tmp_path}/events"
    for first in (250, 200, 150, 100, 50, 0):  # newest first, each file far behind the one before
        write(spark, path, rows(first, first + 60))
    got = st.run_append(st.once(st.read_events(spark, path), "event_id").select("event_id"), spark)
    assert sorted(r.event_id for r in got.collect()) == list(range(310))


def test_a_stopped_stream_goes_on(spark, tmp_path):
    path, out, state = (f"{tmp_path}/{x}" for x in ("events", "out", "state"))
    write(spark, path, rows(0, 30))
    run = lambda: st.run_append(st.once(st.read_events(spark, path), "event_id").select("event_id"), spark, out, state)
    assert run().count() == 30
    write(spark, path, rows(20, 50))
    assert sorted(r.event_id for r in run().collect()) == list(range(50))
    assert run().count() == 50


def test_the_newest_rows_survive_a_restart(spark, tmp_path):
    path, root, state = (f"{tmp_path}/{x}" for x in ("events", "top", "state"))
    run = lambda: sorted(r.event_id for r in st.run_top(st.read_events(spark, path).select("event_id", "user_id"), spark, "event_id", "event_id", 15, root, state).collect())
    write(spark, path, rows(40, 60))
    assert run() == list(range(45, 60))
    write(spark, path, rows(0, 50))
    write(spark, path, rows(55, 63))
    assert run() == list(range(48, 63)) and run() == list(range(48, 63))
    assert len(st._versions(spark, root)) <= 2


def test_updated_counts_over_restarts(spark, tmp_path):
    path, root, state = (f"{tmp_path}/{x}" for x in ("events", "updates", "state"))

    def run():
        e = st.read_events(spark, path)
        counts = e.groupBy("user_id", F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last")).select("user_id", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", "last")
        return sorted(map(tuple, st.run_update(counts, spark, ["user_id", "day"], root, state).collect()))

    def want(all_rows):
        seen = {}
        for i, ts, user, _ in all_rows:
            n, last = seen.get((user, f"{ts:%Y-%m-%d}"), (0, -1))
            seen[user, f"{ts:%Y-%m-%d}"] = (n + 1, max(last, i))
        return sorted((u, d, n, last) for (u, d), (n, last) in seen.items())

    write(spark, path, rows(100, 150))
    write(spark, path, rows(40, 90))
    assert run() == want(rows(100, 150) + rows(40, 90))
    write(spark, path, rows(0, 110))  # late rows and new versions of counted windows
    assert run() == want(rows(100, 150) + rows(40, 90) + rows(0, 110)) and run() == run()


def brute_cliques(edges, n):
    near = {frozenset(e) for e in edges}
    full = [set(c) for k in range(3, 8) for c in itertools.combinations(range(n), k) if all(frozenset(p) in near for p in itertools.combinations(c, 2))]
    return {tuple(sorted(c)) for c in full if not any(c < o for o in full)}


@pytest.mark.parametrize("seed", [1, 2])
def test_all_maximal_cliques(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b) for a, b in itertools.combinations(range(16), 2) if rng.random() < 0.45]
    edges += [(100 + i, 101 + i) for i in range(80)]  # a long chain: no clique, and no limit on the component
    edges += [(15, 100), (180, 181), (180, 182), (181, 182), (3, 3)]
    got = [tuple(r.members) for r in g.cliques(spark.createDataFrame(edges, "src long, dst long")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_cliques([e for e in edges if e[0] < 16 and e[1] < 16], 16) | {(180, 181, 182)}
    assert g.cliques(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_reciprocity_and_maximal_sets(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(70)]
    own = {(a, b) for a, b in edges if a != b}
    want = {t: (sum(b == t for _, b in own), sum(b == t and (t, a) in own for a, b in own)) for t in {b for _, b in own}}
    got = reciprocity(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.id: (r.attesters, r.back) for r in got} == want
    sets = {i: frozenset(rng.sample(range(9), rng.randrange(1, 6))) for i in range(60)}
    want = {i for i, x in sets.items() if not any(x < y or (x == y and j < i) for j, y in sets.items())}
    got = maximal_sets(spark.createDataFrame([(i, x) for i, v in sets.items() for x in v], "id long, item long")).collect()
    assert {r.id for r in got} == want and all(r.n == len(sets[r.id]) for r in got)


def test_text_search_equals_token_search(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["the", "The", "and", "an", " ", "-", "é", "x", "9", "\n"]) for _ in range(rng.randrange(12))) for _ in range(400)] + [None, "", "the and"]
    words = s.tokens(F.col("t"))
    both = spark.createDataFrame([(t,) for t in texts], "t string").select(
        s.matches_all(words, ["the", "and"]).eqNullSafe(s.text_has(F.col("t"), ["the", "and"])), s.matches_prefixes(words, ["th", "an"]).eqNullSafe(s.text_has(F.col("t"), ["th", "an"], whole=False)),
        s.frequency_rank(words, ["the", "and"]).eqNullSafe(s.text_rank(F.col("t"), ["the", "and"])),
    )
    assert all(all(r) for r in both.collect())


def test_shared_folder_is_required_on_a_cluster(spark):
    class Conf:
        get = staticmethod(lambda key, default: None)

    class Session:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session)
    Session.sparkContext = type("C", (), {"master": "local[2]"})
    assert shared_folder(Session).startswith("file://")


def test_entry_without_the_optional_part():
    code = "import sys; sys.modules['ahocorasick'] = None; sys.modules['weftline.llm.queries'] = None\nimport __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(k.startswith('op') and k[2].isdigit() for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True)
