"""Whole-table graph and overlap queries against brute force, over small tables made by hand."""

import itertools
import json
import random
from datetime import datetime

import pytest

from weftline.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, d = random.Random(4), str(tmp_path_factory.mktemp("whole"))
    events = [(i, datetime(2024, 1, 1), rng.randrange(70), rng.choice(["purchase", "click"]), float(rng.randrange(100)), json.dumps({"k": rng.randrange(70)})) for i in range(600)]
    items = [(s, 100 * (s // 3) + p, float(rng.randrange(1, 51)), 0.01, 0.02) for s in range(12) for p in range(20) if rng.random() < 0.95]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    spark.createDataFrame(items, "l_suppkey long, l_partkey long, l_quantity double, l_discount double, l_tax double").write.parquet(f"{d}/lineitem.parquet")
    edges = lambda kind: {(u, k) for _, _, u, t, _, p in events if t == kind and (k := json.loads(p)["k"]) != u}
    return d, edges("click"), edges("purchase"), items


def distances(edges, start, depth):
    far, front = {start: 0}, {start}
    for hop in range(1, depth + 1):
        front = {b for a, b in edges if a in front} - set(far)
        far.update(dict.fromkeys(front, hop))
    return far


def test_triangles(spark, tables):
    d, clicks, _, _ = tables
    near = {frozenset(e) for e in clicks}
    want = {t for t in itertools.combinations(range(70), 3) if all(frozenset(p) in near for p in itertools.combinations(t, 2))}
    got = [tuple(r) for r in QUERIES["triangles"](spark, d).collect()]
    assert sorted(got) == sorted(want) and want


def test_paths(spark, tables):
    d, _, bought, _ = tables
    assert {(r.id, r.hops) for r in QUERIES["reachable"](spark, d).collect()} == set(distances(bought, 9, 4).items())
    far = distances(bought, 9, 6)
    at = max(far, key=lambda v: (far[v], v))
    want = [(far[at], at)]
    while far[at]:
        at = min(a for a, b in bought if b == at and far.get(a) == far[at] - 1)
        want.append((far[at], at))
    assert sorted(tuple(r) for r in QUERIES["shortest_path"](spark, d).collect()) == sorted(want)


def test_components(spark, tables):
    d, _, _, items = tables
    label = {}
    for s, p, *_ in items:
        label[s] = label[1000000 + p] = s // 3 * 3
    assert {(r.id, r.component) for r in QUERIES["connected_components"](spark, d).collect()} == set(label.items())


def test_voting_overlap(spark, tables):
    d, _, _, items = tables
    sets = {s: {x[1] for x in items if x[0] == s} for s in range(12)}
    want = {(a, b, c, len(sets[a]), len(sets[b])) for a, b in itertools.combinations(range(12), 2) if (c := len(sets[a] & sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b]))}
    assert {tuple(r) for r in QUERIES["voting_overlap"](spark, d).collect()} == want and want
