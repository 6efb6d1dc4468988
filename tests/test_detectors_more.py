"""Voting rings, the alert ledger and exact percentiles against loops."""

import collections
import json
import random
import statistics
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import alerts as al
from weftline.operators import detectors as det
from weftline.operators.selection import exact_percentile

DAY = 86_400_000_000


def rings(votes, now, days, overlap, least):
    n, total = collections.Counter(), collections.Counter()
    for voter, author, direction, us in votes:
        if direction == "up" and us >= now - days * DAY and voter != author:
            n[voter, author] += 1
            total[voter] += 1
    pairs = [(a, b) for a, b in n if a < b and min(n[a, b], n[b, a]) >= least and n[a, b] >= overlap * total[a] and n[b, a] >= overlap * total[b]]
    home = {v: v for p in pairs for v in p}
    for _ in pairs:
        for a, b in pairs:
            home[a] = home[b] = min(home[a], home[b])
    size = collections.Counter(home.values())
    return sorted((home[a], size[home[a]], "high" if size[home[a]] >= 3 else "medium", a, b, n[a, b], n[b, a], round(n[a, b] / total[a], 4), round(n[b, a] / total[b], 4)) for a, b in pairs)


@pytest.mark.parametrize(("overlap", "least"), [(0.8, 5), (0.3, 3)])
def test_voting_rings(spark, overlap, least):
    rng, now, votes = random.Random(6), 100 * DAY, []
    partner = {1: (2,), 2: (1,), 3: (4, 5), 4: (3, 5), 5: (3, 4), 6: (7,), 7: (8,), 8: (7,), 9: (9,), 10: (11,), 11: (10,)}
    for v in range(1, 40):
        for k in range(rng.randrange(4, 30)):
            author = rng.choice(partner.get(v, (rng.randrange(40),))) if rng.random() < 0.93 else rng.randrange(40)
            votes.append((v, author, "down" if rng.random() < 0.05 else "up", now - rng.randrange(40 if k % 5 else 60) * DAY))
    votes += [(50, 51, "up", now - 30 * DAY)] * 5 + [(51, 50, "up", now - 30 * DAY)] * 4 + [(51, 50, "up", now - 30 * DAY - 1)]
    df = spark.createDataFrame(votes, "voter long, author long, direction string, us long")
    got = det.voting_rings(df, F.lit(now), overlap=overlap, least=least)
    want = rings(votes, now, 30, overlap, least)
    assert sorted(map(tuple, got.collect())) == want and want
    assert overlap > 0.5 or any(w[2] == "high" for w in want)
    assert det.voting_rings(df.limit(0), F.lit(now)).count() == 0


def test_alerts_over_three_runs(spark, tmp_path):
    ledger = al.AlertLedger(spark, f"file://{tmp_path}/{uuid.uuid4().hex}")
    snapshots = [[("x", 90), ("y", 10)], [("x", 95), ("y", 5)], [("x", 71), (None, 29)]]
    floods = [{"op1": 11, "op2": 10}, {"op2": 20}, {"op3": 20, "op1": 12}]
    want, opened = [], {}
    for run, (labels, flood) in enumerate(zip(snapshots, floods, strict=True)):
        now = 1000 + run
        rows = spark.createDataFrame([(f,) for f, n in labels for _ in range(n)], "framework string")
        born = spark.createDataFrame([(o, 10 * DAY) for o, n in flood.items() for _ in range(n)] + [("op9", 0)] * 50 + [(None, 10 * DAY)] * 50, "operator string, us long")
        found = al.monoculture_alerts(rows, "framework").unionByName(al.flood_alerts(born, "operator", "us", F.lit(10 * DAY)))
        added = ledger.report(found, now).collect()
        total = sum(n for _, n in labels)
        expect = [("framework_monoculture", "high" if n / total >= 0.85 else "medium", f or "unknown") for f, n in labels if n / total > 0.7]
        expect += [("operator_flood", "high" if n >= 20 else "medium", o) for o, n in flood.items() if n > 10]
        expect = [e for e in expect if not opened.get(e[0])]
        assert sorted((r.alert_type, r.severity, r.subject) for r in added) == sorted(expect)
        assert ledger.report(found, now).count() == len(expect)  # the same run again adds nothing
        for kind, severity, subject in expect:
            opened[kind] = True
            want.append([kind, severity, subject, now, None])
        if run == 1:  # someone settles the floods
            ledger.resolve(F.col("alert_type") == "operator_flood", now)
            opened["operator_flood"] = False
            for w in want:
                if w[0] == "operator_flood":
                    w[4] = now
    got = sorted([r.alert_type, r.severity, r.subject, r.opened, r.resolved] for r in ledger.read().collect())
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == 4
    details = json.loads(ledger.read().where("alert_type = 'framework_monoculture'").first().details)
    assert details == {"framework": "x", "agent_count": 90, "total_agents": 100, "share": 0.9, "threshold": 0.7}


@pytest.mark.parametrize("p", [0.5, 0.9])
def test_exact_percentile(spark, p):
    rng = np.random.default_rng(3)
    groups = {"hot": rng.normal(size=6001) * 1e6, "even": rng.integers(0, 50, 4000) / 7, "one": np.array([3.25]), "same": np.full(500, -2.5), "two": np.array([-1e300, 1e300]), None: rng.exponential(size=777) ** 9, "heavy": np.concatenate([np.full(3000, 1.0), [1e18, -1e18, 5e-324]])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("none", None), ("none", float("nan")), ("one", None)]
    df = spark.createDataFrame(rows, "key string, v double").repartition(4)
    got = {r.key: r.percentile for r in exact_percentile(df, ["key"], "v", p, bins=16, few=100).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k] == pytest.approx(float(np.quantile(v, p)), rel=1e-12, abs=1e-300), k
    whole = exact_percentile(df.where("v < 1e9 and v > -1e9"), [], "v", p, bins=16, few=50).collect()
    assert len(whole) == 1 and whole[0].percentile == pytest.approx(float(np.quantile([x for _, x in rows if x is not None and -1e9 < x < 1e9], p)), rel=1e-12)
    assert exact_percentile(df.limit(0), ["key"], "v", p).count() == exact_percentile(df.limit(0), [], "v", p).count() == 0
    assert p != 0.5 or got["even"] == statistics.median(groups["even"])


def test_trust_inputs_by_hand(spark):
    from weftline.operators import trust

    now = 200 * DAY
    rows = [(1, 7, 1, "code", 0.8, now), (2, 8, 1, "data", None, now - 100 * DAY), (3, 9, 1, None, 0.4, now - 190 * DAY)] + [(10 + i, 7, 2, "code", 1.0, now) for i in range(12)]
    a = spark.createDataFrame(rows, "event_id long, attester long, target long, context string, weight double, us long")
    got = {r.target: (r.community, r.contexts) for r in trust.community(a, F.lit(now), boost="code").collect()}
    assert got[1][0] == pytest.approx((0.8 * 1.5 + 0.25 + 0.1) / 3) and got[1][1] == {"code": 0.8, "data": 0.25} and got[2] == (1.0, {"code": 1.0})
    plain = {r.target: r.community for r in trust.community(a, F.lit(now)).collect()}
    assert plain[1] == pytest.approx((0.8 + 0.25 + 0.1) / 3)
    e = spark.createDataFrame([(1, 0.3, True, 0.9), (2, None, True, 0.5), (3, None, True, None), (4, None, False, 0.5)], "id long, linked double, verified boolean, signals double")
    assert [r[0] for r in e.orderBy("id").select(trust.external(F.col("linked"), F.col("verified"), F.col("signals"))).collect()] == [0.3, pytest.approx(0.35), 0.6, 0.0]
    assert e.where("id = 2").select(trust.with_chain(F.col("signals"), F.lit(0.7)), trust.with_chain(F.col("signals"), F.lit(None).cast("double"))).first()[:] == (0.7, 0.5)
    acts = spark.createDataFrame([(1, now)] * 9 + [(1, now - 31 * DAY), (2, now - 30 * DAY)] + [(3, now)] * 200, "id long, us long")
    assert {r.id: round(r.activity, 6) for r in trust.recent_activity(acts, F.lit(now)).collect()} == {1: round(float(np.log(10) / np.log(100)), 6), 2: round(float(np.log(2) / np.log(100)), 6), 3: 1.0}
    c = spark.createDataFrame([(1, 0.2, 0.5, None, 0.9, True), (2, 0.6, 0.1, 0.3, 0.2, True), (3, 0.6, 0.3, 0.3, 0.3, False)], "id long, verification double, activity double, community double, reputation double, agent boolean")
    said = {(r.id, r.component, r.potential_gain) for r in trust.suggestions(c, F.col("agent")).collect()}
    assert said == {(1, "verification", 0.105), (1, "community", 0.06), (2, "verification", 0.07), (2, "activity", 0.06), (2, "reputation", 0.045)}
