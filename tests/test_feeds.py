"""Feeds by precedence, settled versions, stances, lanes priced on the same draws, and the regression of scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import feeds, simulation, strengths

OFFICIAL, INJURIES, LINEUPS = "code int, status string, chance double", "code int, injury_type string, return_slot int, pct double, source string", "code int, p_start_hint double"


def merged(spark, official, injuries, lineups=()):
    frames = (spark.createDataFrame(list(r), s) for r, s in ((official, OFFICIAL), (injuries, INJURIES), (lineups, LINEUPS)))
    return {r.code: tuple(r)[1:] for r in feeds.merged_availability(*frames, 6).collect()}


def test_news_only_lowers_and_never_touches_a_settled_status(spark):
    official = [(1, "s", None), (2, "a", None), (3, "d", 25.0), (4, "a", None), (5, None, None), (6, "i", 75.0), (7, "a", None), (7, "a", None), (None, "a", 1.0)]
    injuries = [(1, "knee", 9, 0.0, "x"), (2, "knee", 9, None, "x"), (3, "knee", 6, None, "x"), (4, "knee", 5, 0.0, "x"), (5, "knee", None, None, "x"), (6, "knee", 4, None, "x"), (6, "knee", 6, 10.0, "x"), (9, "knee", 9, None, "x")]
    got = merged(spark, official, injuries, [(1, 0.9), (4, 0.2), (2, 0.1)])
    assert got == {
        1: ("s", None, None, None, None, None), 2: ("i", 0.0, "knee", 9, 0.1, "x"), 3: ("d", 25.0, "knee", 6, None, "x"), 4: ("a", None, None, None, 0.2, "lineups"),
        5: (None, None, "knee", None, None, "x"), 6: ("i", 75.0, None, None, None, None), 7: ("a", None, None, None, None, None),
    }
    assert merged(spark, official[:2], []) == {1: ("s",) + (None,) * 5, 2: ("a",) + (None,) * 5} and merged(spark, [], injuries) == {}


def test_superseded_leaves_ungraded_and_missing_versions_alone(spark):
    versions = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1), ("c", 2)], "k string, stamp int")
    grades = spark.createDataFrame([("a", 2), ("c", 9)], "k string, stamp int")
    assert sorted(tuple(r) for r in feeds.superseded(versions, grades, ["k"], "stamp").collect()) == [("a", 1), ("a", 3)]


def test_strategy_looks_at_the_leader_or_the_nearest(spark):
    totals = {"behind": [(1, 100, 10.0), (2, 130, 10.0), (3, 130, 5.0)], "ahead": [(1, 100, 10.0), (2, 90, 1.0), (3, 40, 100.0)], "level": [(1, 100, 10.0), (2, 99, 10.0)], "alone": [(1, 5, 1.0)], "strangers": [(2, 5, 1.0)]}
    df = spark.createDataFrame([(g, *r) for g, rs in totals.items() for r in rs], "g string, e int, t int, s double")
    got = {r.g: r for r in feeds.strategy(df, "g", "e", "t", F.col("e") == 1, "s", 4, 0.5, 1.0, 0.25).collect()}
    assert set(got) == {"behind", "ahead", "level"}
    assert (got["behind"].rival, got["behind"].gap, got["behind"].z, got["behind"].stance) == (2, 30, 1.5, "chase") and got["behind"].dial == pytest.approx(0.5 * math.tanh(1.5))
    assert (got["ahead"].rival, got["ahead"].z, got["ahead"].stance) == (3, -0.3, "defend")
    assert (got["level"].z, got["level"].dial, got["level"].stance) == (0.0, 0.0, "neutral")


def test_lanes_are_priced_on_the_same_draws(spark):
    df = spark.createDataFrame([(1, e, 5.0 if e == 1 else 4.0, 2.0) for e in range(1, 6)] + [(2, 1, 1.0, 0.0), (2, 2, 2.0, 0.0), (3, 1, 1.0, 1.0)], "g int, e int, m double, s double")
    lanes = {"same": F.col("m"), "better": F.col("m") + 3, "worse": F.col("m") - 3}
    got = {(r.g, r.lane): r.gain for r in simulation.lane_gains(df, "g", "e", F.col("e") == 1, "m", "s", lanes, 200).collect()}
    assert set(got) == {(g, lane) for g in (1, 2) for lane in lanes}
    assert got[1, "same"] == 0 and got[1, "better"] < 0 < got[1, "worse"]
    assert (got[2, "same"], got[2, "better"], got[2, "worse"]) == (0, -100, 0)


def test_score_model_finds_the_strengths_it_was_drawn_from(spark):
    rng = np.random.default_rng(5)
    attack, defence = np.linspace(-0.5, 0.5, 6), np.linspace(0.3, -0.3, 6)[[2, 0, 4, 1, 5, 3]]
    rows = []
    for k in range(3000):
        h, a = rng.choice(6, 2, replace=False)
        rows.append((int(h), int(a), int(rng.poisson(math.exp(attack[h] + defence[a] + 0.3))), int(rng.poisson(math.exp(attack[a] + defence[h]))), f"2024-01-{k % 28 + 1:02d}"))
    df = spark.createDataFrame(rows + [(0, 1, None, 99, "2024-01-01"), (0, 1, 99, 99, None)], "h int, a int, x int, y int, day string")
    got = {int(r.team): r for r in strengths.strengths(strengths.pair_sums(df.withColumn("g", F.lit(1)), ["g"], "h", "a", "x", "y", "day"), ["g"]).collect()}
    edge, rho = got[0].edge, got[0].rho
    assert len(got) == 6 and edge == pytest.approx(0.3, abs=0.08) and abs(rho) < 0.08
    assert sum(r.attack for r in got.values()) == pytest.approx(0, abs=1e-9)
    assert all(got[t].attack == pytest.approx(attack[t], abs=0.1) and got[t].defence == pytest.approx(defence[t], abs=0.12) for t in got)


def test_strengths_are_the_likeliest():
    """No small step of any part makes the pairs' scores likelier, nor does a search from other starts; low scores are frequent enough to matter."""
    rng = np.random.default_rng(8)
    n, rows = 5, []
    for _ in range(900):
        h, a = rng.choice(n, 2, replace=False)
        x, y = rng.poisson(1.1), rng.poisson(0.8)
        rows.append((h, a, 1, 1) if x + y == 1 and rng.random() < 0.15 else (h, a, x, y))
    pairs = sorted({(h, a) for h, a, *_ in rows})
    at = {p: k for k, p in enumerate(pairs)}
    sums = {c: np.zeros(len(pairs)) for c in strengths.SUMS}
    for h, a, x, y in rows:
        k = at[h, a]
        sums["w"][k] += 1
        sums["hg"][k] += x
        sums["ag"][k] += y
        if x <= 1 and y <= 1:
            sums[f"w{x}{y}"][k] += 1
    h, a = (np.array(c) for c in zip(*pairs))
    attack, defence, edge, rho = strengths.fitted(h, a, sums, n)

    def likelihood(v):
        at_, df, e, r = v[:n], v[n : 2 * n], v[2 * n], v[2 * n + 1]
        lam, mu = np.exp(at_[h] + df[a] + e), np.exp(at_[a] + df[h])
        low = sums["w00"] * np.log(1 - lam * mu * r) + sums["w01"] * np.log(1 + lam * r) + sums["w10"] * np.log(1 + mu * r) + sums["w11"] * np.log(1 - r)
        return (sums["hg"] * np.log(lam) + sums["ag"] * np.log(mu) - sums["w"] * (lam + mu) + low).sum()

    found = np.concatenate([attack, defence, [edge, rho]])
    best = likelihood(found)
    assert abs(rho) > 0.05 and abs(attack.mean()) < 1e-9
    for k in range(len(found)):
        for step in (-1e-3, 1e-3):
            moved = found.copy()
            moved[k] += step
            assert likelihood(moved) < best
    for _ in range(300):
        assert likelihood(found + rng.normal(0, 0.02, len(found))) < best


def test_walk_forward_equals_refits_from_scratch(spark):
    rng, rows = np.random.default_rng(3), []
    for k in range(400):
        h, a = rng.choice(6 if k < 300 else 7, 2, replace=False)  # a seventh team comes late
        rows.append((k, "xy"[k % 2], int(h), int(a), int(rng.poisson(1.4)), int(rng.poisson(1.1)), k // 100, f"2024-{k // 100 + 1:02d}-{k % 28 + 1:02d}"))
    rows.append((400, "x", 1, 2, None, 1, 3, "2024-04-01"))
    df = spark.createDataFrame(rows, "i int, g string, h int, a int, x int, y int, fold int, day string")
    got = {r.i: r for r in strengths.walk_forward(df, ["g"], "fold", "h", "a", "x", "y", "day").collect()}
    assert len(got) == 401 and all((r.lam is None) == (r.fold == 0) for r in got.values())
    for fold in (1, 2, 3):
        before = strengths.pair_sums(df.where(F.col("fold") < fold), ["g"], "h", "a", "x", "y", "day")
        found = strengths.strengths(before, ["g"])
        for r in strengths.expected(df.where(F.col("fold") == fold), found, ["g"], "h", "a").collect():
            assert got[r.i].lam == pytest.approx(r.lam, rel=1e-6) and got[r.i].mu == pytest.approx(r.mu, rel=1e-6)
            assert got[r.i].home_clean == pytest.approx(math.exp(-r.mu), rel=1e-6)
    late = [r for r in got.values() if r.fold == 3 and 6 in (r.h, r.a)]
    assert late and all(r.lam > 0 for r in late)
    assert strengths.walk_forward(df.where("false"), ["g"], "fold", "h", "a", "x", "y", "day").count() == 0
