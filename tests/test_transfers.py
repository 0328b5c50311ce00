"""Transfer plans against an exhaustive search, ledgers and chip schedules against plain folds."""

import itertools
import math
import random
from dataclasses import replace

import pytest

from tidemark.operators import ledger, policy, selection
from tidemark.operators.selection import Terms

PLAYERS = "squad long, code long, kind string, club string, cost long, sell long, owned boolean, locked boolean, ep array<double>"
KINDS = ("GKP", "DEF", "MID", "FWD")
LEAST, MOST = (1, 3, 2, 1), (1, 5, 5, 3)


def worth(squad, week, t):
    """By trying every eleven."""
    best = None
    e = lambda p: max(p[8][week] or 0.0, 0.0)
    for xi in itertools.combinations(squad, 11):
        counts = [sum(p[2] == k for p in xi) for k in KINDS]
        if all(a <= n <= b for a, n, b in zip(LEAST, counts, MOST)):
            two = sorted(map(e, xi), reverse=True)[:2]
            v = sum(map(e, xi)) * (1 - t.bench) + t.bench * sum(map(e, squad)) + two[0] + t.deputy * two[1]
            best = v if best is None else max(best, v)
    return best


def every_plan(players, bank, free, t):
    """(objective, moves) of all legal plans."""
    by = {p[1]: p for p in players}
    start = frozenset(p[1] for p in players if p[6])
    memo = {}

    def value(have, week):
        if (have, week) not in memo:
            memo[have, week] = worth([by[c] for c in sorted(have)], week, t)
        return memo[have, week]

    def follow(have, bank, free, week, total, moves):
        if week == t.weeks:
            yield total + t.free_value * free + t.bank_value / 10 * bank, moves
            return
        outside = set(by) - have
        for n in range(t.most_moves + 1):
            for outs in itertools.combinations(sorted(have), n):
                for ins in itertools.combinations(sorted(outside), n):
                    if sorted(by[c][2] for c in outs) != sorted(by[c][2] for c in ins) or any(by[c][7] for c in outs + ins):
                        continue
                    now = have - set(outs) | set(ins)
                    money = bank + sum(by[c][5] for c in outs) - sum(by[c][4] for c in ins)
                    clubs = [by[c][3] for c in now]
                    if n and (money < 0 or max(map(clubs.count, clubs)) > t.club_limit):
                        continue
                    hits = max(0, n - free)
                    told = sorted([f"{week} in {c}" for c in ins] + [f"{week} out {c}" for c in outs])
                    yield from follow(now, money, min(max(free - n, 0) + 1, t.most_free), week + 1, total + t.decay**week * (value(now, week) - t.hit * hits), moves + told)

    yield from follow(start, bank, free, 0, 0.0, [])


def made_up(rng, squad, outside, weeks):
    rows = []
    for i, kind in enumerate(["GKP"] * 2 + ["DEF"] * 5 + ["MID"] * 5 + ["FWD"] * 3 + outside):
        price = rng.randint(40, 70)
        ep = [round(rng.uniform(0, 9 if i < 15 else 14), 2) for _ in range(weeks)]
        if i == 1:
            ep = [e + 9 for e in ep]  # a second keeper whom only the other keeps from the armband
        rows.append((squad, squad * 100 + i, kind, rng.choice("abcde"), price, price - rng.randint(0, 2), i < 15, rng.random() < 0.1, ep))
    return rows


@pytest.mark.parametrize("terms, outside", [(Terms(weeks=2), ["MID", "FWD", "GKP"]), (Terms(weeks=3, most_moves=1, hit=1.0), ["DEF", "DEF", "MID"])])
def test_plans_are_the_best_of_all(spark, terms, outside):
    rng = random.Random(5)
    terms = replace(terms, club_limit=5)
    rows = {s: made_up(rng, s, outside, terms.weeks) for s in range(3)}
    state = [(0, 3, 1), (1, 25, 2), (2, 0, 0)]
    players = spark.createDataFrame([r for rs in rows.values() for r in rs], PLAYERS)
    states = spark.createDataFrame(state, "squad long, bank long, free int")
    found = {}
    for r in selection.alternatives(players, states, "squad", terms).collect():
        found[r.squad, r.place] = (r.objective, r.moves)
    for squad, bank, free in state:
        plans = sorted((round(-v, 6), len(m), m) for v, m in every_plan(rows[squad], bank, free, terms))
        cuts = []
        for place in (1, 2, 3):
            best = next((p for p in plans if not any(set(c) <= set(p[2]) if c else not p[2] for c in cuts)), None)
            if best is None:
                assert (squad, place) not in found
                break
            assert found[squad, place][1] == best[2] and found[squad, place][0] == pytest.approx(-best[0], abs=2e-6)
            cuts.append(best[2])


def test_squads_that_cannot_play(spark):
    rows = [r for r in made_up(random.Random(1), 7, [], 3) if r[2] != "GKP"]
    players = spark.createDataFrame(rows, PLAYERS)
    states = spark.createDataFrame([(7, 0, 1), (8, 0, 1)], "squad long, bank long, free int")
    assert selection.best_plans(players, states, "squad").count() == 0
    assert selection.best_plans(players.where("false"), states, "squad").count() == 0


def test_ledger_carries_money_and_moves(spark):
    p = ledger.Prices(weeks=3, decay=0.5)
    players = [(1, 10 + i, "DEF" if i % 2 else "MID", "c", 50 + i, 49 + i, i < 4, False, [1.0 * i, 2.0, 3.0]) for i in range(6)]
    moves = [(1, 0, "in", 15), (1, 0, "out", 11), (1, 0, "in", 14), (1, 0, "out", 12), (1, 1, "out", 11), (1, 1, "in", 99), (1, 2, "out", 15), (1, 2, "in", 11), (1, 5, "in", 12), (1, 5, "out", 14)]
    df = lambda rows, shape: spark.createDataFrame(rows, shape)
    args = (df(moves, "squad long, week int, side string, code long"), df(players, PLAYERS), df([(1, 1, 1), (2, 7, 0)], "squad long, bank long, free int"), "squad", p)
    got = {(r.squad, r.week): r for r in ledger.ledger(*args).collect()}
    one, two, three = (got[1, w] for w in range(3))
    assert (one.moves, one.hits, one.used, one.free, one.bank) == (2, 1, 1, 1, 1 + 50 + 51 - 55 - 54) and one.faults == "money below 0" and one.gain == pytest.approx(4 + 2)
    assert (two.moves, two.free, two.gain, two.faults) == (0, 2, None, "11 not there to sell; 99 not to be bought; money below 0") and two.charge == 0
    assert (three.moves, three.hits, three.free, three.bank) == (1, 0, 2, one.bank + 54 - 51) and three.charge is None and three.note == "no chances of a fall given"
    assert three.bank_value == pytest.approx(0.008 * three.bank) and one.bank_value is None
    assert [(got[2, w].free, got[2, w].gain, got[2, w].moves) for w in range(3)] == [(1, 0.0, 0), (2, 0.0, 0), (3, 0.0, 0)]
    falls = df([(1, 15, 0.5)], "squad long, code long, chance double")
    wild = df([(1, 0, "wildcard")], "squad long, week int, chip string")
    got = {(r.squad, r.week): r for r in ledger.ledger(*args, wild, falls).collect()}
    assert got[1, 2].charge == pytest.approx(0.5 * 0.1 * 0.08) and got[1, 2].note is None and (got[1, 0].hits, got[1, 0].free) == (0, 1)
    pairs = {(r.week, r.n): (r.bought, r.sold, r.reason) for r in ledger.swaps(*args[:2], "squad", p).collect()}
    assert pairs == {(0, 1): (14, 12, None), (0, 2): (15, 11, None), (1, 1): (None, 11, "no partner of the kind"), (1, 2): (99, None, "unknown player"), (2, 1): (11, 15, None), (5, 1): (12, 14, "outside the horizon")}


def test_chips_go_where_they_gain_most(spark):
    rng, chips = random.Random(3), ["a", "b", "c"]
    rows = [(k, s, c, rng.randint(-3, 12)) for k in range(12) for s in range(rng.randint(1, 5)) for c in chips if rng.random() < 0.7]
    got = {}
    for r in policy.schedule(spark.createDataFrame([*rows, (3, 0, "z", 99), (3, 0, "a", None)], "k int, s long, c string, g long"), ["k"], "s", "c", "g", chips, ["b"]).collect():
        got.setdefault(r.k, []).append(r)
    for k in range(12):
        mine = {(s, c): g for kk, s, c, g in rows if kk == k}
        slots = sorted({s for s, _ in mine})
        best = max(sum(mine.get((s, c), -math.inf) for s, c in zip(pick, cs)) for n in range(4) for pick in itertools.permutations(slots, min(n, len(slots))) for cs in itertools.permutations(chips, min(n, len(slots))))
        plan = got.get(k, [])
        assert sum(r.g for r in plan) == max(best, 0) and all(r.total == max(best, 0) and r.g == mine[r.s, r.c] > 0 for r in plan)
        assert len({r.s for r in plan}) == len({r.c for r in plan}) == len(plan)
        assert all(r.per_week == r.g / (slots[-1] - r.s + 1 if r.c == "b" else 1) for r in plan)


def test_nobody_is_bought_and_sold_in_a_week(spark):
    rows = made_up(random.Random(2), 1, ["FWD", "FWD"], 2)
    rows = [(*r[:4], 50, 500 if i == 15 else 50, r[6], False, r[8]) for i, r in enumerate(rows)]  # one to buy whom a sale would bring ten times his cost
    states = spark.createDataFrame([(1, 0, 2)], "squad long, bank long, free int")
    (plan,) = selection.best_plans(spark.createDataFrame(rows, PLAYERS), states, "squad", Terms(weeks=1, club_limit=15)).collect()
    told = [m.split(" ") for m in plan.moves]
    assert not {c for _, side, c in told if side == "in"} & {c for _, side, c in told if side == "out"} and plan.bank <= 0


def test_a_search_shuffles_boards_and_states_alone(spark):
    rows = made_up(random.Random(4), 1, ["MID"], 3)
    states = spark.createDataFrame([(1, 0, 2)], "squad long, bank long, free int")
    plan = selection.best_plans(spark.createDataFrame(rows, PLAYERS), states, "squad", Terms(weeks=3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "BroadcastExchange" not in plan


def test_sets_of_moves_that_cannot_win_are_not_built(spark):
    """Two outsiders of no use and one of much: in the last week only the sets that bring in this one, and the empty one, are built."""
    rows = made_up(random.Random(6), 1, ["DEF", "MID", "FWD"], 2)
    rows = [(*r[:3], str(i), 50, 50, r[6], False, [0.0, 0.0] if i in (15, 16) else [9.0, 99.0] if i == 17 else [5.0 + i / 10] * 2) for i, r in enumerate(rows)]
    board = selection.boards(spark.createDataFrame(rows, PLAYERS), "squad")
    have = board.selectExpr("*", "0L AS bank", "0.0D AS value", "1 AS free").withColumn("have", selection.F.expr("filter(sequence(0, size(all) - 1), i -> all[i].owned)"))
    t = Terms(weeks=2)
    state = selection._bounded(have, 0, t).withColumn("best", selection.F.col("holds"))
    built = selection._moved(state, t, True).select("come", "all").collect()
    assert 0 < len(built) < selection._moved(state, t, False).count() / 1.5 and all(not r.come or 117 in [r["all"][i].code for i in r.come] for r in built)
