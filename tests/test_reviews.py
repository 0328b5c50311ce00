"""Operators of reviews, rules and squads on small rows: nulls, ties, repeats and empty tables."""

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.operators import reviews, simulation, squads


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_gated_scores_count_known_pairs_only(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0)] * 30 + [("b", 0.5, 1.0)] * 29 + [("b", None, 1.0), ("b", 0.5, None), ("c", None, None)], "g string, p double, y double")
    got = {r.g: r for r in reviews.gated_scores(df, ["g"], "p", "y").collect()}
    assert (got["a"].n, got["a"].status, got["a"].brier) == (30, "scored", 0.0) and got["a"].log_loss == pytest.approx(0, abs=1e-5)
    assert (got["b"].n, got["b"].status, got["b"].brier, got["b"].log_loss) == (29, "insufficient", None, None) and got["c"].n == 0
    assert reviews.gated_scores(df.where("g = 'x'"), ["g"], "p", "y").count() == 0


def test_bias_moves_only_groups_with_enough_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0, 0.5), ("a", 1.0, 2.0, None), ("b", 1.0, 9.0, 1.0), (None, 1.0, 2.0, 1.0)], "g string, p double, a double, w double")
    got = rows(reviews.bias_shifted(df, "g", "p", "a", F.col("w"), F.col("a") > 0, least=2).select("g", "p"))
    assert got == [("a", 1.0), ("a", 1.75), ("b", 1.0), (None, 1.0)]


def test_first_change_counts_null_as_a_status_and_leaves_the_deadline_day_out(spark):
    day = lambda k: dt.date(2024, 1, k)
    log = spark.createDataFrame([(1, 7, day(1), "a"), (1, 7, day(3), None), (1, 7, day(4), "a"), (1, 8, day(1), "a"), (1, 8, day(5), "b"), (2, 7, day(1), "a")], "slot int, k int, day date, s string")
    due = spark.createDataFrame([(1, dt.datetime(2024, 1, 5, 18))], "slot int, deadline timestamp")
    inside = reviews.before_deadline(log, due, "slot", "day")
    assert rows(inside.select("k", "lead_days")) == [(7, 1), (7, 2), (7, 4), (8, 4)]
    assert rows(reviews.first_changes(inside, ["slot", "k"], ["day"], "s")) == [(1, 7, "a", "a", 2)]
    assert [r[0] for r in spark.range(9).select(reviews.lead_band(F.col("id"))).collect()] == ["<1d", "1-2d", "2-3d", "3-5d", "3-5d", "5-7d", "5-7d", "7d+", "7d+"]


def test_grades_without_any_miss_have_no_recall(spark):
    df = spark.createDataFrame([("fit", 0), ("fit", 0), ("out", 0)], "v string, m int")
    assert rows(reviews.grades(df, "v", "m")) == [("fit", 2, 0, 0.0, 0.0), ("out", 1, 0, 0.0, 0.0)]
    df = spark.createDataFrame([("fit", 0), ("fit", 1), ("out", 1)], "v string, m int")
    assert rows(reviews.grades(df, "v", "m")) == [("fit", 2, 1, 0.5, 0.5), ("out", 1, 1, 1.0, 0.5)]


def test_aligned_weeks_are_not_graded(spark):
    df = spark.createDataFrame([("a", -1, False)] * 3 + [("a", 2, False), ("a", -5, True), ("a", None, False), ("a", 0, False), ("b", 1, True)] + [("c", 1, False)] * 4, "k string, d int, al boolean")
    got = {r.k: (r.reviewed, r.graded, r.wins, r.losses, r.aligned, r.tier) for r in reviews.tiers(df, "k", "d", "al").collect()}
    assert got == {"a": (7, 4, 3, 1, 1, "backed"), "b": (1, 0, 0, 0, 1, "early"), "c": (4, 4, 0, 4, 0, "mixed")}


def test_walk_stops_at_the_first_refusal_and_at_the_cap(spark):
    scores = {"a": {1: [0, 0, 0], 2: [1, 1, 0], 3: [0, 0, 0], 4: [9, 9, 9]}, "b": {1: [0, 0, 0], 2: [1, 1, 1], 6: [2, 2, 2], 7: [3, 3, 3]}, "c": {1: [0, 0, 0]}}
    df = spark.createDataFrame([(k, r, vs, r > 5) for k, rs in scores.items() for r, vs in rs.items()], "k string, r int, v array<int>, c boolean")
    got = rows(reviews.walk(df, "k", "r", "v", "c", 0.6))
    assert got == [("a", 1, 2, 0.6667, True), ("a", 2, 3, 0.0, False), ("b", 1, 2, 1.0, True), ("b", 2, 6, 1.0, False)]


def test_carried_orders_keep_what_was_stored_then(spark):
    asked = spark.createDataFrame([(1, 1), (2, 1), (1, 2), (3, 2), (1, None)], "k int, slot int")
    stored, today = spark.createDataFrame([(1, 1, 5)], "k int, slot int, v int"), spark.createDataFrame([(1, 9), (2, 8)], "k int, v int")
    assert rows(reviews.carried(asked, stored, today, "k", "slot", "v")) == [(1, 1, 5), (1, 2, 9), (1, None, 9), (2, 1, None), (3, 2, None)]


def test_coverage_carriers_and_repeats(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", None), ("b", None), ("b", 2)], "b string, code int")
    assert rows(reviews.covered(df, "b", "code", 0.5)) == [("a", 1)]
    left, right = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, t string"), spark.createDataFrame([(1, "out"), (3, "fit")], "k int, v string")
    assert rows(reviews.with_carriers(left, right, "k")) == [(1, "x", "out"), (1, "y", "out"), (2, "z", None), (3, None, "fit")]
    df = spark.createDataFrame([(1, 0, "p"), (1, 1, "q"), (1, 2, "p"), (1, 3, "p"), (2, 0, "p")], "k int, r int, s string")
    assert [r.same_as for r in reviews.repeats(df, "k", "r", "s").orderBy("k", "r").collect()] == [None, None, 0, 0, None]


def test_other_side_falls_back_on_doubt(spark):
    fixtures = spark.createDataFrame([(1, 10, 20), (1, 30, 40), (1, 50, 40)], "slot int, home int, away int")
    df = spark.createDataFrame([(1, 20, True), (1, 20, False), (1, 10, None), (1, 40, True), (2, 20, True)], "slot int, opp int, h boolean").withColumn("now", F.lit(-1))
    assert [tuple(r)[1:3] + (r.club,) for r in reviews.other_side(df, fixtures, ["slot"], "opp", "h", "now", "club").orderBy("slot", "opp", "h").collect()] == [(10, None, 20), (20, False, -1), (20, True, 10), (40, True, -1), (20, True, -1)]


@pytest.mark.parametrize("captain, vice, want", [(3, 5, {3: 2}), (13, 5, {5: 2}), (13, 14, {8: 2}), (None, None, {8: 2})])
def test_armband(spark, captain, vice, want):
    df = spark.createDataFrame([(1, p, 3 if p == 8 else 1, p == captain, p == vice) for p in range(1, 16)], "s int, p int, m int, c boolean, v boolean")
    got = {r.p: r.m for r in squads.effective_multipliers(df, "s", "p", "m", "c", "v").collect()}
    assert got == {p: want.get(p, 1) for p in range(1, 12)}


def test_armband_of_a_squad_without_places(spark):
    df = spark.createDataFrame([(1, None, 3, True, False), (1, 2, 0, False, False), (1, 3, 1, False, True)], "s int, p int, m int, c boolean, v boolean")
    assert rows(squads.effective_multipliers(df, "s", "p", "m", "c", "v").select("p", "m")) == [(3, 1), (None, 2)]


def test_field_rank_against_the_median_of_its_own_draws(spark):
    df = spark.createDataFrame([(1, k, float(k), 0.0, 1.0, int(k < 3)) for k in range(5)] + [(2, k, 1.0, 0.0, 0.0, 1) for k in range(3)], "s int, k int, mean double, sigma double, owned double, mine int")
    got = {r.s: (r.p_green, r["median"], r.own) for r in simulation.field_rank(df, "s", "k", "mean", "sigma", "owned", "mine", 4, 3).collect()}
    assert got == {1: (0.0, 10.0, 3.0), 2: (1.0, 0.0, 3.0)}
    same = spark.createDataFrame([(1, k, 1.0, 2.0, 0.5, k % 2) for k in range(12)], "s int, k int, mean double, sigma double, owned double, mine int")
    one, again = (simulation.field_rank(same.repartition(n), "s", "k", "mean", "sigma", "owned", "mine", 50, 9).collect() for n in (1, 5))
    assert one == again and 0 < one[0].p_green < 1


def test_rescaled_modes_sum_to_one(spark):
    df = spark.createDataFrame([(0.2, 0.4, 0.3, 0.5), (1.0, 0.7, 0.0, 0.0), (0.0, 0.0, 0.4, 0.6)], "a double, c double, s double, t double")
    for r in df.select("c", rules.rescaled_modes(*map(F.col, "acst")).alias("x")).collect():
        assert sum(r.x) == pytest.approx(1) and r.x.absent == r.c
    assert df.where("a = 1").select(rules.rescaled_modes(*map(F.col, "acst")).alias("x")).first().x.sub == pytest.approx(0.3)


def test_dates_in_two_forms(spark):
    df = spark.createDataFrame([("05/03/24",), ("05/03/2024",), ("17/08/98",), ("2024-03-05",), ("31/02/2024",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(rules.first_date(F.col("t"), "dd/MM/yy", "dd/MM/yyyy")).collect()]
    assert got == [dt.date(2024, 3, 5), dt.date(2024, 3, 5), dt.date(1998, 8, 17), None, None, None, None]


def test_penalty_increment_is_bounded_and_gives_back_its_points(spark):
    df = spark.createDataFrame([(1.0, 0.0, 9.0, 10.0, 1.0), (None, 1.0, None, 10.0, 1.0), (0.5, 0.0, 1.0, 4.0, 0.5), (0.0, 0.0, 1.0, 4.0, 1.0)], "n double, b double, m double, pts double, p double")
    found = df.select("pts", "p", rules.penalty_increment(*map(F.col, ("n", "b", "m", "pts", "p"))).alias("x")).collect()
    assert all(r.p * r.x.goals * r.pts == pytest.approx(r.x.ep) for r in found)
    assert [round(r.x.ep, 4) for r in found] == [0.8, -0.3, 0.1014, 0.0]
    assert statistics.mean(r.x.ep for r in found) < 0.2


def test_lanes_meet_their_rivals_without_a_broadcast(spark):
    c = spark.range(40).selectExpr("floor(id / 20) league", "id entry", "cast(id as double) mean", "1.0D sigma")
    out = simulation.lane_gains(c, "league", "entry", F.col("entry") % 20 == 7, "mean", "sigma", {"captain": F.col("mean") + 1}, 100)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.league, r.lane) for r in out.collect()} == {(0, "captain"), (1, "captain")}


def test_fields_and_leagues_stay_small(spark):
    c = spark.range(60).selectExpr("floor(id / 20) squad", "id k", "id / 9 mean", "cast(id % 4 as double) sigma", "id % 5 / 5 owned", "id % 2 mine", "id % 3 / 4 e")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    field = simulation.field_rank(c, "squad", "k", "mean", "sigma", "owned", "mine", 20, 15)
    assert plan(field).count("Generate") == 1 and field.count() == 3  # draws alone, not managers too
    league = simulation.league(c, "squad", "k", "mean", "sigma", "e", 30)
    assert plan(league).count("Exchange") == 1 and league.count() == 60  # entries alone are shuffled


def test_draws_of_a_ladder_are_compiled(spark, sf):
    from tidemark.plans import reviews as queries

    plan = queries.ladder_walk(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") >= 20  # one a draw, none in a function of an array
