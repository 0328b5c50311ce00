"""Ratings, learned heads, calibration, stopping and streaming against plain versions."""

import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.operators import models, policy, resolution
from tidemark.streaming import finality


def test_elo_against_a_loop(spark):
    rows = [("x" if i % 3 else "y", i, i % 5, (i * 7 + 1) % 5, (i % 3) / 2) for i in range(60)]
    got = models.elo(spark.createDataFrame(rows, "pool string, t int, home int, away int, score double"), "pool", ["t"], "home", "away", "score").collect()
    ratings, want = {}, {}
    for pool, t, h, a, s in rows:
        x, y = ratings.get((pool, h), 1500.0), ratings.get((pool, a), 1500.0)
        want[pool, t] = (x, y)
        move = 20 * (s - 1 / (1 + 10 ** ((y - x) / 400)))
        ratings[pool, h], ratings[pool, a] = x + move, y - move
    assert {(r.pool, r.t): (r.home_elo, r.away_elo) for r in got} == {k: pytest.approx(v) for k, v in want.items()}


def test_isotonic_against_pooling(spark):
    rows = [(i / 10, float(y)) for i, y in enumerate([0, 1, 0, 0, 1, 1, 0, 1, 1, 1])]
    steps = {round(r.at, 6): r.value for r in models.isotonic_steps(spark.createDataFrame(rows, "p double, y double"), "p", "y").collect()}
    pools = []
    for p, y in rows:
        pools.append([y, 1, [p]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
            y2, n2, p2 = pools.pop()
            pools[-1] = [pools[-1][0] + y2, pools[-1][1] + n2, pools[-1][2] + p2]
    want = {round(p, 6): y / n for y, n, ps in pools for p in ps}
    assert steps and all(want[at] == pytest.approx(value) for at, value in steps.items())


def test_gbt_learns_through_nulls(spark):
    rows = spark.range(400).select(F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id") % 4).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("z"))
    rows = rows.withColumn("y", F.when(F.col("x").isNull(), 9.0).otherwise(F.col("x")))
    model = models.gbt_head(rows, ["x", "z"], "y", trees=5, depth=3)
    worst = models.gbt_scored(model, rows, ["x", "z"], "p").agg(F.max(F.abs(F.col("p") - F.col("y")))).first()[0]
    assert worst < 0.5


def test_stopping_against_recursion(spark):
    draws = {0: [1.0, 5.0, 9.0], 1: [2.0, 2.0, 8.0], 2: [0.0, 4.0]}
    df = spark.createDataFrame([("k", s, v) for s, vs in draws.items() for v in vs] + [("k", 0, None)], "k string, s int, v double")
    got = {r.s: r.threshold for r in policy.stopping_thresholds(df, "k", "s", "v").collect()}
    last = 2.0
    middle = sum(max(v, last) for v in draws[1]) / 3
    assert got == {2: 0.0, 1: pytest.approx(last), 0: pytest.approx(middle)}


def test_resolution_leaves_ambiguous_names(spark):
    left = spark.createDataFrame([(1, "ann lee"), (2, "bo ray"), (3, "bo ray"), (4, "cy dee"), (5, None)], "source_id int, name string")
    right = spark.createDataFrame([(10, "ann lee"), (20, "bo ray"), (40, "dee cy"), (50, "")], "code int, name string")
    name = F.col("name")
    got = {tuple(r) for r in resolution.resolve(left, right, [("name", name, name), ("tokens", resolution.sorted_tokens(name), resolution.sorted_tokens(name))]).collect()}
    assert got == {(1, 10, "name"), (4, 40, "tokens")}


def test_gate_and_best_slot(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, None), ("b", 1, -1.0)], "k string, s int, g double")
    assert {r.k: r.s for r in policy.best_slot(df, "k", "s", "g").collect()} == {"a": 1, "b": 1}
    assert [r[0] for r in spark.createDataFrame([(0.7,), (0.55,), (0.1,), (None,)], "f double").select(policy.gate(F.col("f"), 0.6, 0.1)).collect()] == ["act", "near", "hold", None]


def test_rerun_replaces_its_partition(spark, tmp_path):
    write = finality.append_once(str(tmp_path / "log"), "day")
    write(spark.createDataFrame([(1, "a"), (2, "b")], "v int, day string"), 0)
    write(spark.createDataFrame([(3, "b")], "v int, day string"), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "log")).select("v", "day").collect()) == [(1, "a"), (3, "b")]


def test_out_of_fold_scores_come_from_other_folds(spark):
    rows = spark.range(40).select((F.col("id") % 2).alias("fold"), (F.col("id") % 2).cast("double").alias("y"), F.col("id").cast("double").alias("x"))
    got = models.out_of_fold(rows, "fold", ["x"], "y", "p", trees=2, depth=1).collect()
    assert len(got) == 40 and all(r.p == pytest.approx(1 - r.y) for r in got)


def test_gbt_head_scores_every_labelled_row(spark, sf):
    labelled = spark.read.parquet(f"{sf}/labels.parquet").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    rows = plans.queries()["gbt_head"](spark, sf).collect()
    assert len(rows) == labelled.count() and all(0 <= r.score <= 1 for r in rows)
