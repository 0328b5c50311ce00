"""Each query against its SQL on DuckDB, and micro-fixtures for the window and join operators."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.operators import facts, joins, metrics, ordered, windows

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    found = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        found.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    return found


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: "null" if x is None else repr(x + 0.0) if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, sf, con):
    got = QUERIES[name](spark, sf)
    ran = con.execute(SQL[name])
    columns = [c[0] for c in ran.description]
    assert sorted(got.columns) == sorted(columns)
    assert canonical(got.collect(), got.columns) == canonical(ran.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_has_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).count()


def test_lagged_mean_uses_up_rows(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("a", 3, 100.0), ("a", 4, 6.0)], "e string, t int, v double")
    got = [r.v_r3 for r in windows.lagged_means(df, "e", ["t"], ["v"], [3]).orderBy("t").collect()]
    assert got[:3] == [None, 2.0, 3.0] and got[3] == pytest.approx(106 / 3)
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("a", 3, 8.0)], "e string, t int, v double")
    assert [r.v_r1 for r in windows.lagged_means(df, "e", ["t"], ["v"], [1]).orderBy("t").collect()] == [None, 2.0, None]


@pytest.mark.parametrize("scores, awards", [((50, 50, 40), (3, 3, 1)), ((50, 40, 40), (3, 2, 2)), ((50, 50, 50, 30), (3, 3, 3, 0))])
def test_competition_award(spark, scores, awards):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "g int, i int, s int")
    assert tuple(r.a for r in df.select("i", windows.competition_award(["g"], "s").alias("a")).orderBy("i").collect()) == awards


def test_interval_boundary_belongs_to_the_successor(spark):
    spells = spark.createDataFrame([(1, "2024-01-01", "2024-02-01", "old"), (1, "2024-02-01", None, "new")], "k int, start string, end string, who string").withColumns({c: F.to_timestamp(c) for c in ("start", "end")})
    facts = spark.createDataFrame([(1, 1, "2024-02-01"), (2, 1, "2024-01-31"), (3, 1, "2023-01-01")], "i int, k int, t string").withColumn("t", F.to_timestamp("t"))
    assert {r.i: r.who for r in joins.interval_join(facts, spells, "k", "t").collect()} == {1: "new", 2: "old", 3: None}


def test_many_to_one_raises_on_a_repeated_key(spark):
    dim = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="occurs twice"):
        joins.many_to_one(spark.createDataFrame([(1,)], "k int"), dim, ["k"]).collect()


def test_prior_does_not_see_its_own_slot(spark):
    df = spark.createDataFrame([("a", "t", 1, 1, 1), ("b", "t", 1, 0, 1), ("a", "t", 2, 1, 1)], "e string, g string, s int, v int, n int")
    got = {(r.e, r.s): r.rate for r in windows.shrunk_ratio(df, "e", "g", "s", "v", "n", 2.0).collect()}
    assert got == {("a", 1): None, ("b", 1): None, ("a", 2): pytest.approx((1 + 2 * 0.5) / 3)}


def test_p_best_splits_ties_and_keeps_losers(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4), ("b", 4, 0), ("b", 5, 1), ("c", 6, 1), ("c", 7, None)], "g string, k int, v int")
    got = {r.k: r.p_best for r in metrics.p_best(df, "g", "k", lambda draw: F.col("v") + F.when((F.col("k") == 4) & (draw < 500), 9).otherwise(0)).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 0.0, 4: 0.25, 5: 0.75, 6: None, 7: None}


def test_ladder_p_best_gives_every_customer_a_share_of_2000_draws(spark, sf):
    rows = QUERIES["ladder_p_best"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/customer.parquet").count()
    assert sum(r.p_best for r in rows) == pytest.approx(len({r.c_mktsegment for r in rows}), abs=1e-5)
    assert any(0 < r.p_best < 1 / 40 for r in rows)


def test_offences_are_what_no_fact_says(spark):
    told = spark.createDataFrame([(1, "Fernandes is 96% to drop, 3,5 points for Shocky Supplies; −4 now."), (2, "Saka has 7.")], "c int, text string")
    prose = spark.createDataFrame([(1, 0, "Sell Fernandes at -96 and +3.5. Haaland's on 4, Palmer’s on 96 in GW12! Then Saka has 7."), (2, 1, "Both Saka and Rice have 7 or 8 or 8."), (3, 0, None)], "c int, t int, text string")
    got = lambda **how: {tuple(r) for r in facts.offences(told, prose, "c", "t", "text", codes="^GW[0-9]+$", **how).collect()}
    want = {(1, 0, 2, "number", "4", 1), (1, 0, 2, "name", "Palmer", 1), (1, 0, 2, "number", "12", 1), (1, 0, 3, "name", "Saka", 1), (1, 0, 3, "number", "7", 1), (2, 1, 1, "name", "Rice", 1), (2, 1, 1, "number", "8", 2)}
    assert got() == want
    assert got(known=spark.createDataFrame([("Haaland",), ("Fernandes",)], "name string")) == want | {(1, 0, 2, "name", "Haaland", 1)}
    assert got(allow=spark.createDataFrame([("Rice",), ("May",)], "token string")) == {w for w in want if w[4] != "Rice"}
    names = {r.token for r in facts.calendar_names(spark).collect()}
    assert len(names) == 19 and {"January", "May", "December", "Monday", "Sunday"} <= names


def test_check_brief_reports_openers_no_fact_of_the_conversation_says(spark, tmp_path):
    rows = [(1, 0, "user", "Rice has 7. Saka too"), (1, 1, "assistant", "Saka has 7. The 8 of Rice"), (2, 0, "user", "Old news"), (2, 1, None, "Saka is in")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["check_brief"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {(1, 1, 2, "number", "8", 1), (2, 1, 1, "name", "Saka", 1)}


def test_winners_need_no_sort_and_losers_no_draw(spark, sf, tmp_path):
    assert "SortAggregate" not in QUERIES["mc_p_best"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    spark.createDataFrame([(1, "A", None), (2, "A", None), (3, "B", None), (4, "B", 1.0)], "c_custkey long, c_mktsegment string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    assert {tuple(r) for r in QUERIES["mc_p_best"](spark, str(tmp_path)).collect()} == {("A", 2, 1.0), ("B", 4, 1.0)}
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 2), (None, 4, 0)], "g string, k int, v int")
    score = lambda draw: F.when((F.col("k") == 3) & (draw > 0), F.raise_error(F.lit("drawn")).cast("int")).otherwise(F.col("v"))
    got = {r.k: r.p_best for r in metrics.p_best(df, "g", "k", score, 10, (F.col("v"), F.col("v") + 1)).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 0.0, 4: 1.0}


def test_forward_fills_have_no_frame_to_the_end(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([None, 3, None, None, 5, None])], "g string, k int, v int")
    for own, want in ((True, [3, 3, 5, 5, 5, None]), (False, [3, 5, 5, 5, None, None])):
        out = ordered.filled(df, ["g"], [F.col("k")], {"near": F.col("v")}, forward=True, own=own)
        assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()
        assert [r.near for r in out.orderBy("k").collect()] == want


def test_draws_of_plans_stay_with_their_order(spark, sf):
    assert QUERIES["plan_scores"](spark, sf)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert "Exchange" in QUERIES["recentred_means"](spark, sf)._jdf.queryExecution().executedPlan().toString()  # dealt
