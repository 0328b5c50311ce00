"""Queries on windows: customers' orders as entities over time, users' events as observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cents, places
from ..operators import windows as W
from ..operators.ordered import filled, ranked
from ..sources.tables import table

TIME = ["o_orderdate", "o_orderkey"]


def _orders(spark, d):
    o = table(spark, d, "orders")
    return o.withColumns({"v": cents("o_totalprice"), "flag": F.col("o_orderstatus") == "F", "yr": F.year("o_orderdate").cast("bigint"), "slot": (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint")})


def _events(spark, d):
    return table(spark, d, "events").withColumn("day", F.to_date("ts"))


def lagged_rolling_means(spark, d):
    out = W.lagged_means(_orders(spark, d), "o_custkey", TIME, ["v"], [3, 5, 10])
    return out.select("o_orderkey", "o_custkey", *[places(f"v_r{w}").alias(f"v_r{w}") for w in (3, 5, 10)])


def rolling_asof_end(spark, d):
    out = W.as_of_end(_orders(spark, d), "o_custkey", TIME, ["v"], [3, 5, 10])
    return out.select("o_custkey", *[places(f"v_r{w}").alias(f"v_r{w}") for w in (3, 5, 10)])


def rolling_ratio_rate(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(F.sum(cents("l_extendedprice")).alias("v"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    return lines.select("l_suppkey", F.col("day").cast("string").alias("day"), F.floor(W.lagged_ratio("l_suppkey", ["day"], "v", "q", 10, 90.0)).alias("rate"))


def team_two_sided_rolling(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", F.col("l_quantity").cast("bigint").alias("q"))
    home = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("home")), F.col("o_custkey") == F.col("c_custkey"))
    away = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("away"))
    match = li.join(home, F.col("l_orderkey") == F.col("o_orderkey")).join(away, F.col("l_suppkey") == F.col("s_suppkey"))
    # two rows per match, folded to one per team and day before any window
    sides = match.select(F.explode(F.array(F.struct(F.col("home").alias("team"), F.lit(1).alias("h")), F.struct(F.col("away").alias("team"), F.lit(0).alias("h")))).alias("s"), F.to_date("l_shipdate").alias("day"), "q")
    daily = sides.groupBy("s.team", "day").agg(F.sum(F.when(F.col("s.h") == 1, F.col("q")).otherwise(0)).alias("gf"), F.sum(F.when(F.col("s.h") == 0, F.col("q")).otherwise(0)).alias("ga"))
    out = W.lagged_means(daily, "team", ["day"], ["gf", "ga"], [5, 10])
    return out.select(F.col("team").cast("bigint").alias("team"), F.col("day").cast("string").alias("day"), *[places(f"{s}_r{w}").alias(f"{s}_r{w}") for s in ("gf", "ga") for w in (5, 10)])


def season_share_expanding(spark, d):
    return _orders(spark, d).select("o_orderkey", "yr", places(W.expanding_share(["o_custkey", "yr"], TIME, F.col("flag"))).alias("share"))


def days_since_last_flag(spark, d):
    return _orders(spark, d).select("o_orderkey", W.days_since("o_custkey", TIME, "o_orderdate", F.col("flag"), 60).alias("days"))


def streak_gaps_islands(spark, d):
    return W.day_streaks(_events(spark, d), "user_id", "day").select("user_id", F.col("day").cast("string").alias("day"), "streak")


def lag_lead_gaps(spark, d):
    back, ahead = W.neighbour_gaps("o_custkey", TIME, "o_orderdate", 30)
    return _orders(spark, d).select("o_orderkey", back.alias("since"), ahead.alias("until"))


def range_count_14d(spark, d):
    return _events(spark, d).select("event_id", W.range_count("user_id", "ts", 14).alias("n"))


def calendar_density_7d(spark, d):
    out = W.active_days_before(_events(spark, d), "user_id", "day", 7, F.lit("2024-01-01").cast("date"))
    return out.select("user_id", F.col("day").cast("string").alias("day"), "density")


def last_k_share_min_n(spark, d):
    return _orders(spark, d).select("o_orderkey", places(W.last_share(["o_custkey"], TIME, F.col("flag"), 5)).alias("share"))


def lineup_churn(spark, d):
    out = W.set_churn(_events(spark, d), "event_type", "day", "user_id", 5)
    return out.select("event_type", F.col("day").cast("string").alias("day"), "n_new", places("churn").alias("churn"))


def _flagged(spark, d):
    o = _orders(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return o.withColumns({"hit": F.col("flag").cast("bigint"), "one": F.lit(1).cast("bigint")})


def eb_shrunk_rate(spark, d):
    out = W.shrunk_ratio(_flagged(spark, d), "o_custkey", "c_mktsegment", "slot", "hit", "one", 20.0)
    return out.select("o_custkey", "slot", places("rate").alias("rate"))


def eb_shrunk_asof_end(spark, d):
    out = W.shrunk_ratio(_flagged(spark, d), "o_custkey", "c_mktsegment", "slot", "hit", "one", 20.0, as_of_end=True)
    return out.select("o_custkey", places("rate").alias("rate"))


def spell_cumulative_prior(spark, d):
    o = _orders(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("nation")), "o_custkey").withColumns({"hit": F.col("flag").cast("bigint"), "one": F.lit(1).cast("bigint"), "spell": F.concat_ws("|", "nation", "yr")})
    out = W.shrunk_ratio(o, "o_custkey", "spell", "slot", "hit", "one", 5.0)
    return out.select("o_custkey", "spell", "slot", places("rate").alias("rate"))


def competition_rank_award(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("score"))
    return per.select("l_orderkey", "l_suppkey", "score", W.competition_award(["l_orderkey"], "score").alias("award"))


def topn_per_group_plus_owned(spark, d):
    part = table(spark, d, "part").withColumn("price", cents("p_retailprice"))
    owned = part.where("p_size = 1")
    return W.top_per_group(part, "p_brand", "price", "p_partkey", 5).unionByName(owned).select("p_partkey", "p_brand", "price").dropDuplicates(["p_partkey"])


def rank_change_table(spark, d):
    """Ranks in each year by its orders, and how they moved by December's."""
    o = _orders(spark, d).groupBy("yr", "o_custkey").agg(F.sum(F.when(F.month("o_orderdate") < 12, F.col("v")).otherwise(0)).alias("pre"), F.sum("v").alias("total"))
    out = ranked(ranked(o, ["yr"], [F.desc("pre"), F.col("o_custkey")], "pre_rank"), ["yr"], [F.desc("total"), F.col("o_custkey")], "live_rank")
    return out.select(F.col("yr").cast("bigint").alias("yr"), "o_custkey", "total", F.col("live_rank").cast("bigint").alias("live_rank"), (F.col("pre_rank") - F.col("live_rank")).cast("bigint").alias("change"))


def neighbour_margins(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("nation"), cents("c_acctbal").alias("bal"))
    c = c.withColumn("place", F.struct((-F.col("bal")).alias("b"), F.col("c_custkey").alias("k")))
    before = filled(c, ["nation"], [F.col("place")], {"above": F.col("bal")}, own=False)
    both = filled(before, ["nation"], [F.col("place")], {"below": F.col("bal")}, forward=True, own=False)
    leaders = c.groupBy("nation").agg(F.max("bal").alias("leader"))
    out = both.join(leaders, "nation")
    return out.select("c_custkey", (F.col("above") - F.col("bal")).alias("behind"), (F.col("bal") - F.col("below")).alias("ahead"), (F.col("leader") - F.col("bal")).alias("to_leader"))


def latest_per_key(spark, d):
    out = W.latest_per_key(_events(spark, d), ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("user_id", "event_type", "event_id", cents("value").alias("value"))


QUERIES = {f.__name__: f for f in (lagged_rolling_means, rolling_asof_end, rolling_ratio_rate, team_two_sided_rolling, season_share_expanding, days_since_last_flag, streak_gaps_islands, lag_lead_gaps, range_count_14d, calendar_density_7d, last_k_share_min_n, lineup_churn, eb_shrunk_rate, eb_shrunk_asof_end, spell_cumulative_prior, competition_rank_award, topn_per_group_plus_owned, rank_change_table, neighbour_margins, latest_per_key)}

O = """WITH o AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS v, o_orderstatus = 'F' AS flag, CAST(year(o_orderdate) AS BIGINT) AS yr,
  CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS slot FROM orders)"""
BEFORE = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN"
SHRUNK = """, own AS (SELECT o_custkey, {g} AS g, slot, sum(CAST(flag AS BIGINT)) AS v, count(*) AS n FROM o JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
s AS (SELECT g, slot, sum(v) AS gv, sum(n) AS gn FROM own GROUP BY ALL),
p AS (SELECT g, slot, sum(gv) OVER w / CAST(sum(gn) OVER w AS DOUBLE) AS prior FROM s WINDOW w AS (PARTITION BY g ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT o_custkey, g, slot, coalesce(sum(v) OVER w, 0) AS v, coalesce(sum(n) OVER w, 0) AS n FROM own WINDOW w AS (PARTITION BY o_custkey, g ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT o_custkey, {extra}slot, round(CAST((v + {k} * prior) / (n + {k}) AS DOUBLE), 4) AS rate FROM b JOIN p USING (g, slot)"""
E_ = "WITH e AS (SELECT *, CAST(ts AS DATE) AS day, CAST(round(value * 100) AS BIGINT) AS v FROM events)"

ORACLE_SQL = {
    "lagged_rolling_means": f"{O} SELECT o_orderkey, o_custkey, " + ", ".join(f"round(avg(v) OVER ({BEFORE} {w} PRECEDING AND 1 PRECEDING), 4) AS v_r{w}" for w in (3, 5, 10)) + " FROM o",
    "rolling_asof_end": f"{O}, r AS (SELECT o_custkey, v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM o) SELECT o_custkey, " + ", ".join(f"round(avg(v) FILTER (WHERE n <= {w}), 4) AS v_r{w}" for w in (3, 5, 10)) + " FROM r GROUP BY o_custkey",
    "rolling_ratio_rate": """WITH l AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS v, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY ALL)
SELECT l_suppkey, CAST(day AS VARCHAR) AS day, CAST(floor(CAST(sum(v) OVER w AS DOUBLE) / nullif(sum(q) OVER w, 0) * 90.0) AS BIGINT) AS rate FROM l WINDOW w AS (PARTITION BY l_suppkey ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
    "team_two_sided_rolling": """WITH m AS (SELECT c_nationkey AS home, s_nationkey AS away, CAST(l_shipdate AS DATE) AS day, CAST(l_quantity AS BIGINT) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
t AS (SELECT home AS team, day, q AS gf, 0 AS ga FROM m UNION ALL SELECT away, day, 0, q FROM m),
s AS (SELECT team, day, sum(gf) AS gf, sum(ga) AS ga FROM t GROUP BY ALL)
SELECT CAST(team AS BIGINT) AS team, CAST(day AS VARCHAR) AS day, """ + ", ".join(f"round(avg({c}) OVER (PARTITION BY team ORDER BY day ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 4) AS {c}_r{w}" for c in ("gf", "ga") for w in (5, 10)) + " FROM s",
    "season_share_expanding": f"{O} SELECT o_orderkey, yr, round(avg(CAST(flag AS DOUBLE)) OVER (PARTITION BY o_custkey, yr ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS share FROM o",
    "days_since_last_flag": f"{O}, l AS (SELECT *, max(CASE WHEN flag THEN o_orderdate END) OVER ({BEFORE} UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM o) SELECT o_orderkey, least(greatest(CAST(floor((epoch_us(o_orderdate) - epoch_us(last)) / 86400000000) AS BIGINT), 0), 60) AS days FROM l WHERE last IS NOT NULL UNION ALL SELECT o_orderkey, NULL FROM l WHERE last IS NULL",
    "streak_gaps_islands": f"{E_}, a AS (SELECT DISTINCT user_id, day FROM e), i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS island FROM a) SELECT user_id, CAST(day AS VARCHAR) AS day, row_number() OVER (PARTITION BY user_id, island ORDER BY day) AS streak FROM i",
    "lag_lead_gaps": f"{O}, g AS (SELECT o_orderkey, CAST(floor((epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER w)) / 86400000000) AS BIGINT) AS a, CAST(floor((epoch_us(lead(o_orderdate) OVER w) - epoch_us(o_orderdate)) / 86400000000) AS BIGINT) AS b FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT o_orderkey, CASE WHEN a IS NOT NULL THEN least(greatest(a, 0), 30) END AS since, CASE WHEN b IS NOT NULL THEN least(greatest(b, 0), 30) END AS until FROM g",
    "range_count_14d": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) RANGE BETWEEN 1209600 PRECEDING AND 1 PRECEDING) AS n FROM events",
    "calendar_density_7d": f"{E_}, a AS (SELECT DISTINCT user_id, day FROM e) SELECT user_id, CAST(day AS VARCHAR) AS day, CASE WHEN day - 7 >= DATE '2024-01-01' THEN count(*) OVER (PARTITION BY user_id ORDER BY date_diff('day', DATE '1970-01-01', day) RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS density FROM a",
    "last_k_share_min_n": f"{O} SELECT o_orderkey, CASE WHEN count(*) OVER w = 5 THEN round(avg(CAST(flag AS DOUBLE)) OVER w, 4) END AS share FROM o WINDOW w AS ({BEFORE} 5 PRECEDING AND 1 PRECEDING)",
    "lineup_churn": f"""{E_}, r AS (SELECT DISTINCT event_type, day, user_id FROM e), s AS (SELECT event_type, day, list(user_id) AS u FROM r GROUP BY ALL),
l AS (SELECT *, lag(u) OVER (PARTITION BY event_type ORDER BY day) AS before FROM s), n AS (SELECT event_type, day, CASE WHEN before IS NOT NULL THEN len(list_filter(u, lambda x: NOT list_contains(before, x))) END AS n_new FROM l)
SELECT event_type, CAST(day AS VARCHAR) AS day, n_new, round(avg(n_new) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS churn FROM n""",
    "eb_shrunk_rate": O + SHRUNK.format(g="c_mktsegment", k="20.0", extra=""),
    "eb_shrunk_asof_end": f"{O}, own AS (SELECT o_custkey, c_mktsegment AS g, sum(CAST(flag AS BIGINT)) AS v, count(*) AS n FROM o JOIN customer ON c_custkey = o_custkey GROUP BY ALL), p AS (SELECT g, CAST(sum(v) AS DOUBLE) / sum(n) AS prior FROM own GROUP BY g) SELECT o_custkey, round(CAST((v + 20.0 * prior) / (n + 20.0) AS DOUBLE), 4) AS rate FROM own JOIN p USING (g)",
    "spell_cumulative_prior": O + SHRUNK.format(g="CAST(c_nationkey AS VARCHAR) || '|' || CAST(yr AS VARCHAR)", k="5.0", extra="g AS spell, "),
    "competition_rank_award": "WITH s AS (SELECT l_orderkey, l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS score FROM lineitem GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY score DESC) AS k FROM s) SELECT l_orderkey, l_suppkey, score, CAST(CASE k WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS award FROM r",
    "topn_per_group_plus_owned": "WITH p AS (SELECT p_partkey, p_brand, CAST(round(p_retailprice * 100) AS BIGINT) AS price, p_size FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY price DESC, p_partkey) AS n FROM p) SELECT p_partkey, p_brand, price FROM r WHERE n <= 5 OR p_size = 1",
    "rank_change_table": f"""{O}, t AS (SELECT yr, o_custkey, CAST(sum(CASE WHEN month(o_orderdate) < 12 THEN v ELSE 0 END) AS BIGINT) AS pre, CAST(sum(v) AS BIGINT) AS total FROM o GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY pre DESC, o_custkey) AS a, row_number() OVER (PARTITION BY yr ORDER BY total DESC, o_custkey) AS b FROM t) SELECT yr, o_custkey, total, b AS live_rank, a - b AS change FROM r""",
    "neighbour_margins": "WITH c AS (SELECT c_custkey, c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) AS bal FROM customer) SELECT c_custkey, lag(bal) OVER w - bal AS behind, bal - lead(bal) OVER w AS ahead, first_value(bal) OVER w - bal AS to_leader FROM c WINDOW w AS (PARTITION BY c_nationkey ORDER BY bal DESC, c_custkey)",
    "latest_per_key": f"{E_} SELECT user_id, event_type, event_id, v AS value FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
}
