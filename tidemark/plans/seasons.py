"""Queries on squads, simulation, drifting sources, stored tables and fixtures."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import cents, days_between, places
from ..functions import rules as R
from ..operators import simulation as S
from ..operators import squads as Q
from ..operators.ordered import shared_dir
from ..sources.contracts import contracted
from ..sources.stores import Store
from ..sources.tables import table

DRAWS = 100


def _squads(spark, d):
    """Parts as squads of fifteen: two goalkeepers, five defenders, five midfielders, three forwards."""
    p = table(spark, d, "part").select((F.floor(F.col("p_partkey") / 15)).cast("bigint").alias("squad"), (F.col("p_partkey") % 15).alias("i"), (cents("p_retailprice") % 17 - 3).alias("points"), (F.col("p_size") % 4 > 0).alias("played"))
    kind = F.when(F.col("i") < 2, "GKP").when(F.col("i") < 7, "DEF").when(F.col("i") < 12, "MID").otherwise("FWD")
    return p.withColumn("kind", kind)


def best_elevens(spark, d):
    return Q.best_eleven(_squads(spark, d), "squad", "kind", "points")


def squad_substitutions(spark, d):
    """The first goalkeeper and ten others start; the bench is the rest in the order of their places."""
    starts = F.array(*map(F.lit, (0, 2, 3, 4, 5, 7, 8, 9, 10, 12, 13, 1, 6, 11, 14)))
    rows = _squads(spark, d).withColumn("place", F.array_position(starts, F.col("i")))
    return Q.substituted(rows, "squad", "place", "kind", "played", "points").select("squad", "n_subs", F.array_join(F.transform("ins", lambda x: x.cast("string")), ",").alias("ins"), "points")


def entry_points(spark, d):
    """Points of an order's lines (picks) by their multipliers with a bonus, and what is still to come."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("k"), (F.col("l_quantity").cast("bigint") % 3).alias("m"), F.round(F.col("l_discount") * 100).cast("bigint").alias("points"), "l_linestatus")
    picks = li.where("m >= 1")
    left = R.remaining_fraction(F.col("points") * 9, F.col("k") > 1, F.col("l_linestatus") == "F", F.lit(1), F.lit(0))
    return picks.groupBy("l_orderkey").agg(F.sum(F.col("m") * (F.col("points") + F.when(F.col("k") == 1, 3).otherwise(0))).alias("points"), places(F.sum(F.col("m") * F.col("k") * left), 2).alias("to_come"))


def mc_league(spark, d):
    """Leagues of twenty customers: how often each ends first or in the first three."""
    c = table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 20).cast("bigint").alias("league"), "c_custkey", (cents("c_acctbal") / 100000.0).alias("mean"), (F.col("c_custkey") % 4 + 1).cast("double").alias("sigma"), (F.col("c_custkey") % 3 / 4.0).alias("e"))
    out = S.league(c, "league", "c_custkey", "mean", "sigma", "e", DRAWS)
    return out.select("league", "c_custkey", places("p_win", 6).alias("p_win"), places("p_top3", 6).alias("p_top3"), places("finish", 6).alias("finish"))


def plan_scores(spark, d):
    """Mean and spread of plans (orders) over draws of their lines' points, the first line counted twice, four points off a returned line."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("k"), (F.round(F.col("l_discount") * 100) / 2).alias("mu"), (F.col("l_returnflag") == "R").cast("bigint").alias("hit"))
    li = li.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")  # lines are shuffled, their draws stay with their order
    rows = S.drawn(li, F.col("mu"), F.sqrt(F.greatest(F.col("mu"), F.lit(0.0)) * 1.5), ["l_orderkey", "k"], 20)
    totals = rows.groupBy("l_orderkey", "draw").agg(F.sum(F.col("value") * F.when(F.col("k") == 1, 2).otherwise(1) - 4 * F.col("hit")).alias("total"))
    return totals.groupBy("l_orderkey").agg(places(F.avg("total"), 3).alias("mean"), places(F.stddev_pop("total"), 3).alias("spread"))


def drifting_rows(spark, d):
    """Orders as a source gives them: everything text, another name for the price, some of it unreadable, one column never there."""
    o = table(spark, d, "orders")
    raw = o.select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.concat(F.lit(" "), cents("o_totalprice").cast("string"), F.lit(".0 "))).alias("cost"),
                   F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("when"), F.when(F.col("o_orderstatus") == "F", "TRUE ").otherwise("no").alias("done"))
    out = contracted(raw, {"id": "bigint", "price": "bigint", "when": "timestamp", "done": "boolean", "note": "string"}, {"price": ["value", "cost"]}, ["id", "when"])
    return out.select("id", "price", F.date_format("when", "yyyy-MM-dd").alias("day"), "done", "note")


def season_label(spark, d):
    """The season of the earliest readable stamp, and the first month that isn't over at a given day."""
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("x"), "ts")
    year = F.year(F.min(F.try_to_timestamp("x")))
    following = F.min(F.when(F.col("ts") > F.to_timestamp(F.lit("2024-02-10 00:00:00")), F.struct("ts")))["ts"]
    return e.agg(F.concat(year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0")).alias("season"), F.date_format(following, "yyyy-MM-dd HH:mm").alias("next"))


def hot_slots(spark, d):
    """Months to read again: the last two, and those with anything unfinished."""
    o = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("slot")).agg(F.bool_or(F.col("o_orderstatus") == "O").alias("open"))
    last = o.orderBy(F.desc("slot")).limit(2).select(F.col("slot").alias("last"))
    return o.join(F.broadcast(last), F.col("slot") == F.col("last"), "left").where("open or last is not null").select("slot", F.col("last").isNotNull().alias("recent"))  # two rows


def stored_orders(spark, d):
    """Orders by status, saved as a named table in the shared folder and loaded again."""
    store = Store(spark, f"{shared_dir(spark)}/tidemark-store-{uuid.uuid4().hex}")
    o = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(cents("o_totalprice")).alias("v"))
    store.save(o, "orders_by_status")
    return store.load("orders_by_status")


def rotation_asof_end(spark, d):
    """As of a customer's last order: the share of finished ones in its year, days since the last finished one, at most 60."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", (F.col("o_orderstatus") == "F").alias("flag"), F.year("o_orderdate").alias("yr"))
    last = o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "yr")).alias("end"), F.max(F.when(F.col("flag"), F.col("o_orderdate"))).alias("flagged"))
    share = o.groupBy("o_custkey", "yr").agg((F.count(F.when(F.col("flag"), 1)) / F.count(F.lit(1))).alias("share"))
    both = last.select("o_custkey", F.col("end.o_orderdate").alias("at"), F.col("end.yr").alias("yr"), "flagged").join(share, ["o_custkey", "yr"])
    return both.select("o_custkey", places("share").alias("share"), F.when(F.col("flagged").isNotNull(), F.least(days_between("at", "flagged"), F.lit(60))).alias("days"))


def congestion_ahead(spark, d):
    """At a coming date: days since each customer's last order before it, and orders in the 90 days before."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", F.to_timestamp(F.lit("2001-06-30 12:00:00")).alias("at")).where(F.col("o_orderdate") < F.col("at"))
    near = days_between("at", "o_orderdate")
    return o.groupBy("o_custkey").agg(F.min(near).alias("gap"), F.count(F.when(near < 90, 1)).alias("load"))


def typed_log(spark, d):
    """Dated rows of a log: typed, without keys that are unknown, the last of each key and day."""
    e = table(spark, d, "events").select(F.nullif(F.col("user_id"), F.lit(7)).alias("code"), F.to_date("ts").cast("string").alias("day"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), "ts", "event_id")
    return e.where("code is not null").groupBy("code", "day").agg(F.max_by("k", F.struct("ts", "event_id")).alias("k"))


def fixture_sides(spark, d):
    """Each line as a fixture of its supplier (home) and part (away), a row a side; unplayed ones stay, with unknown goals."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("k"), F.col("l_suppkey").alias("h"), F.col("l_partkey").alias("a"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("bigint") % 5).alias("hg"), F.when(F.col("l_linestatus") == "F", F.round(F.col("l_discount") * 100).cast("bigint") % 4).alias("ag"))
    side = lambda team, opp, home, gf, ga: F.struct(F.col(team).alias("team"), F.col(opp).alias("opp"), F.lit(home).alias("home"), F.col(gf).alias("gf"), F.col(ga).alias("ga"))
    rows = li.select(F.explode(F.array(side("h", "a", True, "hg", "ag"), side("a", "h", False, "ag", "hg"))).alias("s")).select("s.*")
    return rows.groupBy("team", "home").agg(F.count(F.lit(1)).alias("n"), F.count("gf").alias("played"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"), F.count(F.when(F.col("ga") == 0, 1)).alias("clean"))


QUERIES = {
    f.__name__: f
    for f in (
        best_elevens, squad_substitutions, entry_points, mc_league, plan_scores, drifting_rows, season_label, hot_slots, stored_orders,
        rotation_asof_end, congestion_ahead, typed_log, fixture_sides,
    )
}

UNIFORM = "CAST(('0x' || substr(md5({x}), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"
NORMAL = f"sqrt(-2 * ln(1 - {UNIFORM.format(x='{x} || ' + chr(39) + '|u' + chr(39))})) * cos(2 * pi() * {UNIFORM.format(x='{x} || ' + chr(39) + '|v' + chr(39))})"
SQUADS = """WITH p AS (SELECT p_partkey // 15 AS squad, p_partkey % 15 AS i, CAST(round(p_retailprice * 100) AS BIGINT) % 17 - 3 AS points FROM part),
s AS (SELECT *, CASE WHEN i < 2 THEN 'GKP' WHEN i < 7 THEN 'DEF' WHEN i < 12 THEN 'MID' ELSE 'FWD' END AS kind FROM p)"""

ORACLE_SQL = {
    "best_elevens": f"""{SQUADS}, f AS (SELECT d, m, 10 - d - m AS f FROM range(3, 6) x(d), range(2, 6) y(m) WHERE 10 - d - m BETWEEN 1 AND 3),
r AS (SELECT *, row_number() OVER (PARTITION BY squad, kind ORDER BY points DESC) AS n FROM s),
t AS (SELECT squad, d, m, f, sum(points) AS total, count(*) AS eleven, max(points) AS captain FROM r, f
  WHERE n <= CASE kind WHEN 'GKP' THEN 1 WHEN 'DEF' THEN d WHEN 'MID' THEN m ELSE f END GROUP BY 1, 2, 3, 4)
SELECT squad, CAST(max(total + captain) AS BIGINT) AS total, max(captain) AS captain FROM t WHERE eleven = 11 GROUP BY 1""",
    "squad_substitutions": """WITH RECURSIVE p AS (SELECT p_partkey // 15 AS squad, p_partkey % 15 AS i, CAST(round(p_retailprice * 100) AS BIGINT) % 17 - 3 AS points, p_size % 4 > 0 AS played FROM part),
s AS (SELECT squad, list_position([0, 2, 3, 4, 5, 7, 8, 9, 10, 12, 13, 1, 6, 11, 14], i) AS place, CASE WHEN i < 2 THEN 1 WHEN i < 7 THEN 2 WHEN i < 12 THEN 3 ELSE 4 END AS kind, points, coalesce(played, false) AS played FROM p),
q AS (SELECT squad, list(struct_pack(i := place, kind := kind, points := points, played := played) ORDER BY place) AS x FROM s GROUP BY 1),
b AS (SELECT squad, list_filter(x, lambda r: r.i <= 11) AS xi, list_filter(x, lambda r: r.i > 11) AS bench FROM q),
f AS (SELECT squad, 1::BIGINT AS n, list_transform([1, 2, 3, 4], lambda k: len(list_filter(xi, lambda r: r.kind = k))) AS counts, []::BIGINT[] AS ins, 0::BIGINT AS points FROM b
  UNION ALL SELECT squad, n + 1, CASE WHEN stays THEN counts ELSE list_transform([1, 2, 3, 4], lambda k: counts[k] - CASE WHEN own.kind = k THEN 1 ELSE 0 END + CASE WHEN sub.kind = k THEN 1 ELSE 0 END) END, CASE WHEN stays THEN ins ELSE ins || [sub.i] END, points + CASE WHEN stays THEN own.points ELSE sub.points END
  FROM (SELECT *, own.played OR sub IS NULL AS stays FROM (SELECT f.*, b.xi[f.n] AS own, list_filter(b.bench, lambda r: r.played AND NOT list_contains(f.ins, r.i) AND list_bool_and(list_transform([1, 2, 3, 4], lambda k:
      f.counts[k] - CASE WHEN b.xi[f.n].kind = k THEN 1 ELSE 0 END + CASE WHEN r.kind = k THEN 1 ELSE 0 END BETWEEN [1, 3, 2, 1][k] AND [1, 5, 5, 3][k])))[1] AS sub FROM f JOIN b USING (squad) WHERE f.n <= len(b.xi))))
SELECT f.squad, len(ins) AS n_subs, array_to_string(ins, ',') AS ins, f.points FROM f JOIN b USING (squad) WHERE f.n = len(b.xi) + 1""",
    "entry_points": """WITH l AS (SELECT l_orderkey, l_linenumber AS k, CAST(l_quantity AS BIGINT) % 3 AS m, CAST(round(l_discount * 100) AS BIGINT) AS p, l_linestatus FROM lineitem)
SELECT l_orderkey, CAST(sum(m * (p + CASE WHEN k = 1 THEN 3 ELSE 0 END)) AS BIGINT) AS points, round(sum(m * k * CASE WHEN l_linestatus = 'F' THEN 0 WHEN k <= 1 THEN 1 ELSE greatest(0, 1 - p * 9 / 90) END), 2)::DOUBLE AS to_come
FROM l WHERE m >= 1 GROUP BY 1""",
    "mc_league": f"""WITH c AS (SELECT c_custkey // 20 AS league, c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) / 100000 AS mean, c_custkey % 4 + 1 AS sigma, c_custkey % 3 / 4 AS e, unnest(range(0, {DRAWS})) AS draw FROM customer),
t AS (SELECT *, mean + sigma * (e * {NORMAL.format(x="league || '|' || draw")} + sqrt(1 - e * e) * {NORMAL.format(x="league || '|' || c_custkey || '|' || draw")}) AS total FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY league, draw ORDER BY total DESC, c_custkey) AS place FROM t)
SELECT league, c_custkey, round(avg(CASE WHEN place = 1 THEN 1 ELSE 0 END), 6) AS p_win, round(avg(CASE WHEN place <= 3 THEN 1 ELSE 0 END), 6) AS p_top3, round(avg(place), 6) AS finish FROM r GROUP BY 1, 2""",
    "plan_scores": f"""WITH l AS (SELECT l_orderkey, l_linenumber AS k, CAST(round(l_discount * 100) AS BIGINT) / 2 AS mu, CASE WHEN l_returnflag = 'R' THEN 4 ELSE 0 END AS hit, unnest(range(0, 20)) AS draw FROM lineitem),
v AS (SELECT l_orderkey, draw, sum((mu + sqrt(greatest(mu, 0) * 1.5) * {NORMAL.format(x="l_orderkey || '|' || k || '|' || draw")}) * CASE WHEN k = 1 THEN 2 ELSE 1 END - hit) AS total FROM l GROUP BY 1, 2)
SELECT l_orderkey, round(avg(total), 3) AS mean, round(stddev_pop(total), 3) AS spread FROM v GROUP BY 1""",
    "drifting_rows": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS price, strftime(o_orderdate, '%Y-%m-%d') AS day,
  CASE WHEN o_orderstatus = 'F' THEN true END AS done, CAST(NULL AS VARCHAR) AS note FROM orders WHERE o_orderkey % 5 <> 0""",
    "season_label": """SELECT year(min(ts) FILTER (WHERE event_id % 3 <> 0)) || '-' || lpad(CAST((year(min(ts) FILTER (WHERE event_id % 3 <> 0)) + 1) % 100 AS VARCHAR), 2, '0') AS season,
  strftime(min(ts) FILTER (WHERE ts > TIMESTAMP '2024-02-10 00:00:00'), '%Y-%m-%d %H:%M') AS next FROM events""",
    "hot_slots": """WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS slot, bool_or(o_orderstatus = 'O') AS open FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY slot DESC) <= 2 AS recent FROM o) SELECT slot, recent FROM r WHERE open OR recent""",
    "stored_orders": "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v FROM orders GROUP BY 1",
    "rotation_asof_end": """WITH o AS (SELECT o_custkey, o_orderdate AS t, o_orderstatus = 'F' AS flag, year(o_orderdate) AS yr FROM orders), e AS (SELECT o_custkey, max(t) AS edge, max(t) FILTER (WHERE flag) AS f FROM o GROUP BY 1)
SELECT o_custkey, round(count(*) FILTER (WHERE flag) / count(*), 4) AS share, least(CAST(floor(date_diff('microsecond', max(f), max(edge)) / 86400000000) AS BIGINT), CASE WHEN max(f) IS NOT NULL THEN 60 END) AS days FROM o JOIN e USING (o_custkey) WHERE yr = year(edge) GROUP BY 1""",
    "congestion_ahead": """WITH o AS (SELECT o_custkey, CAST(floor(date_diff('microsecond', o_orderdate, TIMESTAMP '2001-06-30 12:00:00') / 86400000000) AS BIGINT) AS gap FROM orders WHERE o_orderdate < TIMESTAMP '2001-06-30 12:00:00')
SELECT o_custkey, min(gap) AS gap, count(*) FILTER (WHERE gap < 90) AS load FROM o GROUP BY 1""",
    "typed_log": """WITH e AS (SELECT nullif(user_id, 7) AS code, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts, event_id FROM events)
SELECT code, day, arg_max(k, (ts, event_id)) AS k FROM e WHERE code IS NOT NULL GROUP BY 1, 2""",
    "fixture_sides": """WITH l AS (SELECT l_suppkey AS h, l_partkey AS a, CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) % 5 END AS hg, CASE WHEN l_linestatus = 'F' THEN CAST(round(l_discount * 100) AS BIGINT) % 4 END AS ag FROM lineitem),
s AS (SELECT h AS team, true AS home, hg AS gf, ag AS ga FROM l UNION ALL SELECT a, false, ag, hg FROM l)
SELECT team, home, count(*) AS n, count(gf) AS played, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga, count(*) FILTER (WHERE ga = 0) AS clean FROM s GROUP BY 1, 2""",
}
