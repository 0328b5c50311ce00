"""Queries on reviews of forecasts, lead times and grades, penalties, difficulty, walks over rungs, and repaired dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cents, hash_uniform, odds, places
from ..functions import rules as R
from ..operators import feeds
from ..operators import reviews as V
from ..operators import simulation as S
from ..operators import squads as Q
from ..operators import strengths as Z
from ..sources.tables import table
from .reports import _forecast
from .seasons import NORMAL, SQUADS, UNIFORM, _squads


def gated_calibration(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.when(F.col("n_chars") % 13 > 0, F.least(F.col("n_chars") / 20000.0, F.lit(1.0))).alias("p"))
    rows = docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id")
    return V.gated_scores(rows, ["source", "lang"], "p", "y").select("source", "lang", "n", "status", places("brier").alias("brier"), places("log_loss").alias("log_loss"))


def starter_health(spark, d):
    """Mean error of each month's starters, and what became of the highest forecast (the captain; the first order of equals)."""
    f = _forecast(spark, d)
    best = F.max_by("a", F.struct("p", -F.col("o_orderkey")))
    return f.groupBy("slot").agg(places(F.avg(F.when(F.col("o_orderstatus") == "F", F.abs(F.col("p") - F.col("a")))), 2).alias("mae_starters"), best.alias("captain_actual"))


def starter_bias(spark, d):
    """Forecasts moved by the mean error of their priority's finished orders, as far as an order is likely to count."""
    f = _forecast(spark, d).withColumn("p", F.col("p").cast("double"))
    weight = F.when(F.col("o_orderkey") % 9 > 0, F.col("mo") / 12.0)
    return V.bias_shifted(f, "o_orderpriority", "p", "a", weight, F.col("o_orderstatus") == "F").select("o_orderkey", places("p", 3).alias("p"))


def sigma_floor(spark, d):
    """Spread of quantities by flags, with a floor of 5 added in quadrature."""
    li = table(spark, d, "lineitem").select("l_linestatus", "l_returnflag", F.col("l_quantity").cast("bigint").alias("q"))
    own = li.groupBy("l_linestatus", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("q").alias("s"))
    return own.select("l_linestatus", "l_returnflag", "n", places(F.sqrt(F.col("s") * F.col("s") + 25.0)).alias("sigma"))


def _log(spark, d):
    """Events as a log of statuses: slots of ten days, whose deadline is the eighth day; what happened on or after it is the outcome."""
    e = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), F.when(F.col("event_id") % 10 > 0, F.col("event_type")).alias("status"), cents("value").alias("v"))
    e = e.withColumn("slot", F.floor(F.datediff("day", F.lit("2024-01-01")) / 10).cast("bigint"))
    due = e.select("slot").distinct().withColumn("deadline", F.date_add(F.lit("2024-01-01"), (F.col("slot") * 10 + 7).cast("int")))
    log = V.before_deadline(e, due, "slot", "day")
    outcome = e.join(due, "slot").where("day >= deadline").groupBy("slot", "user_id").agg(F.max((F.col("v") > 9000).cast("int")).alias("started"))
    return log, outcome


def lead_histogram(spark, d):
    """How long before the deadline a status first changed, and whether its user then started."""
    log, outcome = _log(spark, d)
    rows = V.first_changes(log, ["slot", "user_id"], ["day", "event_id"], "status").join(outcome, ["slot", "user_id"])
    late = (F.col("final_status") != "") & (F.col("final_status").isin("error", "click") == (F.col("started") == 1))
    return rows.groupBy(V.lead_band(F.col("lead_days")).alias("band")).agg(F.count(F.when(F.col("started") == 1, 1)).alias("started"), F.count(F.when(F.col("started") == 0, 1)).alias("missed"), F.count(F.when(late, 1)).alias("late"))


def verdict_grades(spark, d):
    """The last known status before each deadline, graded by who then didn't start."""
    log, outcome = _log(spark, d)
    last = log.where("status is not null").groupBy("slot", "user_id").agg(F.max_by("status", F.struct("day", "event_id")).alias("verdict"))
    rows = last.join(outcome, ["slot", "user_id"]).select("verdict", (1 - F.col("started")).cast("bigint").alias("missed"))
    return V.grades(rows, "verdict", "missed").select("verdict", "n", "missed", places("precision", 6).alias("precision"), places("recall", 6).alias("recall"))


def captain_tiers(spark, d):
    o = table(spark, d, "orders")
    ledger = o.select("o_custkey", F.when((F.col("o_orderkey") % 11 > 0) & (F.col("o_orderkey") % 7 > 0), cents("o_totalprice") % 7 - 3).alias("delta"), (F.col("o_orderkey") % 5 == 0).alias("aligned"))
    return V.tiers(ledger, "o_custkey", "delta", "aligned").select("o_custkey", "reviewed", "graded", "wins", "losses", "aligned", "tier")


def biggest_misses(spark, d):
    """Of each month the twelve customers whose sums were farthest from their forecast, the first key of equals."""
    sums = _forecast(spark, d).groupBy("slot", "o_custkey").agg(F.sum("p").alias("p"), F.sum("a").alias("a")).withColumn("miss", F.col("a") - F.col("p"))
    best = sums.withColumn("place", F.row_number().over(S.Window.partitionBy("slot").orderBy(F.desc(F.abs("miss")), "o_custkey"))).where("place <= 12")
    return best.select("slot", "o_custkey", "p", "a", "miss", F.col("place").cast("bigint").alias("place"))


def penalty_blocks(spark, d):
    """Each month's events, taken by the first choice or not, a team-game and in points; the season's line, without a month, sums the months."""
    li = table(spark, d, "lineitem").select((F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("bigint").alias("slot"), "l_suppkey", "l_shipdate", (F.col("l_quantity") % 40 == 0).cast("bigint").alias("taken"), (F.col("l_linenumber") == 1).cast("bigint").alias("first"), F.when(F.col("l_returnflag") == "A", 4).when(F.col("l_returnflag") == "R", 6).otherwise(5).alias("points"))
    blocks = li.groupBy("slot").agg(F.count_distinct("l_suppkey", "l_shipdate").alias("games"), F.sum("taken").alias("taken"), F.sum(F.col("taken") * F.col("first")).alias("by_first"), F.sum(F.col("taken") * F.col("points")).alias("points"))
    lines = blocks.rollup("slot").agg(*[F.sum(c).alias(c) for c in ("games", "taken", "by_first", "points")])
    rate = lambda a, b, n: places(F.col(a) / F.nullif(F.col(b), F.lit(0)), n)
    return lines.select("slot", "games", "taken", "by_first", rate("by_first", "taken", 3).alias("hit_rate"), rate("taken", "games", 4).alias("per_game"), places(F.col("points") * R.PEN_CONVERSION, 3).alias("points"))


def attack_multipliers(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.exp(cents("s_acctbal") / 1000000.0).alias("x"))
    mean = s.agg(F.avg("x").alias("mean"))
    return s.join(F.broadcast(mean)).select("s_suppkey", places(R.clip(F.col("x") / F.col("mean"), *R.ATTACK_BOUNDS), 6).alias("multiplier"))  # one row


def penalty_increments(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 5).alias("o"), (F.col("p_partkey") % 4 / 4.0).alias("before"), F.when(F.col("p_partkey") % 6 > 0, F.col("p_size") % 3 * 0.7 + 0.4).alias("attack"), F.when(F.col("p_partkey") % 12 > 0, F.col("p_partkey") % 12 / 11.0).alias("plays"), F.col("p_partkey") % 15 % 4)
    kind = F.element_at(F.array(*map(F.lit, R.GOAL_POINTS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    found = R.penalty_increment(R.order_score(F.nullif("o", F.lit(0))), F.col("before"), F.col("attack"), R.goal_points(kind), F.col("plays"))
    return p.withColumn("x", found).select("p_partkey", places("x.goals", 6).alias("goals"), places("x.ep", 6).alias("ep"))


def fixture_difficulty(spark, d):
    """Open orders of the first eight months that have any, as fixtures between nations: by odds where there are some, else by ratings."""
    o = table(spark, d, "orders").where("o_orderstatus = 'O'").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("o_orderkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("slot"), F.col("c_nationkey").cast("bigint").alias("h"), (F.col("o_orderkey") % 25).alias("a")).where("h <> a")
    o = o.join(F.broadcast(o.select("slot").distinct().orderBy("slot").limit(8)), "slot")  # eight rows
    rating = lambda k: F.when(F.col(k) < 20, 1400.0 + F.col(k) * 12).otherwise(1500.0)
    home = R.expected_score(rating("h"), rating("a"), F.lit(True))
    sides = F.explode(F.array(F.struct(F.col("h").alias("own"), F.col("a").alias("other"), home.alias("win")), F.struct(F.col("a").alias("own"), F.col("h").alias("other"), (1 - home).alias("win"))))
    cells = o.select("slot", sides.alias("x")).select("slot", "x.*").withColumn("priced", (F.col("own") * 3 + F.col("other") * 3 + F.col("slot")) % 4 == 0)
    won = F.when(F.col("priced"), odds.win_probability((F.col("own") % 5 + 1) * 0.5, (F.col("other") % 5 + 1) * 0.5)).otherwise(F.col("win"))
    cells = cells.withColumn("d", F.round((1 - won) * 1000).cast("bigint"))
    sums = cells.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d"), F.max("priced").alias("any_odds"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("own"))
    return nations.join(sums, "own", "left").select("own", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(places(F.col("d") / F.col("n") / 1000, 3), F.lit(0.0)).alias("difficulty"), F.coalesce("any_odds", F.lit(False)).alias("any_odds"))


def ladder_walk(spark, d):
    """Line numbers of an order as rungs, by their best discount, on twenty shared draws; rungs past the fifth are above the cap."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("rung"), (F.round(F.col("l_discount") * 100).cast("bigint") * 100).alias("v"))
    # written out and not a function of an array, so that draws are compiled
    noisy = F.array(*[F.col("v") + F.floor(hash_uniform(F.col("l_orderkey"), F.col("rung"), draw) * 1000) for draw in range(20)])
    rungs = li.groupBy("l_orderkey", "rung").agg(F.max("v").alias("v")).select("l_orderkey", "rung", noisy.alias("values"), (F.col("rung") > 5).alias("capped"))
    return V.walk(rungs, "l_orderkey", "rung", "values", "capped", 0.42)


def same_as_rungs(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("rung"), F.concat_ws("|", "l_linestatus", "l_returnflag").alias("plan"))
    return V.repeats(li, "l_orderkey", "rung", "plan")


def seed_spread(spark, d):
    """A share of wins over hundred draws under each of five seeds: its mean, and how far the seeds lie apart."""
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") / 25.0).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("seed"))
    s = s.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(99))))
    won = s.groupBy("s_suppkey", "seed").agg(F.count(F.when(hash_uniform(F.col("s_suppkey"), F.col("seed"), F.col("draw")) < F.col("p"), 1)).alias("won"))
    return won.groupBy("s_suppkey").agg(places(F.sum("won") / 500).alias("p_win"), places((F.max("won") - F.min("won")) / 100).alias("spread"))


def availability_draws(spark, d):
    """Expected points of parts over draws in which each plays or doesn't; a certain one always does, an unknown one never."""
    p = table(spark, d, "part").select("p_partkey", (F.nullif(F.col("p_size") % 11, F.lit(0)) / 10.0).alias("p"), (cents("p_retailprice") % 12).alias("points"))
    p = p.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(39))))
    plays = hash_uniform(F.col("p_partkey"), F.col("draw")) < F.coalesce("p", F.lit(0.0))
    return p.groupBy("p_partkey").agg(F.count(F.when(plays, 1)).alias("played"), places(F.sum(F.when(plays, F.col("points")).otherwise(0)) / 40, 3).alias("mean"))


def field_rank(spark, d):
    """Groups of twenty customers as elements, fifteen drawn managers, twenty draws: how often my picks beat the median manager."""
    c = table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 20).cast("bigint").alias("squad"), "c_custkey", (cents("c_acctbal") / 100000.0).alias("mean"), (F.col("c_custkey") % 4).cast("double").alias("sigma"), (F.col("c_custkey") % 5 / 5.0).alias("owned"), F.when(F.col("c_custkey") % 20 == 3, 2).when(F.col("c_custkey") % 2 == 1, 1).otherwise(0).alias("mine"))
    out = S.field_rank(c, "squad", "c_custkey", "mean", "sigma", "owned", "mine", 20, 15)
    return out.select("squad", places("p_green", 6).alias("p_green"), places("median", 6).alias("median"), places("own", 6).alias("own"))


def effective_picks(spark, d):
    """Squads of parts as a chip week stored them: every third has no captain that starts, every seventh lacks a place."""
    p = _squads(spark, d).select("squad", "i", F.when((F.col("squad") % 7 > 0) | (F.col("i") != 4), F.col("i") + 1).alias("place"), F.when(F.col("i") == 6, 3).when(F.col("squad") % 2 == 0, 1).when(F.col("i") < 11, 1).otherwise(0).alias("m"))
    captain = F.when(F.col("squad") % 3 == 0, F.col("i") == 13).otherwise(F.col("i") == 6)
    p = p.withColumns({"captain": captain, "vice": (F.col("squad") % 2 == 0) & (F.col("i") == 8)})
    return Q.effective_multipliers(p, "squad", "place", "m", "captain", "vice").select("squad", "i", F.col("m").alias("multiplier"))


def local_day_match(spark, d):
    """Priced rows, dated by London's clock, against fixtures in UTC: how many find their customer's fixture of that local day, a year."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.timestamp_seconds(F.unix_date(F.to_date("o_orderdate")).cast("bigint") * 86400 + F.col("o_orderkey") % 48 * 1800).alias("kickoff"))
    o = o.withColumn("day", F.to_date(F.from_utc_timestamp("kickoff", "Europe/London")))
    fixtures = o.where("o_orderkey % 3 > 0").select("o_custkey", "day").distinct().withColumn("found", F.lit(1))
    priced = o.select("o_custkey", F.year("kickoff").cast("bigint").alias("yr"), F.when(F.col("o_orderkey") % 2 == 0, F.to_date("kickoff")).otherwise(F.col("day")).alias("day"))
    return priced.join(fixtures, ["o_custkey", "day"], "left").groupBy("yr").agg(F.count(F.lit(1)).alias("n"), F.count("found").alias("matched"), F.count(F.when(F.col("found").isNull(), 1)).alias("unmatched"))


def archive_dates(spark, d):
    """Dates in two forms or none that can be read."""
    o = table(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 10 == 9, "soon").when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yy")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    out = o.select("o_orderkey", R.first_date(raw, "dd/MM/yy", "dd/MM/yyyy").alias("day")).where("day is not null")
    return out.select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"))


def threshold_rows(spark, d):
    """Pages of standings (the few lines of an order) as JSON: the row of the greatest place, of equals the greatest total, if that is the fifth; broken pages give none."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").cast("bigint").alias("rank_sort"), cents("l_extendedprice").alias("total")).alias("x"))
    pages = li.groupBy("l_orderkey").agg(F.to_json(F.struct(F.struct(F.collect_list("x").alias("results")).alias("standings"))).alias("page"))
    pages = pages.withColumn("page", F.when(F.col("l_orderkey") % 11 == 0, F.substring("page", 1, 20)).otherwise(F.col("page")))
    rows = F.filter(F.from_json("page", "standings struct<results: array<struct<rank_sort: bigint, total: bigint>>>")["standings"]["results"], lambda r: r["rank_sort"].isNotNull())
    return pages.select("l_orderkey", F.array_max(rows).alias("top")).where("top.rank_sort = 5").select("l_orderkey", "top.rank_sort", "top.total")


def scoring_points(spark, d):
    """Rules as JSON, a number for all kinds or one a kind, as rule x kind points; a kind that a map lacks gets 0, saves count a third."""
    s = table(spark, d, "supplier").select("s_suppkey", F.format_string('{"goals": {"DEF": %d, "MID": 5}, "assists": %d, "saves": %d}', F.col("s_suppkey") % 7, F.col("s_suppkey") % 3, F.col("s_suppkey") % 4).alias("raw"))
    scalar = lambda k: F.try_to_number(F.get_json_object("raw", f"$.{k}"), F.lit("S999")).cast("double")
    cells = [F.struct(F.lit(k).alias("rule"), F.lit(p).alias("kind"), (F.coalesce(scalar(k), scalar(f"{k}.{p}"), F.lit(0.0)) / (3 if k == "saves" else 1)).alias("points")) for k in ("goals", "assists", "saves", "cards") for p in R.GOAL_POINTS]
    return s.select("s_suppkey", F.explode(F.array(*cells)).alias("x")).select("s_suppkey", "x.rule", "x.kind", places("x.points").alias("points"))


def carried_orders(spark, d):
    """Customers' months with the order that was stored for them then; months that the store hasn't seen get today's."""
    months = table(spark, d, "orders").groupBy("o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    stored = months.where("slot < 1996 * 12 and o_custkey % 3 > 0").select("o_custkey", "slot", (F.col("slot") % 5).alias("taker"))
    today = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.nullif(F.col("c_custkey") % 4, F.lit(0)).alias("taker"))
    return V.carried(months, stored, today, "o_custkey", "slot", "taker")


def coverage_gate(spark, d):
    """Names of a part list by brand; brands of which less than 0.3 is known go whole."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % (F.substring("p_brand", -1, 1).cast("int") + 1) == 0, F.col("p_partkey") + 1000).alias("code"))
    return V.covered(p, "p_brand", "code", 0.3)


def mode_rescale(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("k"), (F.col("l_quantity").cast("bigint") % 11 / 10.0).alias("p"))
    found = R.rescaled_modes(F.col("p"), F.col("p") * 0.8 + 0.05, (1 - F.col("p")) * 0.25, (1 - F.col("p")) * 0.75)
    return li.select("l_orderkey", "k", found.alias("x")).select("l_orderkey", "k", *[places(f"x.{c}", 6).alias(c) for c in ("absent", "sub", "start")])


def other_side_club(spark, d):
    """Orders as fixtures of a month between a customer's and another nation; lines as rows that know month, opponent and, some of them, the side."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("o_orderkey", F.datediff("o_orderdate", F.lit("1992-01-01")).alias("slot"), F.col("c_nationkey").cast("bigint").alias("home"), (F.col("o_orderkey") % 25).alias("away"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("bigint").alias("k"))
    at_home = F.col("k") % 2 == 0
    rows = li.join(o, "o_orderkey").select("o_orderkey", "k", "slot", F.when(at_home, F.col("away")).otherwise(F.col("home")).alias("opp"), F.when(F.col("k") == 3, at_home == F.lit(False)).when(F.col("k") != 5, ~at_home).alias("flag"), F.lit(-1).cast("bigint").alias("now"))
    rows = rows.withColumn("flag", F.when(F.col("k") == 4, F.col("flag")).otherwise(~F.col("flag")))
    return V.other_side(rows, o.select("slot", "home", "away"), ["slot"], "opp", "flag", "now", "club").select("o_orderkey", "k", "club")


def attached_verdicts(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").cast("bigint").alias("quality"))
    verdicts = table(spark, d, "documents").select("doc_id", F.col("lang").alias("verdict"))
    return V.with_carriers(rows, verdicts, "doc_id")


def open_play_totals(spark, d):
    """A supplier's lines of a year, with the worth of those that weren't returned, 0 where all were."""
    li = table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").cast("bigint").alias("yr"), "l_returnflag", cents("l_extendedprice").alias("v"))
    return li.groupBy("l_suppkey", "yr").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("l_returnflag") != "R", F.col("v")).otherwise(0)).alias("open_play"))


def horizon_decomposition(spark, d):
    """Totals by source and horizon, and what each lacks of the best source at the same horizon and of the shortest horizon of the same source."""
    li = table(spark, d, "lineitem").select("l_returnflag", F.floor(F.round(F.col("l_tax") * 100) / 3).cast("bigint").alias("horizon"), cents("l_extendedprice").alias("v"))
    grid = li.groupBy("l_returnflag", "horizon").agg(F.sum("v").alias("total"))
    by_source, by_horizon = S.Window.partitionBy("l_returnflag").orderBy("horizon"), S.Window.partitionBy("horizon")  # a row a cell of the grid
    return grid.select("l_returnflag", "horizon", "total", (F.first("total").over(by_source) - F.col("total")).alias("gap_horizon"), (F.max("total").over(by_horizon) - F.col("total")).alias("gap_source"))


def merged_availability(spark, d):
    """Parts as an official list, some of it listed as injured by the lines and hinted at by sizes; slot 6 is the present."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("code"), "p_size")
    status = F.element_at(F.array(*map(F.lit, "aidsun")), (F.col("p_size") % 6 + 1).cast("int"))
    official = p.select("code", status.alias("status"), F.when(F.col("p_size") % 4 > 0, F.col("p_size") % 4 * 25.0).alias("chance"))
    injuries = p.where("code % 3 > 0").select("code", F.concat(F.lit("type "), F.col("code") % 7).alias("injury_type"), F.when(F.col("code") % 5 > 0, F.col("code") % 10).alias("return_slot"), F.when(F.col("code") % 4 == 1, 25.0).alias("pct"), F.lit("press").alias("source"))
    lineups = p.where("code % 2 = 0").select("code", (F.col("p_size") / 50.0).alias("p_start_hint"))
    return feeds.merged_availability(official, injuries, lineups, 6)


def superseded_versions(spark, d):
    """Orders as versions of a customer's month, graded by a stamp that often exists."""
    v = table(spark, d, "orders").select("o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("slot"), F.col("o_orderkey").alias("stamp"))
    grades = v.where("o_custkey % 4 > 0").groupBy("o_custkey", "slot").agg((F.max("stamp") + F.when(F.col("o_custkey") % 5 == 0, 1_000_000_000).otherwise(0)).alias("stamp"))
    return feeds.superseded(v, grades, ["o_custkey", "slot"], "stamp")


def rival_strategy(spark, d):
    c = table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 8).cast("bigint").alias("league"), "c_custkey", F.floor(cents("c_acctbal") / 5000).alias("total"), (F.col("c_custkey") % 5 + 8).cast("double").alias("sigma"))
    out = feeds.strategy(c, "league", "c_custkey", "total", F.col("c_custkey") % 8 == 5, "sigma", 9, 0.5, 1.0, 0.25)
    return out.select("league", "rival", "gap", places("z", 6).alias("z"), places("dial", 6).alias("dial"), "stance")


def lane_odds(spark, d):
    """What my captain and my transfers are worth in chances to win a league of twenty, against two other choices on the same draws."""
    c = table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 20).cast("bigint").alias("league"), "c_custkey", (cents("c_acctbal") / 100000.0).alias("mean"), (F.col("c_custkey") % 4 + 1).cast("double").alias("sigma"))
    out = S.lane_gains(c, "league", "c_custkey", F.col("c_custkey") % 20 == 7, "mean", "sigma", {"captain": F.col("mean") + 1, "transfer": F.col("mean") - 2, "same": F.col("mean")}, 100)
    return out.select("league", "lane", places("gain", 4).alias("gain"))


def _matches(spark, d):
    """Orders as matches of a customer's nation against another, the goals from price and key."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select("o_orderkey", "o_orderpriority", "c_nationkey", (F.col("o_orderkey") % 25).alias("away"), (cents("o_totalprice") % 5).alias("hg"), (F.col("o_orderkey") % 7 % 4).alias("ag"), "o_orderdate").where("c_nationkey <> away")


def score_strengths(spark, d):
    """Strengths of nations in each priority's matches."""
    sums = Z.pair_sums(_matches(spark, d), ["o_orderpriority"], "c_nationkey", "away", "hg", "ag", "o_orderdate")
    found = Z.strengths(sums, ["o_orderpriority"])
    return found.select("o_orderpriority", "team", *[places(c).alias(c) for c in ("attack", "defence", "edge", "rho")], "weak")


def walk_forward_clean(spark, d):
    """Chances that either side of a match stays without a goal, each half-year by a refit on all before it."""
    m = _matches(spark, d).withColumn("fold", (F.year("o_orderdate") * 2 + F.floor((F.month("o_orderdate") - 1) / 6)).cast("bigint"))
    found = Z.walk_forward(m, ["o_orderpriority"], "fold", "c_nationkey", "away", "hg", "ag", "o_orderdate")
    return found.select("o_orderkey", "fold", *[places(c).alias(c) for c in ("lam", "mu", "home_clean", "away_clean")])


def priority_pivot(spark, d):
    """A customer's orders by status, a column each; a status without orders counts 0 and has no sum."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", cents("o_totalprice").alias("v"))
    wide = o.groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
    return wide.select("o_custkey", *[F.coalesce(f"{s}_n", F.lit(0)).alias(f"n_{s.lower()}") for s in "FOP"], *[F.col(f"{s}_v").alias(f"v_{s.lower()}") for s in "FOP"])


def history_rows(spark, d):
    """Entities' payloads as JSON, each with the rows of its history under other names; a payload without a history, or broken, has none."""
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, "{}").when(F.col("s_suppkey") % 11 == 0, '{"history": [').otherwise(
        F.format_string('{"history": [{"round": 1, "total_points": %d}, {"round": 2, "total_points": null, "new": true}, {"round": "x"}]}', F.col("s_suppkey") % 13)).alias("raw"))
    row = F.explode(F.from_json("raw", "history array<struct<round: string, total_points: string>>")["history"])
    return s.select("s_suppkey", row.alias("h")).select("s_suppkey", F.col("h.round").try_cast("bigint").alias("slot"), F.col("h.total_points").try_cast("bigint").alias("points"))


QUERIES = {
    f.__name__: f
    for f in (
        gated_calibration, starter_health, starter_bias, sigma_floor, lead_histogram, verdict_grades, captain_tiers, biggest_misses, penalty_blocks, attack_multipliers, penalty_increments,
        fixture_difficulty, ladder_walk, same_as_rungs, seed_spread, availability_draws, field_rank, effective_picks, local_day_match, archive_dates, threshold_rows, scoring_points,
        carried_orders, coverage_gate, mode_rescale, other_side_club, attached_verdicts, open_play_totals, horizon_decomposition,
        merged_availability, superseded_versions, rival_strategy, lane_odds, score_strengths, walk_forward_clean, priority_pivot, history_rows,
    )
}

CENTS = "CAST(round({} * 100) AS BIGINT)"
FORECAST = """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS v, year(o_orderdate) * 12 + month(o_orderdate) AS slot, month(o_orderdate) AS mo, o_orderdate FROM orders),
f AS (SELECT * FROM (SELECT *, CAST(floor(lag(v) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) / 10000) AS BIGINT) AS p, CAST(floor(v / 10000) AS BIGINT) AS a FROM o) WHERE p IS NOT NULL)"""
LOG = f"""WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, CASE WHEN event_id % 10 > 0 THEN event_type END AS status, {CENTS.format("value")} AS v, (CAST(ts AS DATE) - DATE '2024-01-01') // 10 AS slot FROM events),
x AS (SELECT *, DATE '2024-01-01' + CAST(slot * 10 + 7 AS INTEGER) AS due FROM e),
g AS (SELECT *, due - day AS lead FROM x WHERE day < due),
out AS (SELECT slot, user_id, max(CASE WHEN v > 9000 THEN 1 ELSE 0 END) AS started FROM x WHERE day >= due GROUP BY 1, 2)"""

ORACLE_SQL = {
    "gated_calibration": """WITH r AS (SELECT source, lang, CASE WHEN n_chars % 13 > 0 THEN least(n_chars / 20000, 1) END AS p, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id)),
c AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM r), k AS (SELECT source, lang, count(p) FILTER (WHERE y IS NOT NULL) AS n, avg((p - y) ** 2) AS b, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) FILTER (WHERE p IS NOT NULL) AS l FROM c GROUP BY 1, 2)
SELECT source, lang, n, CASE WHEN n >= 30 THEN 'scored' ELSE 'insufficient' END AS status, round(CASE WHEN n >= 30 THEN b END, 4) AS brier, round(CASE WHEN n >= 30 THEN l END, 4) AS log_loss FROM k""",
    "starter_health": f"""{FORECAST}, c AS (SELECT slot, a FROM f QUALIFY row_number() OVER (PARTITION BY slot ORDER BY p DESC, o_orderkey) = 1)
SELECT slot, round(avg(abs(p - f.a)) FILTER (WHERE o_orderstatus = 'F'), 2) AS mae_starters, any_value(c.a) AS captain_actual FROM f JOIN c USING (slot) GROUP BY 1""",
    "starter_bias": f"""{FORECAST}, b AS (SELECT o_orderpriority, avg(a - p) AS bias FROM f WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) >= 200)
SELECT o_orderkey, round(p + coalesce(CASE WHEN o_orderkey % 9 > 0 THEN mo / 12 END * bias, 0), 3) AS p FROM f LEFT JOIN b USING (o_orderpriority)""",
    "sigma_floor": "SELECT l_linestatus, l_returnflag, count(*) AS n, round(sqrt(var_pop(CAST(l_quantity AS BIGINT)) + 25), 4) AS sigma FROM lineitem GROUP BY 1, 2",
    "lead_histogram": f"""{LOG}, w AS (SELECT slot, user_id, lead, coalesce(status, '') AS s, row_number() OVER k AS i, first_value(coalesce(status, '')) OVER k AS f FROM g WINDOW k AS (PARTITION BY slot, user_id ORDER BY day, event_id)),
c AS (SELECT slot, user_id, arg_max(s, i) AS final, arg_min(lead, i) FILTER (WHERE s <> f) AS lead FROM w GROUP BY 1, 2 HAVING count(*) FILTER (WHERE s <> f) > 0)
SELECT CASE WHEN lead >= 7 THEN '7d+' WHEN lead >= 5 THEN '5-7d' WHEN lead >= 3 THEN '3-5d' WHEN lead >= 2 THEN '2-3d' WHEN lead >= 1 THEN '1-2d' ELSE '<1d' END AS band,
  count(*) FILTER (WHERE started = 1) AS started, count(*) FILTER (WHERE started = 0) AS missed, count(*) FILTER (WHERE final <> '' AND (final IN ('error', 'click')) = (started = 1)) AS late FROM c JOIN out USING (slot, user_id) GROUP BY 1""",
    "verdict_grades": f"""{LOG}, l AS (SELECT slot, user_id, status AS verdict FROM g WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY slot, user_id ORDER BY day DESC, event_id DESC) = 1),
r AS (SELECT verdict, 1 - started AS m FROM l JOIN out USING (slot, user_id))
SELECT verdict, count(*) AS n, CAST(sum(m) AS BIGINT) AS missed, round(sum(m) / count(*), 6) AS precision, round(coalesce(sum(m) / nullif((SELECT sum(m) FROM r), 0), 0), 6) AS recall FROM r GROUP BY 1""",
    "captain_tiers": f"""WITH l AS (SELECT o_custkey, CASE WHEN o_orderkey % 11 > 0 AND o_orderkey % 7 > 0 THEN {CENTS.format("o_totalprice")} % 7 - 3 END AS x, o_orderkey % 5 = 0 AS al FROM orders),
s AS (SELECT o_custkey, count(*) AS reviewed, count(*) FILTER (WHERE NOT al AND x < 0) AS wins, count(*) FILTER (WHERE NOT al AND x > 0) AS losses, count(*) FILTER (WHERE al) AS aligned FROM l GROUP BY 1)
SELECT o_custkey, reviewed, wins + losses AS graded, wins, losses, aligned, CASE WHEN wins + losses < 4 THEN 'early' WHEN wins > losses THEN 'backed' ELSE 'mixed' END AS tier FROM s""",
    "biggest_misses": f"""{FORECAST}, s AS (SELECT slot, o_custkey, CAST(sum(p) AS BIGINT) AS p, CAST(sum(a) AS BIGINT) AS a FROM f GROUP BY 1, 2)
SELECT *, a - p AS miss, row_number() OVER (PARTITION BY slot ORDER BY abs(a - p) DESC, o_custkey) AS place FROM s QUALIFY place <= 12""",
    "penalty_blocks": """WITH l AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) AS slot, l_suppkey, l_shipdate, CASE WHEN l_quantity % 40 = 0 THEN 1 ELSE 0 END AS t, CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS f, CASE l_returnflag WHEN 'A' THEN 4 WHEN 'R' THEN 6 ELSE 5 END AS w FROM lineitem),
b AS (SELECT slot, count(DISTINCT (l_suppkey, l_shipdate)) AS games, sum(t) AS taken, sum(t * f) AS by_first, sum(t * w) AS points FROM l GROUP BY 1)
SELECT slot, CAST(sum(games) AS BIGINT) AS games, CAST(sum(taken) AS BIGINT) AS taken, CAST(sum(by_first) AS BIGINT) AS by_first, round(sum(by_first) / nullif(sum(taken), 0), 3) AS hit_rate, round(sum(taken) / nullif(sum(games), 0), 4) AS per_game, round(CAST(sum(points) AS DOUBLE) * 0.78::DOUBLE, 3) AS points FROM b GROUP BY ROLLUP (slot)""",
    "attack_multipliers": f"WITH s AS (SELECT s_suppkey, exp({CENTS.format('s_acctbal')} / 1000000) AS x FROM supplier) SELECT s_suppkey, round(least(greatest(x / (SELECT avg(x) FROM s), 0.6), 1.6), 6) AS multiplier FROM s",
    "penalty_increments": """WITH p AS (SELECT p_partkey, CASE p_size % 5 WHEN 1 THEN 1::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS now, p_partkey % 4 / 4 AS before, CASE WHEN p_partkey % 6 > 0 THEN p_size % 3 * 0.7::DOUBLE + 0.4::DOUBLE ELSE 1::DOUBLE END AS attack, p_partkey % 12 / 11 AS plays, CASE p_partkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 6 WHEN 2 THEN 5 ELSE 4 END AS pts FROM part),
g AS (SELECT *, (now - before) * 0.13::DOUBLE * least(greatest(attack, 0.6::DOUBLE), 1.6::DOUBLE) * 0.78::DOUBLE AS goals FROM p)
SELECT p_partkey, round(CASE WHEN goals * pts * plays = 0 THEN 0::DOUBLE ELSE goals * least(greatest(goals * pts * plays, -0.3::DOUBLE), 0.8::DOUBLE) / (goals * pts * plays) END, 6) AS goals, round(least(greatest(goals * pts * plays, -0.3::DOUBLE), 0.8::DOUBLE), 6) AS ep FROM g""",
    "fixture_difficulty": """WITH o AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS slot, CAST(c_nationkey AS BIGINT) AS h, o_orderkey % 25 AS a FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND c_nationkey <> o_orderkey % 25),
u AS (SELECT * FROM o WHERE slot IN (SELECT DISTINCT slot FROM o ORDER BY slot LIMIT 8)),
r AS (SELECT *, 1 / (1 + pow(10, -(CASE WHEN h < 20 THEN 1400 + h * 12 ELSE 1500 END + 60 - CASE WHEN a < 20 THEN 1400 + a * 12 ELSE 1500 END) / 400)) AS w FROM u),
s AS (SELECT slot, h AS own, a AS other, w FROM r UNION ALL SELECT slot, a, h, 1 - w FROM r),
q AS (SELECT x, y, sum(exp(-x) * pow(x, i) / factorial(i::INTEGER) * exp(-y) * pow(y, j) / factorial(j::INTEGER)) AS won FROM (SELECT k * 0.5::DOUBLE AS x FROM range(1, 6) k(k)), (SELECT k * 0.5::DOUBLE AS y FROM range(1, 6) k(k)), range(1, 11) i(i), range(0, 10) j(j) WHERE j < i GROUP BY 1, 2),
c AS (SELECT own, (own * 3 + other * 3 + slot) % 4 = 0 AS priced, CAST(round((1 - CASE WHEN (own * 3 + other * 3 + slot) % 4 = 0 THEN won ELSE w END) * 1000) AS BIGINT) AS d FROM s JOIN q ON q.x = (own % 5 + 1) * 0.5::DOUBLE AND q.y = (other % 5 + 1) * 0.5::DOUBLE),
g AS (SELECT own, count(*) AS n, sum(d) AS d, bool_or(priced) AS o FROM c GROUP BY 1)
SELECT CAST(n_nationkey AS BIGINT) AS own, coalesce(n, 0) AS n, coalesce(round(CAST(d AS DOUBLE) / n / 1000, 3), 0) AS difficulty, coalesce(o, false) AS any_odds FROM nation LEFT JOIN g ON own = n_nationkey""",
    "ladder_walk": f"""WITH l AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS k, max(CAST(round(l_discount * 100) AS BIGINT) * 100) AS v, unnest(range(0, 20)) AS draw FROM lineitem GROUP BY 1, 2),
n AS (SELECT l_orderkey, k, draw, v + CAST(floor({UNIFORM.format(x="l_orderkey || '|' || k || '|' || draw")} * 1000) AS BIGINT) AS v FROM l),
p AS (SELECT *, lag(k) OVER w AS below, lag(v) OVER w AS low FROM n WINDOW w AS (PARTITION BY l_orderkey, draw ORDER BY k)),
s AS (SELECT l_orderkey, below, k AS above, round(avg(CASE WHEN v > low THEN 1 ELSE 0 END), 4) AS share FROM p WHERE below IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT *, above <= 5 AND share >= 0.42 AS taken FROM s)
SELECT * EXCLUDE (open) FROM (SELECT *, coalesce(bool_and(taken) OVER (PARTITION BY l_orderkey ORDER BY above ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS open FROM t) WHERE open""",
    "same_as_rungs": """WITH l AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS rung, l_linestatus || '|' || l_returnflag AS plan FROM lineitem), m AS (SELECT *, min(rung) OVER (PARTITION BY l_orderkey, plan) AS f FROM l)
SELECT l_orderkey, rung, plan, CASE WHEN f < rung THEN f END AS same_as FROM m""",
    "seed_spread": f"""WITH s AS (SELECT s_suppkey, s_nationkey / 25 AS p, seed, draw FROM supplier, range(0, 5) x(seed), range(0, 100) y(draw)),
w AS (SELECT s_suppkey, seed, count(*) FILTER (WHERE {UNIFORM.format(x="s_suppkey || '|' || seed || '|' || draw")} < p) AS won FROM s GROUP BY 1, 2)
SELECT s_suppkey, round(sum(won) / 500, 4) AS p_win, round((max(won) - min(won)) / 100, 4) AS spread FROM w GROUP BY 1""",
    "availability_draws": f"""WITH p AS (SELECT p_partkey, p_size % 11 / 10 AS p, {CENTS.format("p_retailprice")} % 12 AS points, unnest(range(0, 40)) AS draw FROM part),
h AS (SELECT *, {UNIFORM.format(x="p_partkey || '|' || draw")} < p AS plays FROM p)
SELECT p_partkey, count(*) FILTER (WHERE plays) AS played, round(coalesce(sum(points) FILTER (WHERE plays), 0) / 40, 3) AS mean FROM h GROUP BY 1""",
    "field_rank": f"""WITH c AS (SELECT c_custkey // 20 AS squad, c_custkey, {CENTS.format("c_acctbal")} / 100000 AS mean, c_custkey % 4 AS sigma, c_custkey % 5 / 5 AS owned, CASE WHEN c_custkey % 20 = 3 THEN 2 WHEN c_custkey % 2 = 1 THEN 1 ELSE 0 END AS mine, unnest(range(0, 20)) AS draw FROM customer),
v AS (SELECT *, CAST(floor((mean + sigma * {NORMAL.format(x="squad || '|' || c_custkey || '|' || draw")}) * 1000) AS BIGINT) AS v FROM c), m AS (SELECT v.*, manager FROM v, range(0, 15) t(manager)),
t AS (SELECT squad, draw, manager, sum(CASE WHEN {UNIFORM.format(x="squad || '|' || c_custkey || '|' || manager || '|owns'")} < owned THEN v ELSE 0 END) AS total, sum(v * mine) AS own FROM m GROUP BY 1, 2, 3),
w AS (SELECT squad, draw, CAST(quantile_cont(total, 0.5) AS DOUBLE) AS med, CAST(max(own) AS DOUBLE) AS own FROM t GROUP BY 1, 2)
SELECT squad, round(avg(CASE WHEN own > med THEN 1 ELSE 0 END), 6) AS p_green, round(avg(med) / 1000, 6) AS median, round(avg(own) / 1000, 6) AS own FROM w GROUP BY 1""",
    "effective_picks": f"""{SQUADS}, p2 AS (SELECT squad, i, CASE WHEN squad % 7 > 0 OR i <> 4 THEN i + 1 END AS place, CASE WHEN i = 6 THEN 3 WHEN squad % 2 = 0 THEN 1 WHEN i < 11 THEN 1 ELSE 0 END AS m, CASE WHEN squad % 3 = 0 THEN i = 13 ELSE i = 6 END AS cap, squad % 2 = 0 AND i = 8 AS vice FROM s),
c AS (SELECT *, CASE WHEN place <= 11 AND cap THEN 100 + place WHEN place <= 11 AND vice THEN 200 + place WHEN place <= 11 AND m >= 2 THEN 300 + place END AS claim FROM p2),
w AS (SELECT *, min(claim) OVER (PARTITION BY squad) AS best, bool_or(place IS NULL) OVER (PARTITION BY squad) AS unknown FROM c)
SELECT squad, i, CAST(multiplier AS BIGINT) AS multiplier FROM (SELECT squad, i, CASE WHEN unknown THEN least(m, 2) WHEN place <= 11 THEN CASE WHEN claim = best THEN 2 ELSE 1 END END AS multiplier FROM w) WHERE multiplier > 0""",
    "local_day_match": """WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 48 * 30 AS BIGINT)) AS t FROM orders),
y AS (SELECT *, make_date(year(t), 3, 31) AS m31, make_date(year(t), 10, 31) AS o31 FROM o),
s AS (SELECT *, t >= m31 - dayofweek(m31)::INTEGER + INTERVAL 1 HOUR AND t < o31 - dayofweek(o31)::INTEGER + CASE WHEN year(t) < 1996 AND dayofweek(o31) IN (0, 1, 2) THEN INTERVAL 1 HOUR - INTERVAL 7 DAY ELSE INTERVAL 1 HOUR END AS bst FROM y),
d AS (SELECT *, CAST(CASE WHEN bst THEN t + INTERVAL 1 HOUR ELSE t END AS DATE) AS day FROM s), f AS (SELECT DISTINCT o_custkey, day FROM d WHERE o_orderkey % 3 > 0),
p AS (SELECT o_custkey, year(t) AS yr, CASE WHEN o_orderkey % 2 = 0 THEN CAST(t AS DATE) ELSE day END AS day FROM d)
SELECT yr, count(*) AS n, count(f.day) AS matched, count(*) - count(f.day) AS unmatched FROM p LEFT JOIN f USING (o_custkey, day) GROUP BY 1""",
    "archive_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 10 <> 9",
    "threshold_rows": f"SELECT l_orderkey, 5::BIGINT AS rank_sort, max({CENTS.format('l_extendedprice')}) FILTER (WHERE l_linenumber = 5) AS total FROM lineitem WHERE l_orderkey % 11 > 0 GROUP BY 1 HAVING max(l_linenumber) = 5",
    "scoring_points": """WITH r AS (SELECT s_suppkey, rule, kind FROM supplier, (VALUES ('goals'), ('assists'), ('saves'), ('cards')) a(rule), (VALUES ('GKP'), ('DEF'), ('MID'), ('FWD')) b(kind))
SELECT s_suppkey, rule, kind, round(CASE WHEN rule = 'goals' AND kind = 'DEF' THEN s_suppkey % 7 WHEN rule = 'goals' AND kind = 'MID' THEN 5 WHEN rule = 'assists' THEN s_suppkey % 3 WHEN rule = 'saves' THEN s_suppkey % 4 / 3 ELSE 0 END::DOUBLE, 4) AS points FROM r""",
    "carried_orders": """WITH m AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS slot, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT o_custkey, slot, slot % 5 AS taker FROM m WHERE slot < 1996 * 12 AND o_custkey % 3 > 0)
SELECT o_custkey, slot, n, CASE WHEN slot IN (SELECT slot FROM s) THEN s.taker ELSE nullif(o_custkey % 4, 0) END AS taker FROM m LEFT JOIN s USING (o_custkey, slot)""",
    "coverage_gate": """WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % (CAST(right(p_brand, 1) AS INTEGER) + 1) = 0 THEN p_partkey + 1000 END AS code FROM part)
SELECT * FROM p WHERE code IS NOT NULL AND p_brand IN (SELECT p_brand FROM p GROUP BY 1 HAVING count(code) / count(*) >= 0.3)""",
    "mode_rescale": """WITH l AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS k, CAST(l_quantity AS BIGINT) % 11 / 10 AS p FROM lineitem)
SELECT l_orderkey, k, round(p * 0.8::DOUBLE + 0.05::DOUBLE, 6) AS absent, round((0.95::DOUBLE - p * 0.8::DOUBLE) * CASE WHEN p < 1 THEN 0.25::DOUBLE ELSE 1 END, 6) AS sub, round((0.95::DOUBLE - p * 0.8::DOUBLE) * CASE WHEN p < 1 THEN 0.75::DOUBLE ELSE 0 END, 6) AS start FROM l""",
    "other_side_club": """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) - DATE '1992-01-01' AS slot, CAST(c_nationkey AS BIGINT) AS home, o_orderkey % 25 AS away FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT slot, away AS opp, home AS club, true AS h FROM o UNION ALL SELECT slot, home, away, false FROM o), u AS (SELECT slot, opp, any_value(club) AS club, any_value(h) AS h FROM s GROUP BY 1, 2 HAVING count(*) = 1),
r AS (SELECT o_orderkey, CAST(l_linenumber AS BIGINT) AS k, slot, CASE WHEN l_linenumber % 2 = 0 THEN away ELSE home END AS opp, CASE l_linenumber WHEN 5 THEN NULL WHEN 3 THEN false WHEN 4 THEN false ELSE l_linenumber % 2 = 0 END AS flag FROM lineitem JOIN o ON l_orderkey = o_orderkey)
SELECT o_orderkey, k, coalesce(CASE WHEN flag IS NULL OR flag = h THEN club END, -1) AS club FROM r LEFT JOIN u USING (slot, opp)""",
    "attached_verdicts": """WITH r AS (SELECT doc_id, CAST(quality AS BIGINT) AS quality FROM labels), v AS (SELECT doc_id, lang AS verdict FROM documents)
SELECT doc_id, quality, verdict FROM r FULL JOIN v USING (doc_id)""",
    "open_play_totals": f"SELECT l_suppkey, year(l_shipdate) AS yr, count(*) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE {CENTS.format('l_extendedprice')} END) AS BIGINT) AS open_play FROM lineitem GROUP BY 1, 2",
    "horizon_decomposition": f"""WITH g AS (SELECT l_returnflag, CAST(floor(round(l_tax * 100) / 3) AS BIGINT) AS horizon, CAST(sum({CENTS.format("l_extendedprice")}) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2)
SELECT *, first_value(total) OVER (PARTITION BY l_returnflag ORDER BY horizon) - total AS gap_horizon, max(total) OVER (PARTITION BY horizon) - total AS gap_source FROM g""",
    "merged_availability": """WITH p AS (SELECT p_partkey AS code, p_size AS z, CASE p_size % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'i' WHEN 2 THEN 'd' WHEN 3 THEN 's' WHEN 4 THEN 'u' ELSE 'n' END AS st, CASE WHEN p_size % 4 > 0 THEN p_size % 4 * 25::DOUBLE END AS ch FROM part),
n AS (SELECT *, st NOT IN ('s', 'u', 'n') AS o, code % 3 > 0 AND (code % 5 = 0 OR code % 10 >= 6) AS hit FROM p),
k AS (SELECT *, CASE WHEN o AND hit THEN least(CASE WHEN code % 5 > 0 THEN CASE WHEN code % 10 > 6 THEN 0 ELSE 50 END END, CASE WHEN code % 4 = 1 THEN 25 END)::DOUBLE END AS nc FROM n)
SELECT code, CASE WHEN nc < coalesce(ch, 101) AND st NOT IN ('i', 'd') THEN 'i' ELSE st END AS status, CASE WHEN nc < coalesce(ch, 101) THEN nc ELSE ch END AS chance, CASE WHEN o AND hit THEN 'type ' || code % 7 END AS injury_type, CASE WHEN o AND hit AND code % 5 > 0 THEN code % 10 END AS return_slot,
  CASE WHEN o AND code % 2 = 0 THEN z / 50 END AS p_start_hint, CASE WHEN o THEN CASE WHEN hit THEN 'press' WHEN code % 2 = 0 THEN 'lineups' END END AS source FROM k""",
    "superseded_versions": """WITH v AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS slot, o_orderkey AS stamp FROM orders)
SELECT * FROM v WHERE o_custkey % 4 > 0 AND o_custkey % 5 > 0 QUALIFY stamp < max(stamp) OVER (PARTITION BY o_custkey, slot)""",
    "rival_strategy": f"""WITH c AS (SELECT c_custkey // 8 AS league, c_custkey, CAST(floor({CENTS.format("c_acctbal")} / 5000) AS BIGINT) AS total, c_custkey % 5 + 8 AS sigma FROM customer),
m AS (SELECT league, total AS own FROM c WHERE c_custkey % 8 = 5), r AS (SELECT c.*, own, (own - total) / (sigma * 3)::DOUBLE AS norm FROM c JOIN m USING (league) WHERE c_custkey % 8 <> 5),
k AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY CASE WHEN top > own THEN -total ELSE norm END, c_custkey) AS i FROM (SELECT *, max(total) OVER (PARTITION BY league) AS top FROM r)),
z AS (SELECT league, c_custkey AS rival, abs(own - total) AS gap, CASE WHEN abs(norm) < 0.25 THEN 0 ELSE -norm END AS z FROM k WHERE i = 1)
SELECT league, rival, gap, round(z, 6) AS z, round(0.5 * tanh(abs(z)) * sign(z), 6) AS dial, CASE WHEN z = 0 THEN 'neutral' WHEN z > 0 THEN 'chase' ELSE 'defend' END AS stance FROM z""",
    "lane_odds": f"""WITH c AS (SELECT c_custkey // 20 AS league, c_custkey, {CENTS.format("c_acctbal")} / 100000 AS mean, c_custkey % 4 + 1 AS sigma, unnest(range(0, 100)) AS draw FROM customer),
v AS (SELECT *, sigma * {NORMAL.format(x="league || '|' || c_custkey || '|' || draw")} AS noise FROM c), b AS (SELECT league, draw, max(mean + noise) AS best FROM v WHERE c_custkey % 20 <> 7 GROUP BY 1, 2),
o AS (SELECT v.*, lane, best, mean + add AS other FROM v JOIN b USING (league, draw), (VALUES ('captain', 1), ('transfer', -2), ('same', 0)) l(lane, add) WHERE c_custkey % 20 = 7)
SELECT league, lane, round((avg(CASE WHEN mean + noise > best THEN 1 ELSE 0 END) - avg(CASE WHEN other + noise > best THEN 1 ELSE 0 END)) * 100, 4) AS gain FROM o GROUP BY 1, 2""",
    "priority_pivot": f"""WITH o AS (SELECT o_custkey, o_orderstatus AS s, {CENTS.format("o_totalprice")} AS v FROM orders)
SELECT o_custkey, count(*) FILTER (WHERE s = 'F') AS n_f, count(*) FILTER (WHERE s = 'O') AS n_o, count(*) FILTER (WHERE s = 'P') AS n_p, CAST(sum(v) FILTER (WHERE s = 'F') AS BIGINT) AS v_f, CAST(sum(v) FILTER (WHERE s = 'O') AS BIGINT) AS v_o, CAST(sum(v) FILTER (WHERE s = 'P') AS BIGINT) AS v_p FROM o GROUP BY 1""",
    "history_rows": """SELECT s_suppkey, slot::BIGINT AS slot, CASE WHEN slot = 1 THEN s_suppkey % 13 END AS points FROM supplier, (VALUES (1), (2), (NULL)) r(slot) WHERE s_suppkey % 7 > 0 AND s_suppkey % 11 > 0""",
}
