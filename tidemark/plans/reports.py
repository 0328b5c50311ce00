"""Queries on scores of forecasts, boundaries, plans and ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cents, places
from ..functions import rules as R
from ..operators import reports as P
from ..sources.tables import table

GRID = (0, 1, 2, 5, 10, 20, 50)


def _orders(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate", cents("o_totalprice").alias("v"), F.year("o_orderdate").cast("bigint").alias("yr"), F.month("o_orderdate").cast("bigint").alias("mo"))


def _forecast(spark, d):
    """The last order of a customer as a forecast of the next, in hundreds."""
    before = F.lag("v").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return _orders(spark, d).withColumn("p", F.floor(before / 10000).cast("bigint")).withColumn("a", F.floor(F.col("v") / 10000).cast("bigint")).withColumn("slot", F.col("yr") * 12 + F.col("mo")).where("p is not null")


def top1_top15_metrics(spark, d):
    out = P.ranking_metrics(_forecast(spark, d), "slot", "o_orderkey", "p", "a", F.col("o_orderstatus") == "F")
    return out.select("n", *[places(c, 3).alias(c) for c in ("mae_all", "mae_starters", "rmse_starters", "top1", "top15")])


def baseline_predictor(spark, d):
    """Error of a naive forecast, the first known one of a customer and slot, by size of the outcome."""
    first = _forecast(spark, d).groupBy("o_custkey", "slot").agg(F.min_by("p", F.struct("o_orderdate", "o_orderkey")).alias("p"), F.sum("a").alias("a"))
    size = F.when(F.col("a") < 1000, "low").otherwise("high")
    return first.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"), places(F.avg(F.abs(F.col("p") - F.col("a"))), 3).alias("mae"))


def corr_grid_search(spark, d):
    """How strong to shrink a customer's mean of earlier years to the mean of all, judged by the correlation with the last year."""
    o = _orders(spark, d)
    last = o.agg(F.max("yr").alias("last"))
    o = o.join(F.broadcast(last))  # one row
    own = o.groupBy("o_custkey").agg(F.sum(F.when(F.col("yr") < F.col("last"), F.col("v"))).alias("s"), F.count(F.when(F.col("yr") < F.col("last"), 1)).alias("n"), F.avg(F.when(F.col("yr") == F.col("last"), F.col("v"))).alias("y"))
    own = own.where("n > 0 and y is not null")
    mean = own.agg((F.sum("s") / F.sum("n")).alias("mean"))
    own = own.join(F.broadcast(mean))  # one row
    found = P.correlation_grid(own, GRID, lambda k: (F.col("s") + k * F.col("mean")) / (F.col("n") + k), "y")
    return found.select("k", places("corr", 5).alias("corr"), (F.rank().over(Window.orderBy(F.desc(F.round("corr", 8)), "k")) == 1).alias("best"))  # a row a grid value


def lever_corr(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("bigint").alias("q"), cents("l_extendedprice").alias("v"))
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), places(F.corr("q", "v"), 5).alias("corr"))


def blend_weight_1se(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.least(F.col("n_chars") / 6000.0, F.lit(0.95)).alias("a"), F.when(F.col("lang") == "en", 0.7).otherwise(0.5).alias("b"))
    rows = docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("bigint").alias("y")), "doc_id")
    return P.blend_weight(rows, "a", "b", "y", 0.05)


def holdout_slots(spark, d):
    """Orders before and from the tenth month from the end."""
    o = _orders(spark, d)
    at = P.nth_last_slot(o, ["yr", "mo"], 10).select(F.struct("yr", "mo").alias("at"))
    held = o.join(F.broadcast(at)).withColumn("held_out", ~(F.struct("yr", "mo") < F.col("at")))  # one row
    return held.groupBy("held_out").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


def suffix_count_floor(spark, d):
    o = _orders(spark, d)
    floor = P.suffix_floor(o, "yr", F.col("o_orderstatus") == "F", 300)
    new = o.agg(F.coalesce(F.min(F.when(F.col("o_orderpriority") > "4", F.col("yr"))), F.max("yr") + 1).alias("first_new"))
    return floor.join(F.broadcast(new)).select("yr", "first_new")  # a row each


def overlapping_strata(spark, d):
    """Error of the forecast in strata that overlap, and in all rows."""
    f = _forecast(spark, d)
    tests = {"all": F.lit(True), "fringe": F.col("v") % 10 < 3, "regular": F.col("v") % 10 >= 3, "early": F.col("mo") <= 4, "settled": F.col("mo") > 4, "absent": F.col("p") <= 1000, "present": F.col("p") > 1000}
    strata = F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])
    rows = f.select(F.explode(F.filter(strata, lambda x: x.isNotNull())).alias("stratum"), F.abs(F.col("p") - F.col("a")).alias("e"))
    return rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), places(F.avg("e"), 3).alias("mae"))


def watch_alerts(spark, d):
    """Watched parts whose price moved by a tenth or more; unknown moves never alert."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", (cents("p_retailprice") % 2001 / 50.0 - 20).alias("pct"))
    watched = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    alerts = p.withColumn("pct", F.when(F.col("p_partkey") % 9 > 0, F.col("pct"))).where(F.abs("pct") >= 10).join(watched, "p_partkey", "left_semi")
    return alerts.select("p_partkey", places("pct", 2).alias("pct"), R.direction(F.col("pct")).alias("direction"))


def price_falls(spark, d):
    """Falls on the newest day, as chances."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), (cents("value") - 10000).alias("x"))
    newest = e.agg(F.max("day").alias("day"))
    return e.join(F.broadcast(newest), "day").where("x < 0").groupBy("user_id").agg(F.max(F.least(F.lit(1.0), F.abs("x") / 10000.0)).alias("p")).select("user_id", places("p", 3).alias("p"))


def latest_before_deadline(spark, d):
    """Of each user and month the last event before the 20th, else the last, flagged."""
    e = table(spark, d, "events").withColumn("key", F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM")))
    deadline = F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM"), F.lit("-20 00:00:00")))
    found = P.latest_before(e.select("key", "ts", "event_id", deadline.alias("deadline")), "key", "ts", ["event_id"], F.col("deadline"))
    return found.select("key", "event_id", "late")


def last_four_values(spark, d):
    out = P.last_values(_orders(spark, d), "o_custkey", ["o_orderdate", "o_orderkey"], "v", 4)
    return out.select("o_custkey", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("last4"))


def threshold_projection(spark, d):
    """Each type's monthly sum, drawn on to month 60 from its first and last month."""
    e = table(spark, d, "events").groupBy("event_type", F.floor(F.dayofyear("ts") / 3).cast("bigint").alias("slot")).agg(F.sum(cents("value")).alias("v"))
    out = P.projected(e, "event_type", "slot", "v", F.lit(60))
    return out.select("event_type", "weeks", places("rise", 3).alias("rise"), places("value", 2).alias("value"))


def modal_plans(spark, d):
    """Of each customer's plans (priorities) the most frequent, the dearer of equals, and what it leads the best other by."""
    plans = _orders(spark, d).groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("v"))
    out = P.modal_plan(plans, "o_custkey", "n", "v")
    return out.select("o_custkey", F.col("count").alias("n"), F.col("value").alias("v"), "runner_up", "margin")


def reason_means(spark, d):
    """Count and mean change per reason; orders without a note (odd keys) stand under none."""
    f = _forecast(spark, d)
    reason = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("no note")
    return f.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), places(F.avg(F.col("a") - F.col("p")), 1).alias("mean_delta"))


def lane_summary(spark, d):
    """A ledger's lanes by year, and their totals."""
    f = _forecast(spark, d).withColumn("won", F.col("a") > F.col("p"))
    sums = f.rollup("o_orderpriority", "yr").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("won"), 1)).alias("won"), F.sum(F.col("a") - F.col("p")).alias("delta"))
    return sums.where("g < 3").select("o_orderpriority", "yr", "n", "won", "delta")


def move_frequencies(spark, d):
    """In what share of orders (scenarios) each part type and flag (move) comes up, counted once an order."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    moves = li.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select("l_orderkey", "p_brand", "l_returnflag").distinct()
    n = table(spark, d, "lineitem").agg(F.count_distinct("l_orderkey").alias("all"))
    return moves.groupBy("p_brand", "l_returnflag").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(n)).select("p_brand", "l_returnflag", "n", places(F.col("n") / F.col("all"), 5).alias("share"))  # one row


def label_points(spark, d):
    """Points by label of a log, rows without one left out."""
    o = _orders(spark, d).withColumn("chip", F.nullif(F.regexp_extract("o_orderpriority", "-(.*)", 1), F.lit("LOW")))
    return o.where("chip is not null and chip <> ''").groupBy("chip").agg(F.sum("v").alias("points"), F.count(F.lit(1)).alias("n"))


def grouped_actuals(spark, d):
    """Rows of one customer and month as one: mean chance, sum of minutes, whether any was played, the first key."""
    o = _orders(spark, d)
    out = o.groupBy("o_custkey", "yr", "mo").agg(places(F.avg((F.col("v") % 100) / 100.0)).alias("p"), F.sum("v").alias("v"), F.bool_or(F.col("o_orderstatus") == "F").alias("played"), F.min("o_orderkey").alias("first"))
    return out.select("o_custkey", F.concat_ws("-", F.col("yr").cast("string"), F.col("mo").cast("string")).alias("slot"), "p", "v", "played", "first")


def mean_per_slot(spark, d):
    """Sum over a part's lines by the number of distinct slots of all, and the root of its summed variances."""
    li = table(spark, d, "lineitem").select("l_partkey", F.month("l_shipdate").alias("slot"), F.col("l_quantity").cast("bigint").alias("q"))
    slots = li.agg(F.count_distinct("slot").alias("slots"))
    own = li.groupBy("l_partkey").agg(F.sum("q").alias("q"), F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("s"))
    return own.join(F.broadcast(slots)).select("l_partkey", places(F.col("q") / F.col("slots")).alias("ep"), places(F.col("s") / F.sqrt("slots")).alias("sigma"))  # one row


def ensemble_spread(spark, d):
    """Spread and size of the lines (members) of a part, and its quadrature with a fixed noise."""
    li = table(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").cast("bigint").alias("q"))
    own = li.groupBy("l_partkey").agg(F.stddev_pop("q").alias("s"), F.count(F.lit(1)).alias("k"))
    return own.select("l_partkey", places("s").alias("sigma"), "k", places(F.sqrt(F.col("s") * F.col("s") + 4.0)).alias("composite"))


def rival_cover(spark, d):
    """How much of a part the largest orders hold, weighted by order."""
    picks = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_quantity").cast("bigint") % 4).alias("m"))
    weights = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 5 / 10.0).alias("w"))
    return P.weighted_cover(picks, weights, "l_orderkey", "l_partkey", "m", "w").select("l_partkey", places("cover").alias("cover"), places("captain_cover").alias("captain_cover"))


def field_exposure(spark, d):
    picks = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_quantity").cast("bigint") % 3).alias("m"))
    sigmas = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") / 10.0).alias("s"))
    return P.field_exposures(picks, sigmas, "l_orderkey", "l_partkey", "m", "s").select("l_orderkey", places("exposure").alias("exposure"))


def captain_shortlist(spark, d):
    """Of each brand the five dearest parts, and which of them are little held and of at least the median ceiling of the five."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", cents("p_retailprice").alias("v"), F.col("p_size").cast("bigint").alias("ceiling"), (F.col("p_partkey") % 100).alias("eo"))
    top = p.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("v"), "p_partkey"))).where("place <= 5")
    middle = top.groupBy("p_brand").agg(F.percentile("ceiling", 0.5).alias("middle"))
    return top.join(middle, "p_brand").select("p_brand", "p_partkey", ((F.col("eo") < 100 * R.DIFFERENTIAL) & (F.col("ceiling") >= F.col("middle"))).alias("differential"))


def alternatives(spark, d):
    """For each brand's dearest part, other parts of its type that cost nearly as much and few hold."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", cents("p_retailprice").alias("v"), (F.col("p_partkey") % 100).alias("eo"))
    best = p.groupBy("p_brand").agg(F.max(F.struct("v", (-F.col("p_partkey")).alias("k"), "p_type")).alias("b")).select("p_brand", (-F.col("b.k")).alias("buy"), F.col("b.v").alias("limit"), F.col("b.p_type").alias("p_type"))
    near = p.drop("p_brand").join(best, "p_type").where((F.col("p_partkey") != F.col("buy")) & (F.col("v") >= F.col("limit") - 5000) & (F.col("eo") < 20))
    return near.select("p_brand", "buy", "p_partkey", "v")


def ft_value_table(spark, d):
    """Worth of banked moves from each segment's surpluses (balances above 0, in thousands), four weeks ahead."""
    c = table(spark, d, "customer").select("c_mktsegment", (F.greatest(cents("c_acctbal"), F.lit(0)) / 100000.0).alias("s"))
    out = P.option_values(c, "c_mktsegment", "s", 4)
    return out.select("c_mktsegment", "k", "week", places("value", 3).alias("value"), places("gain", 3).alias("gain"))


def breakdown_terms(spark, d):
    """A part's points by term, rule by kind: quantity, returns and discount weigh differently for each kind of part; the terms sum to the score."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", F.col("l_quantity").cast("bigint").alias("q"), F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"))
    rules = spark.createDataFrame([("A", 2, -3, 1), ("B", 1, -1, 2), ("C", 3, -2, 0)], "kind string, per_q long, per_return long, per_disc long")
    kind = F.when(F.col("p_size") <= 15, "A").when(F.col("p_size") <= 35, "B").otherwise("C")
    own = li.groupBy("l_partkey").agg(F.sum("q").alias("q"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("r"), F.sum("disc").alias("disc"))
    p = table(spark, d, "part").select("p_partkey", kind.alias("kind")).join(F.broadcast(rules), "kind").join(own, F.col("p_partkey") == F.col("l_partkey"))
    terms = [F.col("q") * F.col("per_q"), F.col("r") * F.col("per_return"), F.col("disc") * F.col("per_disc")]
    return p.select("p_partkey", "kind", *[t.alias(n) for t, n in zip(terms, ("t_quantity", "t_returns", "t_discount"), strict=True)], (terms[0] + terms[1] + terms[2]).alias("score"))


def slot_blocks(spark, d):
    """Predicted against realised sums a month, and the year's totals."""
    f = _forecast(spark, d)
    return f.rollup("yr", "mo").agg(F.grouping_id().alias("g"), F.sum("p").alias("predicted"), F.sum("a").alias("realised"), F.count(F.lit(1)).alias("n")).where("g < 3").select("yr", "mo", "predicted", "realised", "n")


QUERIES = {
    f.__name__: f
    for f in (
        top1_top15_metrics, baseline_predictor, corr_grid_search, lever_corr, blend_weight_1se, holdout_slots, suffix_count_floor, overlapping_strata,
        watch_alerts, price_falls, latest_before_deadline, last_four_values, threshold_projection, modal_plans, reason_means, lane_summary,
        move_frequencies, label_points, grouped_actuals, mean_per_slot, ensemble_spread, rival_cover, field_exposure, captain_shortlist,
        alternatives, ft_value_table, breakdown_terms, slot_blocks,
    )
}

O = """WITH o AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS v, CAST(year(o_orderdate) AS BIGINT) AS yr, CAST(month(o_orderdate) AS BIGINT) AS mo FROM orders)"""
FC = O + """, w AS (SELECT *, CAST(floor(lag(v) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) / 10000) AS BIGINT) AS p, CAST(floor(v / 10000) AS BIGINT) AS a, yr * 12 + mo AS slot FROM o),
f AS (SELECT * FROM w WHERE p IS NOT NULL)"""
L = """WITH l AS (SELECT l_orderkey, l_partkey, l_returnflag, month(l_shipdate) AS slot, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS v,
  CAST(round(l_discount * 100) AS BIGINT) AS disc FROM lineitem)"""

ORACLE_SQL = {
    "top1_top15_metrics": f"""{FC}, r AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY p DESC, o_orderkey) AS i FROM f),
s AS (SELECT slot, sum(a) FILTER (WHERE i = 1) AS first, sum(a) AS total FROM r WHERE i <= 15 GROUP BY 1),
e AS (SELECT count(*) AS n, avg(abs(p - a)) AS x, avg(abs(p - a)) FILTER (WHERE o_orderstatus = 'F') AS y, sqrt(avg((p - a) * (p - a)) FILTER (WHERE o_orderstatus = 'F')) AS z FROM f)
SELECT n, round(x, 3) AS mae_all, round(y, 3) AS mae_starters, round(z, 3) AS rmse_starters, (SELECT round(avg(first), 3) FROM s) AS top1, (SELECT round(avg(total), 3) FROM s) AS top15 FROM e""",
    "baseline_predictor": f"""{FC}, g AS (SELECT o_custkey, slot, arg_min(p, (o_orderdate, o_orderkey)) AS p, sum(a) AS a FROM f GROUP BY 1, 2)
SELECT CASE WHEN a < 1000 THEN 'low' ELSE 'high' END AS size, count(*) AS n, round(avg(abs(p - a)), 3) AS mae FROM g GROUP BY 1""",
    "corr_grid_search": f"""{O}, t AS (SELECT max(yr) AS last FROM o), c AS (SELECT o_custkey, CAST(sum(v) FILTER (WHERE yr < last) AS DOUBLE) AS s, count(*) FILTER (WHERE yr < last) AS n, avg(v) FILTER (WHERE yr = last) AS y FROM o, t GROUP BY 1),
u AS (SELECT * FROM c WHERE n > 0 AND y IS NOT NULL), m AS (SELECT sum(s) / sum(n) AS mean FROM u),
g AS (SELECT k, corr((s + k * mean) / (n + k), y) AS corr FROM u, m, (SELECT unnest([0, 1, 2, 5, 10, 20, 50]::DOUBLE[]) AS k) GROUP BY 1)
SELECT k, round(corr, 5) AS corr, rank() OVER (ORDER BY round(corr, 8) DESC, k) = 1 AS best FROM g""",
    "lever_corr": f"{L} SELECT l_returnflag, count(*) AS n, round(corr(q, v), 5) AS corr FROM l GROUP BY 1",
    "blend_weight_1se": """WITH s AS (SELECT least(n_chars / 6000, 0.95::DOUBLE) AS a, CASE WHEN lang = 'en' THEN 0.7 ELSE 0.5 END::DOUBLE AS b, quality AS y, doc_id FROM documents JOIN labels USING (doc_id)),
g AS (SELECT i, round(i * 0.05, 2)::DOUBLE AS w FROM range(0, 21) r(i)),
p AS (SELECT i, w, doc_id, y, least(greatest(w * a + (1 - w) * b, 1e-12), 1 - 1e-12) AS q FROM s, g WHERE a IS NOT NULL AND y IS NOT NULL),
x AS (SELECT *, -(y * ln(q) + (1 - y) * ln(1 - q)) AS e FROM p), m AS (SELECT i, w, avg(e) AS mean FROM x GROUP BY 1, 2),
b AS (SELECT arg_min(i, (mean, i)) AS i FROM m), bx AS (SELECT doc_id, e FROM x JOIN b USING (i)),
d AS (SELECT x.i, x.w, avg(x.e - bx.e) AS diff, stddev_samp(x.e - bx.e) / sqrt(count(*)) AS se FROM x JOIN bx USING (doc_id) GROUP BY 1, 2)
SELECT (SELECT min(w) FROM d WHERE i = (SELECT i FROM b) OR (i < (SELECT i FROM b) AND diff <= se)) AS weight, (SELECT w FROM m JOIN b USING (i)) AS best""",
    "holdout_slots": f"""{O}, s AS (SELECT DISTINCT yr, mo FROM o), t AS (SELECT yr, mo FROM s ORDER BY yr DESC, mo DESC LIMIT 1 OFFSET 9)
SELECT (o.yr, o.mo) >= (t.yr, t.mo) AS held_out, count(*) AS n, CAST(sum(v) AS BIGINT) AS v FROM o, t GROUP BY 1""",
    "suffix_count_floor": f"""{O}, c AS (SELECT yr, count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM o GROUP BY 1), s AS (SELECT yr, sum(n) OVER (ORDER BY yr DESC) AS after FROM c)
SELECT (SELECT coalesce(max(yr) FILTER (WHERE after >= 300), min(yr)) FROM s) AS yr, (SELECT coalesce(min(yr) FILTER (WHERE o_orderpriority > '4'), max(yr) + 1) FROM o) AS first_new""",
    "overlapping_strata": f"""{FC}, s AS (SELECT unnest(list_filter(['all', CASE WHEN v % 10 < 3 THEN 'fringe' END, CASE WHEN v % 10 >= 3 THEN 'regular' END, CASE WHEN mo <= 4 THEN 'early' END,
  CASE WHEN mo > 4 THEN 'settled' END, CASE WHEN p <= 1000 THEN 'absent' END, CASE WHEN p > 1000 THEN 'present' END], lambda x: x IS NOT NULL)) AS stratum, abs(p - a) AS e FROM f)
SELECT stratum, count(*) AS n, round(avg(e), 3) AS mae FROM s GROUP BY 1""",
    "watch_alerts": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN CAST(round(p_retailprice * 100) AS BIGINT) % 2001 / 50 - 20 END AS pct FROM part)
SELECT p_partkey, round(pct, 2) AS pct, CASE WHEN pct > 0 THEN 'rise' ELSE 'drop' END AS direction FROM p WHERE abs(pct) >= 10 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)""",
    "price_falls": """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(round(value * 100) AS BIGINT) - 10000 AS x FROM events)
SELECT user_id, round(max(least(1, abs(x) / 10000)), 3)::DOUBLE AS p FROM e WHERE day = (SELECT max(day) FROM e) AND x < 0 GROUP BY 1""",
    "latest_before_deadline": """WITH e AS (SELECT user_id || '-' || strftime(ts, '%Y-%m') AS key, ts, event_id, date_trunc('month', ts) + INTERVAL 19 DAY AS due FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts < due DESC, ts DESC, event_id DESC) AS i FROM e) SELECT key, event_id, NOT ts < due AS late FROM r WHERE i = 1""",
    "last_four_values": f"""{O}, r AS (SELECT o_custkey, v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM o)
SELECT o_custkey, string_agg(v, ',' ORDER BY i DESC) AS last4 FROM r WHERE i <= 4 GROUP BY 1""",
    "threshold_projection": """WITH e AS (SELECT event_type, CAST(floor(dayofyear(ts) / 3) AS BIGINT) AS slot, sum(CAST(round(value * 100) AS BIGINT)) AS v FROM events GROUP BY 1, 2),
g AS (SELECT event_type, count(*) AS weeks, min(slot) AS s0, max(slot) AS s1, CAST(arg_min(v, slot) AS DOUBLE) AS v0, CAST(arg_max(v, slot) AS DOUBLE) AS v1 FROM e WHERE slot < 60 GROUP BY 1)
SELECT event_type, weeks, round((v1 - v0) / (s1 - s0), 3) AS rise, round(v1 + (v1 - v0) / (s1 - s0) * (60 - s1), 2) AS value FROM g WHERE weeks >= 2""",
    "modal_plans": f"""{O}, g AS (SELECT o_custkey, o_orderpriority, count(*) AS n, max(v) AS v FROM o GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, v DESC) AS i FROM g)
SELECT o_custkey, max(n) FILTER (WHERE i = 1) AS n, max(v) FILTER (WHERE i = 1) AS v, max(v) FILTER (WHERE i > 1) AS runner_up, max(v) FILTER (WHERE i = 1) - max(v) FILTER (WHERE i > 1) AS margin FROM r GROUP BY 1""",
    "reason_means": f"""{FC} SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'no note' END AS reason, count(*) AS n, round(avg(a - p), 1) AS mean_delta FROM f GROUP BY 1""",
    "lane_summary": f"""{FC} SELECT o_orderpriority, yr, count(*) AS n, count(*) FILTER (WHERE a > p) AS won, CAST(sum(a - p) AS BIGINT) AS delta FROM f GROUP BY ROLLUP (o_orderpriority, yr) HAVING grouping(o_orderpriority) = 0""",
    "move_frequencies": f"""{L}, m AS (SELECT DISTINCT l_orderkey, p_brand, l_returnflag FROM l JOIN part ON p_partkey = l_partkey)
SELECT p_brand, l_returnflag, count(*) AS n, round(count(*) / (SELECT count(DISTINCT l_orderkey) FROM l), 5) AS share FROM m GROUP BY 1, 2""",
    "label_points": f"""{O}, c AS (SELECT v, nullif(regexp_extract(o_orderpriority, '-(.*)', 1), 'LOW') AS chip FROM o) SELECT chip, CAST(sum(v) AS BIGINT) AS points, count(*) AS n FROM c WHERE chip <> '' GROUP BY 1""",
    "grouped_actuals": f"""{O} SELECT o_custkey, yr || '-' || mo AS slot, round(avg((v % 100) / 100), 4) AS p, CAST(sum(v) AS BIGINT) AS v, bool_or(o_orderstatus = 'F') AS played, min(o_orderkey) AS first FROM o GROUP BY o_custkey, yr, mo""",
    "mean_per_slot": f"""{L}, s AS (SELECT count(DISTINCT slot) AS n FROM l) SELECT l_partkey, round(sum(q) / max(n), 4) AS ep, round(sqrt(sum(q * q)) / sqrt(max(n)), 4) AS sigma FROM l, s GROUP BY 1""",
    "ensemble_spread": f"""{L}, g AS (SELECT l_partkey, stddev_pop(q) AS s, count(*) AS k FROM l GROUP BY 1) SELECT l_partkey, round(s, 4) AS sigma, k, round(sqrt(s * s + 4), 4) AS composite FROM g""",
    "rival_cover": f"""{L}, p AS (SELECT l_partkey, q % 4 AS m, o_orderkey % 5 / 10 AS w FROM l JOIN orders ON o_orderkey = l_orderkey WHERE q % 4 > 0 AND o_orderkey % 5 <> 0)
SELECT l_partkey, round(least(sum(w * least(m, 2)), 1), 4) AS cover, round(least(sum(CASE WHEN m >= 2 THEN w ELSE 0 END), 1), 4) AS captain_cover FROM p GROUP BY 1""",
    "field_exposure": f"""{L}, p AS (SELECT l_orderkey, l_partkey, q % 3 AS m FROM l), n AS (SELECT count(DISTINCT l_orderkey) AS n FROM p),
w AS (SELECT l_partkey, sum(m) / max(n) AS w, max(coalesce(p_size / 10, 0)) AS s FROM p CROSS JOIN n LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1), f AS (SELECT sum(pow(w * s, 2)) AS field FROM w),
e AS (SELECT l_orderkey, sum(pow(m * s, 2)) AS var, sum(m * w * s * s) AS cov FROM p JOIN w USING (l_partkey) GROUP BY 1)
SELECT l_orderkey, round(CASE WHEN var > 0 AND field > 0 THEN least(greatest(cov / sqrt(var * field), 0), 1) ELSE 0 END, 4)::DOUBLE AS exposure FROM e, f""",
    "captain_shortlist": """WITH p AS (SELECT p_partkey, p_brand, p_size, p_partkey % 100 AS eo, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(round(p_retailprice * 100) AS BIGINT) DESC, p_partkey) AS i FROM part),
t AS (SELECT * FROM p WHERE i <= 5) SELECT p_brand, p_partkey, eo < 30 AND p_size >= median(p_size) OVER (PARTITION BY p_brand) AS differential FROM t""",
    "alternatives": """WITH p AS (SELECT p_partkey, p_brand, p_type, CAST(round(p_retailprice * 100) AS BIGINT) AS v, p_partkey % 100 AS eo FROM part),
b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY v DESC, p_partkey) AS i FROM p)
SELECT b.p_brand, b.p_partkey AS buy, p.p_partkey, p.v FROM b JOIN p ON p.p_type = b.p_type AND p.p_partkey <> b.p_partkey AND p.v >= b.v - 5000 AND p.eo < 20 WHERE b.i = 1""",
    "ft_value_table": """WITH RECURSIVE c AS (SELECT c_mktsegment, greatest(CAST(round(c_acctbal * 100) AS BIGINT), 0) / 100000 AS s FROM customer),
q AS (SELECT c_mktsegment, list(s) AS ss, list_transform(range(0, 6), lambda j: coalesce(list_sum(list_transform(range(1, j + 1), lambda i: 1.0::DOUBLE / i)), 0)) AS w FROM c GROUP BY 1),
v AS (SELECT c_mktsegment, ss, w, CAST([0, 0, 0, 0, 0, 0] AS DOUBLE[]) AS v, 0 AS week FROM q UNION ALL
  SELECT c_mktsegment, ss, w, [list_avg([list_max([s * w[j + 1] + v[least(k - j + 1, 5) + 1] for j in range(0, k + 1)]) for s in ss]) for k in range(0, 6)], week + 1 FROM v WHERE week < 4),
u AS (SELECT c_mktsegment, week, unnest(range(0, 6)) AS k, v FROM v WHERE week > 0)
SELECT c_mktsegment, k, CAST(week AS BIGINT) AS week, round(v[k + 1], 3) AS value, CASE WHEN k > 0 THEN round(greatest(0, v[k + 1] - v[k]), 3) END AS gain FROM u""",
    "breakdown_terms": f"""{L}, g AS (SELECT l_partkey, sum(q) AS q, count(*) FILTER (WHERE l_returnflag = 'R') AS r, sum(disc) AS disc FROM l GROUP BY 1),
t AS (SELECT p_partkey, CASE WHEN p_size <= 15 THEN 'A' WHEN p_size <= 35 THEN 'B' ELSE 'C' END AS kind, q, r, disc FROM part JOIN g ON p_partkey = l_partkey),
x AS (SELECT p_partkey, kind, CAST(q * CASE kind WHEN 'A' THEN 2 WHEN 'B' THEN 1 ELSE 3 END AS BIGINT) AS t_quantity, CAST(r * CASE kind WHEN 'A' THEN -3 WHEN 'B' THEN -1 ELSE -2 END AS BIGINT) AS t_returns,
  CAST(disc * CASE kind WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 0 END AS BIGINT) AS t_discount FROM t) SELECT *, t_quantity + t_returns + t_discount AS score FROM x""",
    "slot_blocks": f"""{FC} SELECT yr, mo, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(a) AS BIGINT) AS realised, count(*) AS n FROM f GROUP BY ROLLUP (yr, mo) HAVING grouping(yr) = 0""",
}
