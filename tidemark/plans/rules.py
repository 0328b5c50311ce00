"""Queries on row rules, odds and bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cents, odds, places
from ..functions import rules as R
from ..sources.tables import table

#: Curves of the chance to be back after 0, 1, 2... steps, and the pooled one.
CURVES = {"5-LOW": [0.2, 0.5, 0.8], "2-HIGH": [0.1, 0.3], "1-URGENT": []}
POOLED = [0.25, 0.6, 0.9, 1.0]


def _lines(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("bigint").alias("k"), "l_returnflag", "l_linestatus",
        F.col("l_quantity").cast("bigint").alias("q"), cents("l_extendedprice").alias("v"), F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"),
    )


def setpiece_scores(spark, d):
    li = _lines(spark, d).select("l_orderkey", "k", F.nullif(F.col("k"), F.lit(4)).alias("a"), F.nullif(F.col("q") % 5, F.lit(0)).alias("b"))
    return li.select("l_orderkey", "k", R.order_score(F.col("a")).alias("first"), R.order_score(F.least("a", "b")).alias("best"))


def adjusted_points(spark, d):
    li = _lines(spark, d)
    return li.select("l_orderkey", "k", R.adjusted_points(F.col("disc"), F.nullif(F.col("q"), F.lit(7)), F.col("l_linestatus") == "F").cast("bigint").alias("points"))


def order_free_pairs(spark, d):
    li = _lines(spark, d).withColumn("pair", R.pair_key(F.col("l_partkey"), F.nullif(F.col("l_suppkey"), F.lit(3))))
    return li.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def restated_groups(spark, d):
    """Lines whose order has any line with another price after a restatement (here of lines over 10% discount); unknown equals unknown."""
    li = _lines(spark, d).withColumn("old", F.nullif(F.col("v"), F.lit(0))).withColumn("new", F.when(F.col("disc") > 8, F.col("v") + 1).otherwise(F.col("old")))
    moved = li.groupBy("l_orderkey").agg(F.bool_or(~F.col("old").eqNullSafe(F.col("new"))).alias("moved"))
    return li.join(moved, "l_orderkey").select("l_orderkey", "k", "moved")


def three_way_mode(spark, d):
    li = _lines(spark, d).withColumns({"minutes": F.nullif(F.greatest(F.col("q") * 3 - 30, F.lit(0)), F.lit(90)), "starts": F.when(F.col("disc") % 3 > 0, (F.col("disc") % 2).cast("bigint"))})
    return li.groupBy(R.mode_label(F.col("minutes"), F.col("starts")).alias("mode"), R.start_truth(F.col("minutes"), F.col("starts")).alias("started")).agg(F.count(F.lit(1)).alias("n"))


def threshold_hits(spark, d):
    li = _lines(spark, d)
    hit = R.threshold_hit(F.nullif(F.col("l_returnflag"), F.lit("A")) == "R", F.col("disc"), F.nullif(F.col("k"), F.lit(2)), F.col("q") % 7)
    return li.groupBy("l_returnflag").agg(F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("n"))


def card_penalties(spark, d):
    li = _lines(spark, d)
    rates = [(F.when(F.col("q") > 25, F.col("q") / 100), F.when(F.col("k") < 4, F.col("k") / 10)), (F.when(F.col("disc") > 5, F.col("disc") / 200), F.lit(None).cast("double"))]
    return li.select("l_orderkey", "k", places(R.card_penalty(rates)).alias("penalty"))


def half_profit_prices(spark, d):
    price = _lines(spark, d).groupBy("l_partkey").agg(F.floor(F.sum("v") / F.sum("q")).cast("bigint").alias("now"))
    p = table(spark, d, "part").select("p_partkey", cents("p_retailprice").alias("bought"))
    return p.join(price, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", R.sell_price(F.col("bought"), F.col("now")).alias("price"), R.direction(F.col("now") - F.col("bought")).alias("direction"))


def field_labels(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (cents("c_acctbal") / 10000.0).alias("eo"), (F.col("c_custkey") % 3 == 0).alias("owned"))
    eo = F.when(F.col("eo") >= 0, F.col("eo"))
    return c.select(
        "c_custkey", R.field_class(F.col("owned"), eo).alias("class"), R.transfer_tag(eo, F.col("c_custkey") % 5 > 0).alias("tag"), places(R.cover_from_eo(eo)).alias("cover")
    )


def return_chances(spark, d):
    e = table(spark, d, "events").select("event_id", F.nullif(F.col("user_id") % 12, F.lit(0)).alias("back"), F.month("ts").alias("slot"))
    return e.select("event_id", R.return_chance(F.col("back"), F.col("slot")).alias("chance"))


def formation_check(spark, d):
    """Groups of eleven parts by key: does each hold as many of each kind (goalkeepers to forwards, from the size) as the rules allow?"""
    kind = F.when(F.col("p_size") <= 4, "GKP").when(F.col("p_size") <= 22, "DEF").when(F.col("p_size") <= 40, "MID").otherwise("FWD")
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 11).cast("bigint").alias("squad"), kind.alias("kind"))
    legal = F.count(F.lit(1)) == 11
    for name, (low, high) in R.XI_BOUNDS.items():
        legal = legal & F.count(F.when(F.col("kind") == name, 1)).between(low, high)
    return p.groupBy("squad").agg(legal.alias("legal"))


def tilt_dial(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (cents("c_acctbal") / 100000.0).alias("ep"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey") % 13 / 10.0).alias("cover"), F.explode(F.array(*map(F.lit, (-0.5, 0.0, 0.4)))).alias("dial"))
    return c.select("c_custkey", "dial", places(R.tilt(F.col("ep"), F.col("cover"), F.col("dial")), 8).alias("ep"))


def remaining_expectation(spark, d):
    li = _lines(spark, d)
    left = R.remaining_fraction(F.col("q") * 2, F.col("k") > 1, F.col("l_linestatus") == "F", F.col("disc") % 3, F.col("k") % 2)
    return li.select("l_orderkey", "k", places(left).alias("left"))


def event_estimates(spark, d):
    li = _lines(spark, d)
    n = R.event_estimate(F.nullif(F.col("q"), F.lit(9)) / 20, F.col("k") / 10)
    return li.groupBy(n.alias("events")).agg(F.count(F.lit(1)).alias("n"))


def return_curves(spark, d):
    """Availability of orders by steps ahead: typed curves, the pooled one, a fixed recovery where no type is known."""
    flat = [(k, v) for k, v in CURVES.items()]
    curves = spark.createDataFrame(flat, "o_orderpriority string, curve array<double>")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.month("o_orderdate").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("h"))
    o = o.join(F.broadcast(curves), "o_orderpriority", "left")  # three rows
    typed = F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED"))
    factor = R.relaxed(F.col("m") / 16.0, F.col("h"), typed, F.col("curve"), F.array(*map(F.lit, POOLED)), F.col("m") + F.col("h"), F.when(F.col("o_orderkey") % 3 == 0, 7))
    return o.select("o_orderkey", "h", places(factor).alias("factor"))


def gap_win_probability(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (cents("c_acctbal") / 10000.0).alias("mine"), (F.col("c_custkey") % 50).cast("double").alias("theirs"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("slots"))
    return c.select("c_custkey", F.col("slots").cast("bigint").alias("slots"), places(R.gap_win_probability(F.col("mine"), F.col("theirs"), F.col("slots"), 12.0)).alias("p"))


def shin_devig(spark, d):
    """Lines of an order as outcomes: implied chances are shares of its price times an overround of 6%."""
    li = _lines(spark, d).withColumn("x", F.col("v") / F.sum("v").over(_by("l_orderkey")) * 1.06)
    own = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("k", "v", "x"))).alias("lines"))  # at most seven lines an order
    solved = own.withColumn("p", odds.shin_probabilities(F.col("lines.x"))).select("l_orderkey", F.explode(F.arrays_zip("lines", "p")).alias("z"))
    return solved.select("l_orderkey", "z.lines.k", places("z.p", 5).alias("p"))


def _by(*keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def invert_odds(spark, d):
    """The two Poisson means that fit each supplier's chances of a win, a draw and three goals or more best."""
    s = table(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 8 + 2) / 20).alias("home"), ((F.col("s_suppkey") % 5 + 3) / 20).alias("draw"), ((F.col("s_suppkey") % 7 + 6) / 20).alias("over"))
    return odds.inverted(s, ["s_suppkey"], odds.mean_grid(spark))


def poisson_win(spark, d):
    g = _lines(spark, d).groupBy("l_orderkey").agg((F.sum("q") / 60.0).alias("x"), (F.sum("disc") / 12.0).alias("y"))
    return g.select("l_orderkey", places(odds.win_probability(F.col("x"), F.col("y")), 6).alias("p"))


def normalised_rates(spark, d):
    """Scoring rates from prices, rescaled so that an order's lines sum to its mean."""
    li = _lines(spark, d).withColumn("rate", odds.scoring_rate(1.05 + F.col("v") / 1000000.0))
    own = li.groupBy("l_orderkey").agg(F.sum("rate").alias("total"), (F.sum("q") / 40.0).alias("mean"))
    return li.join(own, "l_orderkey").select("l_orderkey", "k", places(F.col("rate") * F.col("mean") / F.col("total"), 5).alias("rate"))


def recentred_means(spark, d):
    p = table(spark, d, "part").select("p_partkey", (cents("p_retailprice") / 30000.0 - 3).alias("ep"), (F.col("p_size") / 8.0 - 0.5).alias("sigma"))
    p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # forty steps a row, and a small file is few tasks
    return p.select("p_partkey", places(odds.recentred_mean(F.col("ep"), F.col("sigma"))).alias("mean"))


def points_bands(spark, d):
    p = table(spark, d, "part").select("p_partkey", (cents("p_retailprice") / 20000.0 - 5).alias("ep"), (F.col("p_size") % 5 * 1.0).alias("sigma"))
    return p.select("p_partkey", odds.points_band(F.col("ep"), F.col("sigma")).alias("b")).select("p_partkey", places("b.ep_lo", 3).alias("ep_lo"), places("b.ep_hi", 3).alias("ep_hi"), places("b.p_haul", 3).alias("p_haul"), places("b.p_blank", 3).alias("p_blank"))


QUERIES = {
    f.__name__: f
    for f in (
        setpiece_scores, adjusted_points, order_free_pairs, restated_groups, three_way_mode, threshold_hits, card_penalties, half_profit_prices,
        field_labels, return_chances, formation_check, tilt_dial, remaining_expectation, event_estimates, return_curves, gap_win_probability,
        shin_devig, invert_odds, poisson_win, normalised_rates, recentred_means, points_bands,
    )
}

L = """WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS k, l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS q,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS v, CAST(round(l_discount * 100) AS BIGINT) AS disc FROM lineitem)"""
SCORE = "CASE WHEN {x} = 1 THEN 1.0::DOUBLE WHEN {x} = 2 THEN 0.5::DOUBLE WHEN {x} >= 3 THEN 0.0::DOUBLE END"
TAIL = """(exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))))"""



def _cdf(z):
    """SQL of the normal distribution by the same published formula."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    tail = f"(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END)"


_STEP = f"CASE WHEN abs(mu * {_cdf('(mu / sigma)')} + sigma * exp(-(mu / sigma) * (mu / sigma) / 2) / sqrt(2 * pi()) - ep) <= 1e-9 THEN mu WHEN {_cdf('(mu / sigma)')} <= 1e-12 THEN mu + sigma ELSE mu - (mu * {_cdf('(mu / sigma)')} + sigma * exp(-(mu / sigma) * (mu / sigma) / 2) / sqrt(2 * pi()) - ep) / {_cdf('(mu / sigma)')} END"
#: After rows p (p_partkey, ep, sigma) the mean of each, by forty Newton steps.
_MEANS = f"""r AS (SELECT p_partkey, ep, sigma, ep AS mu, 0 AS k FROM p UNION ALL SELECT p_partkey, ep, sigma, CASE WHEN sigma > 0 AND ep > 0 THEN {_STEP} ELSE mu END, k + 1 FROM r WHERE k < 40), m AS (SELECT * FROM r WHERE k = 40)"""

ORACLE_SQL = {
    "setpiece_scores": f"""{L}, s AS (SELECT l_orderkey, k, nullif(k, 4) AS a, nullif(q % 5, 0) AS b FROM l), b AS (SELECT *, least(a, b) AS best FROM s)
SELECT l_orderkey, k, {SCORE.format(x="a")} AS first, {SCORE.format(x="best")} AS best FROM b""",
    "adjusted_points": f"""{L}, s AS (SELECT *, coalesce(nullif(q, 7), 0) AS n FROM l)
SELECT l_orderkey, k, disc + CASE WHEN l_linestatus = 'F' THEN n // 3 - n // 2 ELSE 0 END AS points FROM s""",
    "order_free_pairs": f"""{L}, s AS (SELECT l_partkey AS a, nullif(l_suppkey, 3) AS b FROM l)
SELECT CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) || '-' || greatest(a, b) END AS pair, count(*) AS n FROM s GROUP BY 1""",
    "restated_groups": f"""{L}, s AS (SELECT l_orderkey, k, nullif(v, 0) AS old, CASE WHEN disc > 8 THEN v + 1 ELSE nullif(v, 0) END AS new FROM l)
SELECT l_orderkey, k, bool_or(old IS DISTINCT FROM new) OVER (PARTITION BY l_orderkey) AS moved FROM s""",
    "three_way_mode": f"""{L}, s AS (SELECT coalesce(nullif(greatest(q * 3 - 30, 0), 90), 0) AS m, CASE WHEN disc % 3 > 0 THEN disc % 2 END AS st FROM l),
t AS (SELECT m, coalesce(CAST(st AS DOUBLE), CASE WHEN m >= 60 THEN 1.0 ELSE 0.0 END::DOUBLE) AS started FROM s)
SELECT CAST(CASE WHEN m > 0 AND started >= 1 THEN 2 WHEN m > 0 THEN 1 ELSE 0 END AS BIGINT) AS mode, started, count(*) AS n FROM t GROUP BY 1, 2""",
    "threshold_hits": f"""{L}, s AS (SELECT l_returnflag, disc + coalesce(nullif(k, 2), 0) AS two, q % 7 AS r FROM l)
SELECT l_returnflag, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CASE WHEN two >= 10 THEN 1 ELSE 0 END WHEN two + r >= 12 THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS n FROM s GROUP BY 1""",
    "card_penalties": f"""{L} SELECT l_orderkey, k, round(-1 * coalesce(CASE WHEN q > 25 THEN q / 100 END, CASE WHEN k < 4 THEN k / 10 END, 0)
  - 3 * coalesce(CASE WHEN disc > 5 THEN disc / 200 END, 0), 4)::DOUBLE AS penalty FROM l""",
    "half_profit_prices": f"""{L}, g AS (SELECT l_partkey, CAST(floor(CAST(sum(v) AS DOUBLE) / sum(q)) AS BIGINT) AS now FROM l GROUP BY 1), p AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS b FROM part)
SELECT p_partkey, CASE WHEN now <= b THEN now ELSE b + (now - b) // 2 END AS price, CASE WHEN now > b THEN 'rise' WHEN now < b THEN 'drop' WHEN now = b THEN 'flat' END AS direction FROM p LEFT JOIN g ON p_partkey = l_partkey""",
    "field_labels": """WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) / 10000 END AS eo, c_custkey % 3 = 0 AS owned FROM customer)
SELECT c_custkey, CASE WHEN owned AND eo >= 40 THEN 'shield' WHEN owned AND eo <= 15 THEN 'sword' WHEN NOT owned AND eo >= 40 THEN 'threat' END AS class,
  CASE WHEN c_custkey % 5 = 0 THEN '' WHEN coalesce(eo, 0) / 100 < 0.3::DOUBLE THEN 'attack' WHEN coalesce(eo, 0) / 100 >= 0.7::DOUBLE THEN 'cover' ELSE '' END AS tag,
  CASE WHEN eo IS NOT NULL THEN round(least(eo / 100, 1), 4) END::DOUBLE AS cover FROM c""",
    "return_chances": """SELECT event_id, CASE WHEN b > m THEN 0.0 WHEN b <= m THEN 50.0 END::DOUBLE AS chance FROM (SELECT event_id, nullif(user_id % 12, 0) AS b, month(ts) AS m FROM events)""",
    "formation_check": """WITH p AS (SELECT p_partkey // 11 AS squad, CASE WHEN p_size <= 4 THEN 'GKP' WHEN p_size <= 22 THEN 'DEF' WHEN p_size <= 40 THEN 'MID' ELSE 'FWD' END AS kind FROM part)
SELECT squad, count(*) = 11 AND count(*) FILTER (WHERE kind = 'GKP') = 1 AND count(*) FILTER (WHERE kind = 'DEF') BETWEEN 3 AND 5
  AND count(*) FILTER (WHERE kind = 'MID') BETWEEN 2 AND 5 AND count(*) FILTER (WHERE kind = 'FWD') BETWEEN 1 AND 3 AS legal FROM p GROUP BY 1""",
    "tilt_dial": """WITH c AS (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) / 100000 AS ep, coalesce(least(CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 13 / 10 END, 1), 0) AS cover,
  unnest([-0.5, 0.0, 0.4]::DOUBLE[]) AS dial FROM customer)
SELECT c_custkey, dial, round(CASE WHEN dial = 0 THEN ep ELSE ep * (1 + dial * (1 - CASE WHEN c_custkey % 4 > 0 THEN cover ELSE 0 END)) / (1 + greatest(dial, 0)) END, 8)::DOUBLE AS ep FROM c""",
    "remaining_expectation": f"""{L} SELECT l_orderkey, k, round(CASE WHEN l_linestatus = 'F' THEN 0 WHEN k <= 1 THEN 1
  ELSE least(1, (k % 2 + greatest(0, 1 - q * 2 / 90)) / greatest(1, disc % 3)) END, 4)::DOUBLE AS "left" FROM l""",
    "event_estimates": f"""{L}, s AS (SELECT greatest(0, coalesce(nullif(q, 9) / 20 - k / 10, 0)) AS gap FROM l)
SELECT CAST(least(floor((gap + (0.79::DOUBLE - 0.5::DOUBLE)) / 0.79::DOUBLE), 2) AS BIGINT) AS events, count(*) AS n FROM s GROUP BY 1""",
    "return_curves": """WITH o AS (SELECT o_orderkey, o_orderpriority AS p, month(o_orderdate) AS m, unnest(range(0, 5)) AS h FROM orders),
s AS (SELECT *, m / 16 AS f, CASE WHEN p = '5-LOW' THEN [0.2, 0.5, 0.8][least(h, 2) + 1] WHEN p = '2-HIGH' THEN [0.1, 0.3][least(h, 1) + 1] ELSE [0.25, 0.6, 0.9, 1.0][least(h, 3) + 1] END::DOUBLE AS back FROM o)
SELECT o_orderkey, CAST(h AS INTEGER) AS h, round(CASE WHEN o_orderkey % 3 = 0 AND m + h < 7 THEN 0 WHEN h <= 0 THEN f
  ELSE 1 - (1 - f) * CASE WHEN p = '4-NOT SPECIFIED' THEN pow(0.7::DOUBLE, h) ELSE 1 - back END END, 4)::DOUBLE AS factor FROM s""",
    "gap_win_probability": f"""WITH c AS (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) / 10000 AS mine, CAST(c_custkey % 50 AS DOUBLE) AS theirs, unnest(range(0, 4)) AS slots FROM customer),
s AS (SELECT *, (mine - theirs) / (12 * sqrt(2 * greatest(slots, 1))) AS z FROM c), t AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM s)
SELECT c_custkey, slots, round(CASE WHEN slots <= 0 THEN CASE WHEN mine >= theirs THEN 1 ELSE 0 END WHEN z >= 0 THEN 1 - {TAIL} ELSE {TAIL} END, 4)::DOUBLE AS p FROM t""",
    "shin_devig": f"""{L}, s AS (SELECT l_orderkey, k, v, v / CAST(sum(v) OVER (PARTITION BY l_orderkey) AS DOUBLE) * 1.06::DOUBLE AS x FROM l),
b AS (SELECT l_orderkey, list(x) AS xs, sum(x) AS book, count(*) AS n FROM s GROUP BY 1),
z AS (WITH RECURSIVE r AS (SELECT l_orderkey, xs, book, 0.0::DOUBLE AS lo, 0.4::DOUBLE AS hi, 0 AS i FROM b UNION ALL
  SELECT l_orderkey, xs, book, CASE WHEN t > 1 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN t > 1 THEN hi ELSE (lo + hi) / 2 END, i + 1
  FROM (SELECT *, list_sum([(sqrt(((lo + hi) / 2) ** 2 + 4 * (1 - (lo + hi) / 2) * x * x / book) - (lo + hi) / 2) / (2 * (1 - (lo + hi) / 2)) for x in xs]) AS t FROM r WHERE i < 50))
  SELECT l_orderkey, (lo + hi) / 2 AS z FROM r WHERE i = 50),
p AS (SELECT s.l_orderkey, k, CASE WHEN n < 2 OR book <= 1 THEN x / book ELSE (sqrt(z * z + 4 * (1 - z) * x * x / book) - z) / (2 * (1 - z)) END AS p FROM s JOIN b USING (l_orderkey) JOIN z USING (l_orderkey))
SELECT l_orderkey, k, round(p / sum(p) OVER (PARTITION BY l_orderkey), 5) AS p FROM p""",
    "invert_odds": """WITH g AS (SELECT i * 77 + j AS id, round(0.2 + 0.05 * i, 2)::DOUBLE AS m, round(0.2 + 0.05 * j, 2)::DOUBLE AS a FROM range(0, 77) x(i), range(0, 77) y(j)),
c AS (SELECT id, m, a, h, k, exp(-m) * pow(m, h) / factorial(h::INTEGER) * exp(-a) * pow(a, k) / factorial(k::INTEGER) AS p FROM g, range(0, 11) x(h), range(0, 11) y(k)),
t AS (SELECT id, m, a, sum(p) FILTER (WHERE h > k) AS win, sum(p) FILTER (WHERE h = k) AS draw, sum(p) FILTER (WHERE h + k >= 3) AS over FROM c GROUP BY 1, 2, 3),
s AS (SELECT DISTINCT s_suppkey % 8 AS x, s_suppkey % 5 AS y, s_suppkey % 7 AS z FROM supplier),
e AS (SELECT x, y, z, m, a, id, pow(win - (x + 2) / 20, 2) + pow(draw - (y + 3) / 20, 2) + 0.5 * pow(over - (z + 6) / 20, 2) AS err FROM s, t),
b AS (SELECT x, y, z, arg_min(m, (err, id)) AS mean_home, arg_min(a, (err, id)) AS mean_away FROM e GROUP BY 1, 2, 3)
SELECT s_suppkey, mean_home, mean_away FROM supplier JOIN b ON s_suppkey % 8 = x AND s_suppkey % 5 = y AND s_suppkey % 7 = z""",
    "poisson_win": f"""{L}, g AS (SELECT l_orderkey, greatest(sum(q) / 60, 1e-9) AS x, greatest(sum(disc) / 12, 1e-9) AS y FROM l GROUP BY 1)
SELECT l_orderkey, round(sum(exp(-x) * pow(x, h) / factorial(h::INTEGER) * exp(-y) * pow(y, a) / factorial(a::INTEGER)), 6) AS p FROM g, range(1, 11) i(h), range(0, 10) j(a) WHERE a < h GROUP BY 1""",
    "normalised_rates": f"""{L}, s AS (SELECT *, -ln(1 - least(greatest(1 / (1.05::DOUBLE + v / 1000000), 1e-9), 1 - 1e-9)) AS rate FROM l)
SELECT l_orderkey, k, round(rate * (sum(q) OVER w / 40) / sum(rate) OVER w, 5) AS rate FROM s WINDOW w AS (PARTITION BY l_orderkey)""",
    "recentred_means": f"""WITH RECURSIVE p AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) / 30000.0::DOUBLE - 3 AS ep, p_size / 8.0::DOUBLE - 0.5 AS sigma FROM part), {_MEANS}
SELECT p_partkey, round(mu, 4) AS mean FROM m""",
    "points_bands": f"""WITH RECURSIVE p AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) / 20000.0::DOUBLE - 5 AS ep, (p_size % 5)::DOUBLE AS sigma FROM part), {_MEANS},
s AS (SELECT *, sigma > 0 AND ep > 0 AS wide FROM m)
SELECT p_partkey, round(CASE WHEN wide THEN greatest(0, mu - {odds.BAND_Z} * sigma) ELSE greatest(mu, 0) END, 3) AS ep_lo, round(CASE WHEN wide THEN mu + {odds.BAND_Z} * sigma ELSE greatest(mu, 0) END, 3) AS ep_hi,
  round(CASE WHEN wide THEN 1 - {_cdf(f"(({odds.HAUL} - mu) / sigma)")} WHEN mu >= {odds.HAUL} THEN 1 ELSE 0 END, 3) AS p_haul, round(CASE WHEN wide THEN {_cdf(f"(({odds.BLANK} - mu) / sigma)")} WHEN mu <= {odds.BLANK} THEN 1 ELSE 0 END, 3) AS p_blank FROM s""",
}
