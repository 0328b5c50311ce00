"""Queries on metrics, scores and simulation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cents, clip, hash_uniform, log_loss, places, tail_two_or_more
from ..operators import metrics as M
from ..operators.ordered import percentiles
from ..sources.tables import table

RULES = [("A", 3), ("N", 1), ("R", -2)]


def _scored(spark, d):
    """Text length as a forecast of the quality label."""
    docs = table(spark, d, "documents").select("doc_id", F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("p"))
    return docs.join(table(spark, d, "labels"), "doc_id").select("p", F.col("quality").cast("bigint").alias("y"))


def _line(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag", F.col("l_quantity").cast("bigint").alias("q"), cents("l_extendedprice").alias("v"), F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"))


def stratified_errors(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").withColumn("actual", F.round("o_totalprice").cast("bigint")).withColumn("pred", F.lag("actual").over(w))
    bucket = F.when(F.col("actual") < 50000, "low").when(F.col("actual") < 200000, "mid").otherwise("high")
    out = M.stratified_errors(o.withColumn("bucket", bucket), "pred", "actual", "bucket")
    return out.select("bucket", "n", places("rmse", 2).alias("rmse"), places("mae", 2).alias("mae"))


def reliability_bins(spark, d):
    return M.reliability(_scored(spark, d), "p", "y").select("bin", "n", places("mean_p", 8).alias("mean_p"), places("mean_y", 8).alias("mean_y"))


def brier_logloss(spark, d):
    s = _scored(spark, d)
    return s.agg(F.count(F.lit(1)).alias("n"), places(F.avg(F.pow(F.col("p") - F.col("y"), 2))).alias("brier"), places(F.avg(log_loss("p", "y"))).alias("log_loss"))


def cumulative_metrics(spark, d):
    daily = table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.sum(cents("value")).alias("v"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    return daily.select("day", "n", F.sum("n").over(w).alias("n_so_far"), places(F.sum("v").over(w) / F.sum("n").over(w), 2).alias("mean_so_far"))


def sigma_grouping_sets(spark, d):
    rows = _line(spark, d).select(F.floor(F.col("q") / 10).alias("q_bin"), F.floor(F.col("disc") / 3).alias("d_bin"), (F.col("v") / 100000.0).alias("x"))
    return M.sigma_table(rows, "x", ["q_bin", "d_bin"], 100).select("q_bin", "d_bin", "n", places("sigma").alias("sigma"))


def empirical_cdf_by_type(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", cents("o_totalprice").alias("v"))
    return M.empirical_cdf(o, "o_orderpriority", "v", [k * 5_000_000 for k in range(1, 9)]).select("o_orderpriority", "step", places("share").alias("share"))


def weighted_ownership_se(spark, d):
    n = table(spark, d, "orders").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return M.weighted_share_se(_line(spark, d).join(F.broadcast(n)), "l_suppkey", "q", F.max("n")).select("l_suppkey", places("share").alias("share"), places("se").alias("se"))


def share_of_group_max(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    own = _line(spark, d).join(p, "l_partkey").groupBy("p_brand", "l_suppkey").agg(F.sum("q").alias("q"))
    brands = own.groupBy("p_brand").agg(F.sum("q").alias("all"))
    return own.join(brands, "p_brand").withColumn("share", F.col("q") / F.col("all")).groupBy("l_suppkey").agg(places(F.max("share"), 6).alias("share"))


def first_change_latency(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    first = e.groupBy("user_id").agg(F.min("at").alias("start"), F.min_by("event_type", "at").alias("was"))
    other = e.join(first, "user_id").where("event_type <> was").groupBy("user_id").agg(F.min("at").alias("changed"), F.first("start").alias("start"))
    return other.select("user_id", F.floor((F.unix_micros("changed.ts") - F.unix_micros("start.ts")) / 1_000_000).cast("bigint").alias("seconds"))


def confusion_last_row(spark, d):
    daily = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max_by(cents("value"), F.struct("ts", "event_id")).alias("last"), F.max(cents("value")).alias("most"))
    return daily.select((F.col("last") > 5000).alias("said"), (F.col("most") > 8000).alias("was")).groupBy("said", "was").agg(F.count(F.lit(1)).alias("n"))


def ols_slope(spark, d):
    o = table(spark, d, "orders").select("o_custkey", (cents("o_totalprice") / 100000.0).alias("y"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("x"))
    out = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("s"), F.regr_slope("y", "x").alias("slope"))
    return out.where("n >= 5 AND s > 0").select("o_custkey", "n", places("slope").alias("slope"))


def margin_sigma_fallback(spark, d):
    o = table(spark, d, "orders").select("o_custkey", (cents("o_totalprice") / 100000.0).alias("y"))
    own = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("y").alias("s"))
    pooled = o.agg(F.stddev_samp("y").alias("pooled"))
    return own.crossJoin(F.broadcast(pooled)).select("o_custkey", places(clip(F.when(F.col("n") >= 6, F.col("s")).otherwise(F.col("pooled")), 0.5, 1.2)).alias("sigma"))


def softmax_threats(spark, d):
    """Shares of a segment by the exponential of the balance, shifted by the segment's greatest so that none overflows."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", (cents("c_acctbal") / 100000.0).alias("x"))
    c = c.join(c.groupBy("c_mktsegment").agg(F.max("x").alias("most")), "c_mktsegment").withColumn("e", F.exp(F.col("x") - F.col("most")))
    sums = c.groupBy("c_mktsegment").agg(F.sum("e").alias("total"))
    return c.join(sums, "c_mktsegment").select("c_custkey", places(F.col("e") / F.col("total"), 8).alias("weight"))


def rule_table_score(spark, d):
    rules = spark.createDataFrame(RULES, "l_returnflag string, points long")
    return _line(spark, d).join(F.broadcast(rules), "l_returnflag", "left").groupBy("l_orderkey").agg(F.sum(F.col("q") * F.coalesce("points", F.lit(0))).alias("score"))


def convex_blend(spark, d):
    price = _line(spark, d).groupBy("l_partkey").agg((F.sum("v") / F.sum("q")).alias("market"))
    p = table(spark, d, "part").select("p_partkey", cents("p_retailprice").cast("double").alias("own"))
    return p.join(price, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", places(F.coalesce(F.col("market") * 0.8 + F.col("own") * 0.2, "own"), 3).alias("blend"))


def availability_cascade(spark, d):
    v = cents("value")
    chance = F.when(v.isNull(), 1.0).when(v >= 7500, 0.0).when((v >= 5000) & (F.col("user_id") % 2 == 0), 0.25).when(v >= 5000, 0.5).when(v >= 2500, 0.75).otherwise(1.0)
    return table(spark, d, "events").select("event_id", chance.alias("chance"))


def devig_normalise(spark, d):
    li = _line(spark, d).withColumn("inv", F.lit(1.0) / F.col("v"))
    own = li.groupBy("l_orderkey", "l_suppkey").agg(F.sum("inv").alias("inv"))
    return own.select("l_orderkey", "l_suppkey", places(F.col("inv") / F.sum("inv").over(Window.partitionBy("l_orderkey")), 6).alias("p"))


def poisson_tail(spark, d):
    m = _line(spark, d).groupBy("l_orderkey").agg((F.sum("q") / 50.0).alias("m"))
    return m.select("l_orderkey", places(tail_two_or_more("m"), 6).alias("p"))


def winsor_minmax(spark, d):
    """Balances between the first observed at or above their 5th percentile and the last at or below their 95th, as 0 to 1; unknown ones, and all where there is no spread, are a half."""
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 10 > 0, cents("s_acctbal")).alias("b"))
    edges = percentiles(s, "b", [0.05, 0.95], ["higher", "lower"]).select(F.col("p0").alias("lo"), F.col("p1").alias("hi"))
    x = (clip_to(F.col("b"), F.col("lo"), F.col("hi")) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return s.join(F.broadcast(edges)).select("s_suppkey", places(F.coalesce(x, F.lit(0.5)), 6).alias("x"))  # one row


def clip_to(x, low, high):
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


NOISE = 200000


def _noisy(spark, d):
    """Customers' balances in cents, their noisy balance in a draw, which depends on keys alone, and what it is at least and at most."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", cents("c_acctbal").alias("b"))
    noisy = lambda draw: F.col("b") + F.floor(hash_uniform(F.col("c_custkey"), draw) * NOISE)
    return c, noisy, (F.col("b"), F.col("b") + NOISE)


def mc_p_best(spark, d):
    """How often each customer has its segment's best noisy balance in 40 draws; unknown ones are below all others."""
    c, noisy, bounds = _noisy(spark, d)
    known = lambda x: F.coalesce(x, F.lit(-(2**62)))
    return M.last_best(c, "c_mktsegment", "c_custkey", lambda draw: known(noisy(draw)), 40, tuple(map(known, bounds)))


def ladder_p_best(spark, d):
    """How often each customer has its segment's best noisy balance, over the reference's 2000 draws."""
    c, noisy, bounds = _noisy(spark, d)
    return M.p_best(c, "c_mktsegment", "c_custkey", noisy, bounds=bounds).select("c_mktsegment", "c_custkey", places("p_best", 8).alias("p_best"))


QUERIES = {f.__name__: f for f in (stratified_errors, reliability_bins, brier_logloss, cumulative_metrics, sigma_grouping_sets, empirical_cdf_by_type, weighted_ownership_se, share_of_group_max, first_change_latency, confusion_last_row, ols_slope, margin_sigma_fallback, softmax_threats, rule_table_score, convex_blend, availability_cascade, devig_normalise, poisson_tail, winsor_minmax, mc_p_best, ladder_p_best)}

P_ = "WITH s AS (SELECT least(n_chars / 20000.0, 1.0)::DOUBLE AS p, quality::BIGINT AS y FROM documents JOIN labels USING (doc_id))"
L_ = "WITH l AS (SELECT l_orderkey, l_suppkey, l_partkey, l_returnflag, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS v, CAST(round(l_discount * 100) AS BIGINT) AS disc FROM lineitem)"
E_ = "WITH e AS (SELECT *, CAST(ts AS DATE) AS day, CAST(round(value * 100) AS BIGINT) AS v FROM events)"
Y_ = "CAST(round(o_totalprice * 100) AS BIGINT) / 100000.0::DOUBLE"

ORACLE_SQL = {
    "stratified_errors": """WITH o AS (SELECT CAST(round(o_totalprice) AS BIGINT) AS a, lag(CAST(round(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders),
b AS (SELECT CASE WHEN a < 50000 THEN 'low' WHEN a < 200000 THEN 'mid' ELSE 'high' END AS bucket, CAST(p - a AS DOUBLE) AS e FROM o WHERE p IS NOT NULL)
SELECT coalesce(bucket, 'all') AS bucket, count(*) AS n, round(sqrt(avg(e * e)), 2) AS rmse, round(avg(abs(e)), 2) AS mae FROM b GROUP BY ROLLUP (bucket)""",
    "reliability_bins": f"{P_} SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 8) AS mean_p, round(avg(y), 8) AS mean_y FROM s WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY 1",
    "brier_logloss": f"{P_}, c AS (SELECT p, y, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM s) SELECT count(*) AS n, round(avg(pow(p - y, 2)), 4) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 4) AS log_loss FROM c",
    "cumulative_metrics": f"{E_}, t AS (SELECT CAST(day AS VARCHAR) AS day, sum(v) AS v, count(*) AS n FROM e GROUP BY 1) SELECT day, n, CAST(sum(n) OVER w AS BIGINT) AS n_so_far, round(CAST(sum(v) OVER w AS DOUBLE) / sum(n) OVER w, 2) AS mean_so_far FROM t WINDOW w AS (ORDER BY day)",
    "sigma_grouping_sets": f"{L_}, r AS (SELECT q // 10 AS q_bin, disc // 3 AS d_bin, CAST(v AS DOUBLE) / 100000.0 AS x FROM l) SELECT q_bin, d_bin, count(*) AS n, round(stddev_pop(x), 4) AS sigma FROM r GROUP BY GROUPING SETS ((q_bin, d_bin), (q_bin), ()) HAVING count(*) >= 100",
    "empirical_cdf_by_type": "SELECT o_orderpriority, CAST(k * 5000000 AS BIGINT) AS step, round(avg(CASE WHEN CAST(round(o_totalprice * 100) AS BIGINT) <= k * 5000000 THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS share FROM orders, range(1, 9) t(k) GROUP BY ALL",
    "weighted_ownership_se": f"{L_}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM orders), g AS (SELECT l_suppkey, CAST(sum(q) AS DOUBLE) AS a, CAST(sum(q * q) AS DOUBLE) AS b FROM l GROUP BY 1) SELECT l_suppkey, round(a / n * 100, 4) AS share, round(sqrt(greatest(b / n - (a / n) * (a / n), 0) / n) * 100, 4) AS se FROM g, n",
    "share_of_group_max": f"{L_}, g AS (SELECT p_brand, l_suppkey, CAST(sum(q) AS DOUBLE) AS q FROM l JOIN part ON p_partkey = l_partkey GROUP BY ALL), s AS (SELECT l_suppkey, q / sum(q) OVER (PARTITION BY p_brand) AS share FROM g) SELECT l_suppkey, round(max(share), 6) AS share FROM s GROUP BY 1",
    "first_change_latency": f"{E_}, f AS (SELECT user_id, ts AS t0, event_type AS was FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1) SELECT user_id, CAST(floor((epoch_us(min(ts)) - epoch_us(any_value(t0))) / 1000000) AS BIGINT) AS seconds FROM e JOIN f USING (user_id) WHERE event_type <> was GROUP BY 1",
    "confusion_last_row": f"{E_}, t AS (SELECT arg_max(v, (ts, event_id)) AS last, max(v) AS most FROM e GROUP BY user_id, day) SELECT last > 5000 AS said, most > 8000 AS was, count(*) AS n FROM t GROUP BY 1, 2",
    "ols_slope": f"WITH o AS (SELECT o_custkey, {Y_} AS y, year(o_orderdate) * 12 + month(o_orderdate) AS x FROM orders) SELECT o_custkey, count(*) AS n, round(regr_slope(y, x), 4) AS slope FROM o GROUP BY 1 HAVING count(*) >= 5 AND var_pop(x) > 0",
    "margin_sigma_fallback": f"WITH o AS (SELECT o_custkey, {Y_} AS y FROM orders), p AS (SELECT stddev_samp(y) AS s FROM o), g AS (SELECT o_custkey, count(*) AS n, stddev_samp(y) AS s FROM o GROUP BY 1) SELECT o_custkey, round(least(greatest(CASE WHEN n >= 6 THEN g.s ELSE p.s END, 0.5), 1.2), 4) AS sigma FROM g, p",
    "softmax_threats": "WITH b AS (SELECT c_custkey, c_mktsegment, CAST(round(c_acctbal * 100) AS BIGINT) / 100000.0::DOUBLE AS x FROM customer), c AS (SELECT *, exp(x - max(x) OVER (PARTITION BY c_mktsegment)) AS e FROM b) SELECT c_custkey, round(e / sum(e) OVER (PARTITION BY c_mktsegment), 8) AS weight FROM c",
    "rule_table_score": f"{L_} SELECT l_orderkey, CAST(sum(q * CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 1 WHEN 'R' THEN -2 ELSE 0 END) AS BIGINT) AS score FROM l GROUP BY 1",
    "convex_blend": f"{L_}, g AS (SELECT l_partkey, CAST(sum(v) AS DOUBLE) / sum(q) AS market FROM l GROUP BY 1), p AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS DOUBLE) AS own FROM part) SELECT p_partkey, round(coalesce(market * 0.8::DOUBLE + own * 0.2::DOUBLE, own), 3) AS blend FROM p LEFT JOIN g ON p_partkey = l_partkey",
    "availability_cascade": f"{E_} SELECT event_id, CAST(CASE WHEN v IS NULL THEN 1.0 WHEN v >= 7500 THEN 0.0 WHEN v >= 5000 AND user_id % 2 = 0 THEN 0.25 WHEN v >= 5000 THEN 0.5 WHEN v >= 2500 THEN 0.75 ELSE 1.0 END AS DOUBLE) AS chance FROM e",
    "devig_normalise": f"{L_}, g AS (SELECT l_orderkey, l_suppkey, sum(1.0::DOUBLE / v) AS i FROM l GROUP BY ALL) SELECT l_orderkey, l_suppkey, round(i / sum(i) OVER (PARTITION BY l_orderkey), 6) AS p FROM g",
    "poisson_tail": f"{L_}, g AS (SELECT l_orderkey, CAST(sum(q) AS DOUBLE) / 50.0 AS m FROM l GROUP BY 1) SELECT l_orderkey, round(1 - exp(-m) * (1 + m), 6) AS p FROM g",
    "winsor_minmax": "WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 > 0 THEN CAST(round(s_acctbal * 100) AS BIGINT) END AS b FROM supplier), l AS (SELECT list(b ORDER BY b) AS x FROM s WHERE b IS NOT NULL), e AS (SELECT x[CAST(ceil((len(x) - 1) * 0.05) AS INT) + 1] AS lo, x[CAST(floor((len(x) - 1) * 0.95) AS INT) + 1] AS hi FROM l) SELECT s_suppkey, CASE WHEN b IS NULL OR hi = lo THEN 0.5::DOUBLE ELSE round((least(greatest(b, lo), hi) - lo) / (hi - lo), 6) END AS x FROM s, e",
    "mc_p_best": """WITH c AS (SELECT c_custkey, c_mktsegment, CAST(round(c_acctbal * 100) AS BIGINT) AS b, draw FROM customer, range(0, 40) t(draw)),
n AS (SELECT *, b + CAST(floor(CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || '|' || CAST(draw AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE * 200000) AS BIGINT) AS s FROM c),
m AS (SELECT c_mktsegment, draw, c_custkey FROM n QUALIFY row_number() OVER (PARTITION BY c_mktsegment, draw ORDER BY s DESC, c_custkey DESC) = 1)
SELECT c_mktsegment, c_custkey, CAST(count(*) AS DOUBLE) / 40.0 AS p_best FROM m GROUP BY ALL""",
    "ladder_p_best": """WITH c AS (SELECT c_custkey, c_mktsegment, CAST(round(c_acctbal * 100) AS BIGINT) AS b, draw FROM customer, range(0, 2000) t(draw)),
n AS (SELECT *, b + CAST(floor(CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || '|' || CAST(draw AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE * 200000) AS BIGINT) AS s FROM c),
m AS (SELECT c_mktsegment, draw, max(s) AS s FROM n GROUP BY ALL),
w AS (SELECT c_custkey, 1.0::DOUBLE / count(*) OVER (PARTITION BY c_mktsegment, draw) AS share FROM n JOIN m USING (c_mktsegment, draw, s)),
p AS (SELECT c_custkey, sum(share) / 2000.0::DOUBLE AS p FROM w GROUP BY 1)
SELECT c_mktsegment, c_custkey, CASE WHEN NOT bool_or(c_acctbal IS NULL) OVER (PARTITION BY c_mktsegment) THEN round(coalesce(p, 0), 8) END AS p_best FROM customer LEFT JOIN p USING (c_custkey)""",
}
