"""Queries on ratings, score grids, stopping, resolution, learned heads and a finality-gated stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import cents, normalised_name, places
from ..operators import models, policy, resolution, softmax
from ..operators.ordered import shared_dir
from ..sources.tables import table
from ..streaming import finality


def elo_sequential(spark, d):
    """Customer nation against supplier nation, a pool per year and priority, a match per line of an order."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    score = F.when(F.col("l_quantity") > 25, 1.0).when(F.col("l_quantity") == 25, 0.5).otherwise(0.0)
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("c_nationkey <> s_nationkey").select(
        F.concat_ws(" ", F.year("o_orderdate"), "o_orderpriority").alias("pool"), F.col("o_orderdate").cast("string").alias("day"), "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.col("c_nationkey").cast("bigint").alias("home"), F.col("s_nationkey").cast("bigint").alias("away"), score.alias("score")
    )
    rated = models.elo(rows, "pool", ["day", "l_orderkey", "l_linenumber", "away", "score"], "home", "away", "score")
    return rated.select("l_orderkey", "l_linenumber", "home", "away", places("home_elo", 6).alias("home_elo"), places("away_elo", 6).alias("away_elo"))


def fixture_outcomes(spark, d):
    means = table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), (0.5 + (F.col("s_suppkey") % 20) / 10.0).alias("lam"), (0.4 + F.col("s_nationkey") / 12.5).alias("mu"))
    found = models.fixture_outcomes(means, "s_suppkey", "lam", "mu", -0.05)
    return found.select("s_suppkey", *(places(c, 6).alias(c) for c in ("p_home", "p_draw", "p_away", "home_clean", "away_clean")))


def stopping_thresholds(spark, d):
    draws = table(spark, d, "events").select("event_type", F.floor(F.dayofmonth("ts") / 10).alias("slot"), F.round("value").alias("x"))
    return policy.stopping_thresholds(draws, "event_type", "slot", "x").select("event_type", "slot", places("threshold").alias("threshold"), places("worth").alias("worth"))


def mixture_by_duplication(spark, d):
    e = table(spark, d, "events").select("event_type", cents("value").alias("value"))
    return policy.mixture(e, F.lit(0.3), F.col("value") * 2, 10).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))


def best_slot_gain(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("bigint").alias("o_custkey"), F.month("o_orderdate").cast("bigint").alias("slot")).agg(F.sum(cents("o_totalprice")).alias("gain"))
    return policy.best_slot(o, "o_custkey", "slot", "gain")


def threshold_gate(spark, d):
    p = table(spark, d, "events").groupBy("user_id").agg((F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)) / F.count(F.lit(1))).alias("share"))
    return p.select(F.col("user_id").cast("bigint").alias("user_id"), policy.gate(F.col("share"), 0.25, 0.0625).alias("decision"))


def token_resolution(spark, d):
    """Parts, named with their keys, against a list of the same names of which every second has its words turned round."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("p_partkey"), F.concat_ws(" ", "p_name", "p_partkey").alias("p_name"))
    left = p.select(F.col("p_partkey").alias("source_id"), normalised_name("p_name").alias("name"))
    turned = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.array_join(F.reverse(F.split("p_name", " ")), " "))
    right = p.select((F.col("p_partkey") + 1_000_000).alias("code"), normalised_name(turned).alias("name"))
    name = F.col("name")
    return resolution.resolve(left, right, [("name", name, name), ("tokens", resolution.sorted_tokens(name), resolution.sorted_tokens(name))])


def _labelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("p"))
    return docs.join(table(spark, d, "labels"), "doc_id").select("doc_id", "n_chars", "p", F.col("quality").cast("double").alias("y"))


def isotonic_calibration(spark, d):
    return models.isotonic_steps(_labelled(spark, d), "p", "y")


def gbt_head(spark, d):
    """Every labelled row with the score of a head that hasn't seen it, in five folds by hash."""
    rows = _labelled(spark, d).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(5)))
    return models.out_of_fold(rows, "fold", ["n_chars", "p"], "y", "score", binary=True).select("doc_id", "y", "score")


def three_modes(spark, d):
    """Chances of three modes of a document (English, German, another language) from its length and marks, learned from four in five; mode is what it is."""
    share = lambda letters: F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(f"[{letters}]")) / F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1))
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n"), share("ehr").alias("common"), share("äöüß").alias("dots"), F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2).alias("mode"))
    features = ["n", "common", "dots"]
    model = softmax.fit(docs.where("doc_id % 5 > 0"), features, "mode", 3, rounds=10)
    found = model.predicted(docs, "p")
    return found.select("doc_id", "mode", (F.col("doc_id") % 5 == 0).alias("held_out"), *[places(F.get("p", F.lit(k)), 6).alias(f"p{k}") for k in range(3)])


def stream_append_finality(spark, d):
    """Days of events as a stream closes them: a day is final, and is appended once, when two hours after its end have been seen.

    The path is a pattern, since a stream of a single file's path isn't allowed.
    """
    path, schema = f"{d}/events.parquet*", spark.read.parquet(f"{d}/events.parquet").schema
    own = f"{shared_dir(spark)}/finality-{uuid.uuid4().hex}"
    events = finality.parquet_stream(spark, path, schema, files_at_once=1_000_000).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", cents("value").alias("v"))
    finality.run_to_table(finality.final_windows(events, "ts", "event_type", "v"), f"{own}/table", f"{own}/checkpoint")
    rows = spark.read.schema("start timestamp, event_type string, n bigint, total bigint").parquet(f"{own}/table")
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


QUERIES = {
    f.__name__: f
    for f in (elo_sequential, fixture_outcomes, stopping_thresholds, mixture_by_duplication, best_slot_gain, threshold_gate, token_resolution, isotonic_calibration, gbt_head, three_modes, stream_append_finality)
}

_CENTS = "CAST(round({} * 100) AS BIGINT)"

ORACLE_SQL = {
    "fixture_outcomes": """
WITH m AS (SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, 0.5::DOUBLE + (s_suppkey % 20) / 10.0::DOUBLE AS lam, 0.4::DOUBLE + s_nationkey / 12.5::DOUBLE AS mu FROM supplier),
k AS (SELECT unnest(range(11)) AS k),
g AS (SELECT m.*, h.k AS h, a.k AS a, greatest(0, exp(h.k * ln(lam) - lam) / factorial(h.k::INT)::DOUBLE * exp(a.k * ln(mu) - mu) / factorial(a.k::INT)::DOUBLE
  * CASE WHEN h.k = 0 AND a.k = 0 THEN 1 - lam * mu * -0.05::DOUBLE WHEN h.k = 0 AND a.k = 1 THEN 1 + lam * -0.05::DOUBLE WHEN h.k = 1 AND a.k = 0 THEN 1 + mu * -0.05::DOUBLE WHEN h.k = 1 AND a.k = 1 THEN 1.05::DOUBLE ELSE 1 END) AS p FROM m, k h, k a)
SELECT s_suppkey, round(sum(CASE WHEN h > a THEN p ELSE 0 END) / sum(p), 6) AS p_home, round(sum(CASE WHEN h = a THEN p ELSE 0 END) / sum(p), 6) AS p_draw, round(sum(CASE WHEN h < a THEN p ELSE 0 END) / sum(p), 6) AS p_away,
  round(sum(CASE WHEN a = 0 THEN p ELSE 0 END) / sum(p), 6) AS home_clean, round(sum(CASE WHEN h = 0 THEN p ELSE 0 END) / sum(p), 6) AS away_clean FROM g GROUP BY s_suppkey""",
    "elo_sequential": """
WITH RECURSIVE m AS (SELECT year(o_orderdate) || ' ' || o_orderpriority AS pool, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(c_nationkey AS BIGINT) AS home, CAST(s_nationkey AS BIGINT) AS away, CASE WHEN l_quantity > 25 THEN 1.0 WHEN l_quantity = 25 THEN 0.5 ELSE 0.0 END::DOUBLE AS score, o_orderdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey),
i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY o_orderdate, l_orderkey, l_linenumber, away, score) AS i FROM m),
s AS MATERIALIZED (SELECT i, list(struct_pack(pool := pool, k := l_orderkey, n := l_linenumber, home := home, away := away, score := score)) AS now FROM i GROUP BY i),
r AS (SELECT 0::BIGINT AS i, map([('', -1::BIGINT)], [0.0::DOUBLE]) AS e, NULL::STRUCT(k BIGINT, n BIGINT, home BIGINT, away BIGINT, h DOUBLE, a DOUBLE)[] AS told
  UNION ALL SELECT i, map_concat(e, map_from_entries(flatten(list_transform(x, lambda y: [((y.pool, y.home), y.h + y.move), ((y.pool, y.away), y.a - y.move)])))), list_transform(x, lambda y: struct_pack(k := y.k, n := y.n, home := y.home, away := y.away, h := y.h, a := y.a))
  FROM (SELECT s.i, r.e, list_transform(list_transform(s.now, lambda y: struct_pack(pool := y.pool, k := y.k, n := y.n, home := y.home, away := y.away, score := y.score, h := coalesce(r.e[(y.pool, y.home)], 1500.0), a := coalesce(r.e[(y.pool, y.away)], 1500.0))),
    lambda y: struct_pack(pool := y.pool, k := y.k, n := y.n, home := y.home, away := y.away, h := y.h, a := y.a, move := 20.0 * (y.score - 1 / (1 + pow(10.0, (y.a - y.h) / 400.0))))) AS x FROM r JOIN s ON s.i = r.i + 1))
SELECT t.k AS l_orderkey, t.n AS l_linenumber, t.home, t.away, round(t.h, 6) AS home_elo, round(t.a, 6) AS away_elo FROM (SELECT unnest(told) AS t FROM r)""",
    "stopping_thresholds": """
WITH RECURSIVE d AS (SELECT event_type, CAST(floor(day(ts) / 10.0) AS BIGINT) AS slot, round(value) AS x FROM events WHERE value IS NOT NULL),
l AS (SELECT event_type, max(slot) AS slot FROM d GROUP BY event_type),
r AS (SELECT d.event_type, d.slot, 0.0::DOUBLE AS threshold, avg(greatest(x, 0.0)) AS worth FROM d JOIN l USING (event_type, slot) GROUP BY d.event_type, d.slot
  UNION ALL SELECT d.event_type, d.slot, any_value(r.worth), avg(greatest(x, r.worth)) FROM r JOIN d ON d.event_type = r.event_type AND d.slot = r.slot - 1 GROUP BY d.event_type, d.slot)
SELECT event_type, slot, round(threshold, 4) AS threshold, round(worth, 4) AS worth FROM r""",
    "mixture_by_duplication": f"""
WITH e AS (SELECT event_type, {_CENTS.format("value")} AS v FROM events), c AS (SELECT e.*, copy FROM e, range(10) t(copy)),
x AS (SELECT event_type, CASE WHEN copy < 3 THEN v * 2 ELSE v END AS v FROM c)
SELECT event_type, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, max(v) AS most FROM x GROUP BY event_type""",
    "best_slot_gain": f"""
WITH o AS (SELECT CAST(o_custkey AS BIGINT) AS o_custkey, month(o_orderdate) AS slot, CAST(sum({_CENTS.format("o_totalprice")}) AS BIGINT) AS gain FROM orders GROUP BY ALL)
SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY gain DESC, slot) = 1""",
    "threshold_gate": """
WITH p AS (SELECT CAST(user_id AS BIGINT) AS user_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) / count(*)::DOUBLE AS share FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN share >= 0.25 THEN 'act' WHEN share >= 0.1875 THEN 'near' ELSE 'hold' END AS decision FROM p""",
    "token_resolution": """
WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS n,
  trim(regexp_replace(lower(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE array_to_string(list_reverse(string_split(p_name, ' ')), ' ') END), '[^a-z0-9]+', ' ', 'g')) AS m FROM (SELECT p_partkey, concat_ws(' ', p_name, p_partkey) AS p_name FROM part)),
l1 AS (SELECT n AS k, min(id) AS source_id FROM p WHERE n <> '' GROUP BY n HAVING count(*) = 1), r1 AS (SELECT m AS k, min(id) + 1000000 AS code FROM p WHERE m <> '' GROUP BY m HAVING count(*) = 1),
a AS (SELECT source_id, code FROM l1 JOIN r1 USING (k)),
l2 AS (SELECT array_to_string(list_sort(list_distinct(string_split(n, ' '))), ' ') AS k, min(id) AS source_id FROM p WHERE n <> '' AND id NOT IN (SELECT source_id FROM a) GROUP BY k HAVING count(*) = 1),
r2 AS (SELECT array_to_string(list_sort(list_distinct(string_split(m, ' '))), ' ') AS k, min(id) + 1000000 AS code FROM p WHERE m <> '' AND id + 1000000 NOT IN (SELECT code FROM a) GROUP BY k HAVING count(*) = 1)
SELECT source_id, code, 'name' AS rule FROM a UNION ALL SELECT source_id, code, 'tokens' FROM l2 JOIN r2 USING (k)""",
    "stream_append_finality": f"""
WITH e AS (SELECT ts, event_type, {_CENTS.format("value")} AS v FROM events)
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM e
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM e) - INTERVAL 2 HOUR GROUP BY ALL""",
}
