"""Queries on joins and observation logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cents, normalised_name, places, table_cells
from ..operators import facts as facts_op
from ..operators import joins as J
from ..operators.ordered import ranked
from ..sources.tables import table

SPELLS = [(0, "2024-01-01", "2024-01-10", "a"), (0, "2024-01-10", None, "b"), (1, "2024-01-05", "2024-01-20", "c"), (1, "2024-01-15", "2024-01-25", "d")]
SLOTS = [(k, f"2024-01-{1 + 7 * k:02d}") for k in range(5)]


def _events(spark, d):
    return table(spark, d, "events").withColumn("day", F.to_date("ts"))


def _slots(spark):
    return spark.createDataFrame(SLOTS, "slot long, at string").withColumn("at", F.col("at").cast("timestamp"))


def interval_join_spells(spark, d):
    spells = spark.createDataFrame(SPELLS, "k long, start string, end string, spell string").withColumns({c: F.col(c).cast("timestamp") for c in ("start", "end")})
    e = _events(spark, d).select("event_id", "ts", F.pmod("user_id", F.lit(3)).alias("k"))
    out = J.interval_join(e, spells, "k", "ts")
    return out.select("event_id", F.coalesce("spell", F.concat(F.lit("k"), "k")).alias("spell"))


def slot_window_assign(spark, d):
    spells = _slots(spark).withColumn("end", F.lead("at").over(Window.orderBy("at"))).select(F.lit(0).alias("k"), "slot", F.col("at").alias("start"), "end")  # a row a slot
    return J.interval_join(_events(spark, d).select("event_id", "ts", F.lit(0).alias("k")), spells, "k", "ts").select("event_id", "slot")


def asof_forward(spark, d):
    """The first slot due at or after an event: a lookup in one sorted array of all slots."""
    slots = _slots(spark).agg(F.array_sort(F.collect_list(F.struct("at", "slot"))).alias("slots"))
    e = _events(spark, d).select("event_id", "ts").join(F.broadcast(slots))  # one row
    return e.select("event_id", F.get(F.filter("slots", lambda s: s["at"] >= F.col("ts")), F.lit(0))["slot"].alias("slot"))


def _nation_orders(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("nation"))
    return table(spark, d, "orders").join(c, "o_custkey").select("o_orderkey", "nation", F.col("o_orderdate").alias("t"), cents("o_totalprice").alias("v"))


def asof_backward_latest(spark, d):
    o = _nation_orders(spark, d)
    before = o.groupBy("nation", "t").agg(F.max("v").alias("latest"))
    return J.as_of(o.select("o_orderkey", "nation", "t"), before, ["nation"], "t", "latest", bucket=F.date_trunc("month", "t")).select("o_orderkey", "nation", "latest")


def asof_next(spark, d):
    o = _nation_orders(spark, d)
    after = o.groupBy("nation", "t").agg(F.max("v").alias("next"))
    return J.as_of(o.select("o_orderkey", "nation", "t"), after, ["nation"], "t", "next", forward=True, bucket=F.date_trunc("month", "t")).select("o_orderkey", "nation", "next")


def many_to_one_enrich(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"), cents("c_acctbal").alias("bal"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", cents("o_totalprice").alias("v"))
    out = J.many_to_one(J.many_to_one(o, c, ["o_custkey"]), n, ["n_nationkey"])
    return out.select("o_orderkey", "n_name", (F.col("v") - F.col("bal")).alias("diff"))


def lookup_conflict_poison(spark, d):
    return J.agreed(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


def semi_having(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("bigint").alias("q"))
    return li.groupBy("l_orderkey").agg(F.max("q").alias("most"), F.min("q").alias("least")).where("most >= 45")


def anti_threats(spark, d):
    open_orders = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(open_orders, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


def dense_grid_counts(spark, d):
    return J.dense_counts(_events(spark, d).withColumn("day", F.col("day").cast("string")), "day", "event_type")


def idempotent_append(spark, d):
    e = _events(spark, d).select("event_id", F.col("day").cast("string").alias("day"), cents("value").alias("value"))
    log, new = e.where("day <= '2024-01-20'"), e.where("day >= '2024-01-18'")
    return J.replace_append(J.replace_append(log, new, ["day"]), new, ["day"])


def dedupe_keep_last(spark, d):
    e = _events(spark, d)
    last = e.groupBy("user_id", "day").agg(F.max_by(F.struct("event_id", cents("value").alias("value")), F.struct("ts", "event_id")).alias("l"))
    return last.select("user_id", F.col("day").cast("string").alias("day"), "l.event_id", "l.value")


def trend_projection(spark, d):
    daily = _events(spark, d).groupBy("user_id", "day").agg(F.sum(cents("value")).alias("v"))
    w = Window.partitionBy("user_id").orderBy(F.desc("day"))
    two = daily.withColumns({"n": F.row_number().over(w), "before": F.lead("v").over(w)}).where("n = 1")
    return two.select("user_id", "v", (2 * F.col("v") - F.col("before")).alias("projected"))


def version_diff_movers(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("yr"), cents("o_totalprice").alias("v"))
    one = lambda y, n: o.where(F.col("yr") == y).groupBy("o_custkey").agg(F.sum("v").alias(n))
    both = one(1996, "old").join(one(1997, "new"), "o_custkey", "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "dropped").otherwise("moved")
    return both.where("old IS NULL OR new IS NULL OR abs(new - old) >= 1000000").select("o_custkey", kind.alias("kind"), (F.coalesce("new", F.lit(0)) - F.coalesce("old", F.lit(0))).alias("delta"))


def pair_by_category(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", cents("p_retailprice").alias("price"))
    up = ranked(p, ["p_brand"], [F.col("price"), F.col("p_partkey")], "n")
    down = ranked(p, ["p_brand"], [F.desc("price"), F.col("p_partkey")], "n")
    return up.alias("a").join(down.alias("b"), ["p_brand", "n"]).select("p_brand", F.col("a.p_partkey").alias("low"), F.col("b.p_partkey").alias("high"), (F.col("b.price") - F.col("a.price")).alias("gap"))


def json_props_extract(spark, d):
    return _events(spark, d).select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def name_normalise(spark, d):
    """Part names, some of them with accents put on, as plain ones."""
    return table(spark, d, "part").select("p_partkey", normalised_name(F.translate("p_name", "aeoncs", "ÁêØñçš")).alias("name"))


def numbers_in_facts(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([0-9]+)"), 1)).cast("bigint").alias("numbers"))


def check_brief(spark, d):
    """Numbers and capitalised names that the other turns of a conversation say and its user's turns don't; capitalised words of any user's turn are known names, months and weekdays none."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text", F.col("role").eqNullSafe(F.lit("user")).alias("fact"))
    known = facts_op.tokens(c.where("fact"), [], "text").where((F.col("kind") == "name") & F.col("token").rlike(r"^\p{Lu}")).select(F.col("token").alias("name"))
    return facts_op.offences(c.where("fact"), c.where("NOT fact"), "conv_id", "turn", "text", allow=facts_op.calendar_names(spark), known=known)


def html_table_parse(spark, d):
    """The items that a page lists, and the cells of its tables if it has any, as rows in their order."""
    p = table(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("h"))
    links = F.arrays_zip(F.regexp_extract_all("h", F.lit(LINK), 1).alias("x"), F.regexp_extract_all("h", F.lit(LINK), 2).alias("y"))
    cells = F.flatten(F.transform(table_cells(F.col("h")), lambda r, i: F.transform(r, lambda c: F.struct(i.cast("string").alias("x"), c.alias("y")))))
    return p.select("page_id", F.posexplode(F.concat(links, cells)).alias("n", "c")).select("page_id", F.col("n").cast("bigint").alias("n"), F.col("c.x").alias("key"), F.col("c.y").alias("value"))


def bounded_counter_fold(spark, d):
    """Free moves left: from one, each month of the calendar adds one, up to five, after paying for its orders; months of a chip (every eleventh) change nothing."""
    o = table(spark, d, "orders").select("o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("slot"))
    span = o.agg(F.min("slot").alias("first"), F.max("slot").alias("last"))
    months = o.groupBy("o_custkey", "slot").agg(F.count(F.lit(1)).alias("n")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("used"))  # a calendar's months
    spent = lambda m: F.coalesce(F.try_element_at("used", m), F.lit(0))
    step = lambda bank, m: F.when(m % 11 == 0, bank).otherwise(F.least(F.lit(5), F.greatest(bank - spent(m), F.lit(0)) + 1)).cast("bigint")
    folded = F.aggregate(F.sequence("first", "last"), F.lit(1).cast("bigint"), step)
    return months.join(F.broadcast(span)).select("o_custkey", folded.alias("bank"))  # one row


LINK = '<a href="([^"]*)"[^>]*>([^<]*)</a>'

QUERIES = {f.__name__: f for f in (interval_join_spells, slot_window_assign, asof_forward, asof_backward_latest, asof_next, many_to_one_enrich, lookup_conflict_poison, semi_having, anti_threats, dense_grid_counts, idempotent_append, dedupe_keep_last, trend_projection, version_diff_movers, pair_by_category, json_props_extract, name_normalise, numbers_in_facts, check_brief, html_table_parse, bounded_counter_fold)}

ACCENTED = "translate(p_name, 'aeoncs', 'ÁêØñçš')"
_values = lambda rows: ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in rows)
S_ = f"WITH s AS (SELECT CAST(slot AS BIGINT) AS slot, CAST(due AS TIMESTAMP) AS due FROM (VALUES {_values(SLOTS)}) v(slot, due))"
N_ = "WITH o AS (SELECT o_orderkey, CAST(c_nationkey AS BIGINT) AS nation, o_orderdate AS t, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders JOIN customer ON o_custkey = c_custkey), r AS (SELECT nation, t, max(v) AS v FROM o GROUP BY ALL)"
V_ = "CAST(round(value * 100) AS BIGINT)"
DAY = "CAST(CAST(ts AS DATE) AS VARCHAR)"
BLANK = facts_op.BLANK

ORACLE_SQL = {
    "interval_join_spells": f"""WITH s AS (SELECT k, CAST(a AS TIMESTAMP) AS a, CAST(b AS TIMESTAMP) AS b, n FROM (VALUES {_values(SPELLS)}) v(k, a, b, n))
SELECT event_id, coalesce(arg_min(n, a), 'k' || CAST(any_value(user_id % 3) AS VARCHAR)) AS spell FROM events LEFT JOIN s ON k = user_id % 3 AND ts >= a AND (b IS NULL OR ts < b) GROUP BY event_id""",
    "slot_window_assign": f"{S_} SELECT event_id, (SELECT max(slot) FROM s WHERE due <= ts) AS slot FROM events",
    "asof_forward": f"{S_} SELECT event_id, (SELECT min(slot) FROM s WHERE due >= ts) AS slot FROM events",
    "asof_backward_latest": f"{N_} SELECT o_orderkey, o.nation, r.v AS latest FROM o ASOF LEFT JOIN r ON o.nation = r.nation AND o.t > r.t",
    "asof_next": f"{N_} SELECT o_orderkey, o.nation, r.v AS next FROM o ASOF LEFT JOIN r ON o.nation = r.nation AND o.t < r.t",
    "many_to_one_enrich": "SELECT o_orderkey, n_name, CAST(round(o_totalprice * 100) AS BIGINT) - CAST(round(c_acctbal * 100) AS BIGINT) AS diff FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey",
    "lookup_conflict_poison": "SELECT l_orderkey, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS l_suppkey FROM lineitem GROUP BY l_orderkey",
    "semi_having": "SELECT l_orderkey, max(CAST(l_quantity AS BIGINT)) AS most, min(CAST(l_quantity AS BIGINT)) AS least FROM lineitem GROUP BY l_orderkey HAVING max(l_quantity) >= 45",
    "anti_threats": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')",
    "dense_grid_counts": f"SELECT day, event_type, (SELECT count(*) FROM events e WHERE {DAY.replace('ts', 'e.ts')} = a.day AND e.event_type = b.event_type) AS n FROM (SELECT DISTINCT {DAY} AS day FROM events) a, (SELECT DISTINCT event_type FROM events) b",
    "idempotent_append": f"SELECT event_id, {DAY} AS day, {V_} AS value FROM events",
    "dedupe_keep_last": f"SELECT user_id, {DAY} AS day, event_id, {V_} AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1",
    "trend_projection": f"WITH t AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum({V_}) AS BIGINT) AS v FROM events GROUP BY ALL), r AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS n FROM t WINDOW w AS (PARTITION BY user_id ORDER BY day)) SELECT user_id, v, 2 * v - b AS projected FROM r WHERE n = 1",
    "version_diff_movers": """WITH t AS (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (WHERE year(o_orderdate) = 1996) AS BIGINT) AS a, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (WHERE year(o_orderdate) = 1997) AS BIGINT) AS b FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'dropped' ELSE 'moved' END AS kind, coalesce(b, 0) - coalesce(a, 0) AS delta FROM t WHERE (a IS NOT NULL OR b IS NOT NULL) AND (a IS NULL OR b IS NULL OR abs(b - a) >= 1000000)""",
    "pair_by_category": "WITH p AS (SELECT p_brand, p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS price FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY price, p_partkey) AS u, row_number() OVER (PARTITION BY p_brand ORDER BY price DESC, p_partkey) AS w FROM p) SELECT a.p_brand, a.p_partkey AS low, b.p_partkey AS high, b.price - a.price AS gap FROM r a JOIN r b ON a.p_brand = b.p_brand AND a.u = b.w",
    "json_props_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "name_normalise": f"SELECT p_partkey, trim(regexp_replace(regexp_replace(strip_accents(lower({ACCENTED})), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS name FROM part",
    "numbers_in_facts": "SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS numbers FROM conversations",
    "check_brief": rf"""WITH t AS (SELECT conv_id, turn, role IS NOT DISTINCT FROM 'user' AS fact, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '^{BLANK}|{BLANK}$', '', 'g'), '([.!?]){BLANK}', '\1' || chr(1), 'g'), chr(1)) AS a FROM conversations),
s AS (SELECT conv_id, turn, fact, unnest(a) AS x, CAST(generate_subscripts(a, 1) AS BIGINT) AS sentence FROM t),
w AS (SELECT conv_id, turn, fact, sentence, unnest(string_split_regex(x, '{BLANK}')) AS w, generate_subscripts(string_split_regex(x, '{BLANK}'), 1) AS i FROM s),
k AS (SELECT conv_id, turn, fact, sentence, 'number' AS kind, ltrim(replace(replace(unnest(regexp_extract_all(x, '{facts_op.NUMBER}')), '−', '-'), ',', '.'), '+') AS token, 0 AS i FROM s
  UNION ALL SELECT conv_id, turn, fact, sentence, 'name', regexp_replace(regexp_replace(w, '{facts_op.EDGES}', '', 'g'), '[''’]s$', ''), i FROM w),
f AS (SELECT DISTINCT conv_id, kind, token FROM k WHERE fact AND token <> ''), o AS (SELECT DISTINCT token FROM f WHERE kind = 'name' AND regexp_matches(token, '^\p{{Lu}}'))
SELECT conv_id, turn, sentence, kind, token, count(*) AS n FROM k WHERE NOT fact
AND (kind = 'number' OR (token <> '' AND token NOT IN (SELECT monthname(make_date(2024, m, 1)) FROM range(1, 13) t(m) UNION ALL SELECT dayname(make_date(2024, 1, m)) FROM range(1, 8) t(m)) AND CASE WHEN i = 1 THEN token IN (SELECT token FROM o) ELSE regexp_matches(token, '^\p{{Lu}}') END))
AND NOT EXISTS (SELECT 1 FROM f WHERE f.conv_id IS NOT DISTINCT FROM k.conv_id AND f.kind = k.kind AND f.token = k.token)
AND NOT EXISTS (SELECT 1 FROM f WHERE f.conv_id IS NOT DISTINCT FROM k.conv_id AND f.kind = k.kind AND k.kind = 'number' AND f.token = ltrim(k.token, '-')) GROUP BY ALL""",
    "html_table_parse": f"""WITH p AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{LINK}', 1) AS xs, regexp_extract_all(coalesce(html, ''), '{LINK}', 2) AS ys FROM pages)
SELECT page_id, unnest(range(0, len(xs))) AS n, unnest(xs) AS key, unnest(ys) AS value FROM p""",
    "bounded_counter_fold": """WITH RECURSIVE m AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS slot, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT min(slot) AS a, max(slot) AS z FROM m),
f AS (SELECT DISTINCT o_custkey, a AS slot, z, CAST(1 AS BIGINT) AS bank FROM m, s UNION ALL
  SELECT f.o_custkey, f.slot + 1, z, CASE WHEN f.slot % 11 = 0 THEN bank ELSE CAST(least(5, greatest(bank - coalesce(n, 0), 0) + 1) AS BIGINT) END FROM f LEFT JOIN m ON m.o_custkey = f.o_custkey AND m.slot = f.slot WHERE f.slot <= z)
SELECT o_custkey, bank FROM f WHERE slot = z + 1""",
}
