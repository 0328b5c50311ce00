"""Queries on pages, scripts and names: items under headings, line-ups, spells, embedded records, names resolved in passes, and samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import cents, normalised_name
from ..operators import resolution, sampling
from ..sources import pages as P
from ..sources.tables import table

SLOTS = {"doubts": "doubt", ".pitch": "start"}


def page_items(spark, d):
    """What pages list and say, in order, under their headings."""
    found = P.page_items(table(spark, d, "pages"), "page_id", "html")
    return found.select("page_id", "n", "tag", F.array_join("path", " / ").alias("path"), "text", F.array_join("refs", " ").alias("refs"))


def _lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("k"), F.col("l_partkey").cast("bigint").alias("part"), F.col("l_suppkey").cast("bigint").alias("supp"), "l_returnflag", "l_linestatus", F.col("l_quantity").cast("bigint").alias("q"), F.year("l_shipdate").alias("yr"), "l_shipdate")


def lineup_rows(spark, d):
    """Line-ups from a page an order: a section a return flag, open lines as doubts; each ninth page breaks after its first section."""
    start = F.concat(F.lit('<li title="Sur'), "supp", F.lit(" (Fore"), "k", F.lit(')"><img src="/photos/250x250/'), "part", F.lit('.png"></li>'))
    doubt = F.concat(F.lit("<li><b>Name</b>"), "part", F.lit(" 50%</li>"))
    li = _lines(spark, d).withColumns({"start": F.when(F.col("l_linestatus") == "F", start), "doubt": F.when(F.col("l_linestatus") != "F", doubt)})
    told = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("k", c)))), lambda x: x[c]), "")
    sections = li.groupBy("l_orderkey", "l_returnflag").agg(F.concat(F.lit("<section><h2>Club &amp; "), F.first("l_returnflag"), F.lit('</h2>\n<ul class="a pitch">'), told("start"), F.lit('</ul><h4>Doubts</h4><ul class="players">'), told("doubt"), F.lit("</ul></section>")).alias("s"))
    pages = sections.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_returnflag", "s"))), lambda x: x["s"]).alias("s"))
    broken = F.array_join(F.when(F.col("l_orderkey") % 9 == 0, F.concat(F.slice("s", 1, 1), F.array(F.lit("</table>")), F.slice("s", F.lit(2), F.size("s")))).otherwise(F.col("s")), "")
    pages = pages.select("l_orderkey", F.concat(F.lit("<!DOCTYPE html><html><head><script>var x = '<li>';</script></head><body>"), broken, F.lit("</body></html>")).alias("html"))
    found = P.lineups(P.page_items(pages, "l_orderkey", "html", ["li"]), "l_orderkey", SLOTS)
    return found.select("l_orderkey", "n", "club", "slot", "name", "code")


def injury_spells(spark, d):
    """Spells from a table an order, a row a line; the fourth line's length can't be read."""
    length = lambda r: F.when(r["k"] == 4, F.lit("-")).otherwise(F.concat(r["q"], F.when(r["q"] == 1, " day").otherwise(" days")))
    row = lambda r: F.concat(F.lit("<tr><td>"), r["yr"], F.lit("</td><td><b>Type</b> "), r["l_returnflag"], F.lit(" &eacute;</td><td>a</td><td>b</td><td>"), length(r), F.lit("</td><td>"), r["k"], F.lit(" games</td></tr>"))
    head = F.lit("<table><tr>" + "".join(f"<td>{c}</td>" for c in ("Season", "Injury", "from", "until", "Days", "Games")) + "</tr>")
    lines = _lines(spark, d).select("l_orderkey", "k", "yr", "l_returnflag", "q").repartition("l_orderkey")  # their numbers are shuffled, not their lists
    rows = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("k", "yr", "l_returnflag", "q"))).alias("lines"))
    pages = rows.select("l_orderkey", F.concat(head, F.array_join(F.transform("lines", row), ""), F.lit("</table>")).alias("html"))
    return P.page_spells(pages, "l_orderkey", "html")


def embedded_matches(spark, d):
    """Matches from the scripts of a page an order, a match a line; every seventh page's payload is cut off."""

    def told(text: str) -> Column:
        """A constant part of the JSON as it stands in the script."""
        text = text.replace("\\", r"\\").replace("'", r"\'")
        for char, code in (('"', "22"), ("[", "5B"), ("{", "7B"), ("}", "7D"), ("]", "5D")):
            text = text.replace(char, rf"\x{code}")
        return F.lit(text)

    field = lambda before, value, after: F.coalesce(F.concat(told(before), value, told(after)), F.lit(""))
    record = lambda r: F.concat(
        told('{"id":"'), F.concat_ws("-", "l_orderkey", r["k"]), told('"'), field(',"datetime":"', F.date_format(r["l_shipdate"], "yyyy-MM-dd HH:mm:ss"), '"'), told(',"h":{'), field('"title":"N&#039;Golo ', r["supp"].cast("string"), '"'),
        told('},"a":{'), field('"title":"A &amp; \\"B\\" \\\\ ', r["part"].cast("string"), ' it\'s"'), told("}"), field(',"isResult":', (r["l_linestatus"] == "F").cast("string"), ""), told("}"),
    )
    line = F.struct("k", "l_shipdate", "supp", "part", "l_linestatus")
    rows = _lines(spark, d).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    rows = rows.withColumn("script", F.concat(told("["), F.array_join(F.transform("lines", record), ","), told("]")))
    script = F.col("script")
    script = F.when(F.col("l_orderkey") % 7 == 0, F.substring(script, F.lit(1), F.length(script) - 9)).otherwise(script)
    pages = rows.select("l_orderkey", F.concat(F.lit("<html><script>var other = 1; var datesData = JSON.parse('"), script, F.lit("');</script></html>")).alias("html"))
    shape = "array<struct<id: string, datetime: string, h: struct<title: string>, a: struct<title: string>, isResult: boolean>>"
    found = pages.select("l_orderkey", F.explode(P.embedded_json(F.col("html"), "datesData", shape)).alias("m"))
    return found.select("l_orderkey", F.col("m.id").alias("match_id"), F.to_date("m.datetime").cast("string").alias("day"), P.unescaped(F.col("m.h.title")).alias("home"), P.unescaped(F.col("m.a.title")).alias("away"), F.col("m.isResult").alias("is_result"))


def resolved_names(spark, d):
    """Parts against the names that another list has for them: turned, cut short, with another club, or unknown."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("k"), normalised_name(F.concat_ws(" ", "p_name", "p_type")).alias("name"), F.col("p_brand").alias("club"))
    words = F.split("name", " ")
    short = F.concat_ws(" ", F.left(F.element_at(words, 1), F.lit(3)), F.element_at(words, -1))
    said = F.when(F.col("k") % 5 == 1, F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), " ")).when(F.col("k") % 5 == 2, short).when(F.col("k") % 5 == 3, F.concat_ws(" ", F.lit("zz"), "k")).otherwise(F.col("name"))
    left = p.select(F.col("k").alias("source_id"), said.alias("name"), F.when(F.col("k") % 5 == 4, F.lit("elsewhere")).otherwise(F.col("club")).alias("club"))
    right = p.select((F.col("k") + 1_000_000).alias("code"), "name", "club")
    overrides = p.where("k % 10 = 3").select(F.col("k").alias("source_id"), (F.col("k") + 1_000_000).alias("code"))
    return resolution.resolve_clubs(left, right, overrides)


def sampled_lines(spark, d):
    """Twenty lines of each return flag and year, drawn by hash."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("k"), "l_returnflag", F.year("l_shipdate").cast("bigint").alias("yr"), cents("l_extendedprice").alias("v"))
    return sampling.sample(li, ["l_returnflag", "yr"], ["l_orderkey", "k", "v"], 20, 7)


def sampled_slots(spark, d):
    """Three hundred places of all customers by balance, fifty a page, and who stands there."""
    c = table(spark, d, "customer").select("c_custkey", (-cents("c_acctbal")).alias("b"))
    return sampling.sampled_slots(c, ["b"], "c_custkey", 300, 11, 50)


QUERIES = {f.__name__: f for f in (page_items, lineup_rows, injury_spells, embedded_matches, resolved_names, sampled_lines, sampled_slots)}

_L = "WITH l AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS k, CAST(l_partkey AS BIGINT) AS part, CAST(l_suppkey AS BIGINT) AS supp, l_returnflag AS f, l_linestatus AS s, CAST(l_quantity AS BIGINT) AS q, l_shipdate AS day FROM lineitem)"

ORACLE_SQL = {
    "lineup_rows": f"""{_L}, r AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY f) AS section FROM l)
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY f, s <> 'F', k, CASE WHEN s = 'F' THEN 'Sur' || supp || ' (Fore' || k || ')"><img src="/photos/250x250/' || part || '.png' ELSE part || ' 50%' END) - 1 AS n, 'Club & ' || f AS club, CASE WHEN s = 'F' THEN 'start' ELSE 'doubt' END AS slot,
  CASE WHEN s = 'F' THEN 'Fore' || k || ' Sur' || supp ELSE 'Name ' || part END AS name, CASE WHEN s = 'F' THEN part END AS code FROM r WHERE l_orderkey % 9 <> 0 OR section = 1""",
    "injury_spells": f"{_L} SELECT l_orderkey, CAST(year(l.day) AS VARCHAR) AS season, 'type ' || lower(f) || ' é' AS injury, q::DOUBLE AS days, k::DOUBLE AS games FROM l WHERE k <> 4",
    "embedded_matches": f"""{_L} SELECT l_orderkey, l_orderkey || '-' || k AS match_id, strftime(l.day, '%Y-%m-%d') AS day, 'N''Golo ' || supp AS home, 'A & "B" \\ ' || part || ' it''s' AS away, s = 'F' AS is_result FROM l WHERE l_orderkey % 7 <> 0""",
    "sampled_lines": """WITH l AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS k, l_returnflag, year(l_shipdate) AS yr, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem)
SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_returnflag, yr ORDER BY md5('7|' || l_returnflag || '|' || yr || '|' || l_orderkey || '|' || k || '|' || v), l_orderkey, k, v) <= 20""",
    "sampled_slots": """WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY CAST(round(c_acctbal * 100) AS BIGINT) DESC, c_custkey) - 1 AS i FROM customer), s AS (SELECT i // 50 + 1 AS page, i % 50 AS slot, c_custkey FROM r)
SELECT page, slot, c_custkey FROM s ORDER BY md5('11|' || page || '|' || slot), page, slot LIMIT 300""",
}
