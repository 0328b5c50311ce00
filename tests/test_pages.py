"""Parsers on small pages, names resolved against a plain sweep, samples whatever the partitions."""

import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.operators import resolution, sampling
from tidemark.sources import pages as P

LEVELS = {f"h{k}": k for k in range(1, 7)} | {".head": 9}
FIXTURE = """<!DOCTYPE html><html><head><title>x</title><style>li{}</style></head><body><h1>All</h1>
<section><h2>North &amp; Co</h2><p>one<p>two <b>bold<br>
<ul class="pitch"><li title="Ra&iacute;l (Jo)"><a href="/photos/players/40x40/17.png">x</a><li>Plain 75%<ul><li>inner</li></ul></li></ul>
<div><h4>Doubts</h4><ul class="players"><li class="head">Sure</li><li>A. B</li></ul></div><p>after</p></section>
<section><h2></h2><ul class="pitch"><li>nobody's</li></ul></section><p>5 < 6 &lt; 7</p>"""


def read(page, wanted=("li", "p")):
    return [(tag, path, text) for _, tag, path, _, _, _, _, text in P.items(page, wanted, LEVELS)]


def test_items_stand_under_the_headings_of_their_sections():
    north = ["All", "North & Co"]
    want = [("p", north, "one"), ("li", north, "x"), ("li", north, "inner"), ("li", north, "Plain 75% inner"), ("p", north, "two bold"), ("li", [*north, "Doubts", "Sure"], "A. B"), ("p", north, "after"), ("li", ["All", ""], "nobody's"), ("p", ["All"], "5 < 6 < 7")]
    assert sorted(read(FIXTURE)) == sorted(want)


def test_a_broken_page_gives_what_ended_before_the_fault():
    good = "<ul><li>a</li><li>b</li>"
    for bad in ("</table>", "<!-- open", "<a href='", "<script>var", "</"):
        assert [t for *_, t in read(f"{good}{bad}<li>c</li></ul>")] == ["a", "b"]
        assert [t for *_, t in read(f"<ul><li>a<li>b{bad}")] == ["a"]
    assert read("") == [] and read("<<<") == [] and [t for *_, t in read("<li>a<li>b")] == ["a", "b"]


def test_lineups(spark):
    df = spark.createDataFrame([(1, FIXTURE), (2, None), (3, "no tags")], "id int, html string")
    found = P.page_items(df, "id", "html", ["li"], {"h2": 2, "h4": 4})
    rows = {tuple(r) for r in P.lineups(found, "id", {"doubts": "doubt", ".pitch": "start"}).select("club", "slot", "name", "code").collect()}
    assert rows == {("North & Co", "start", "Jo Raíl", 17), ("North & Co", "start", "inner", None), ("North & Co", "start", "Plain inner", None), ("North & Co", "doubt", "Sure", None), ("North & Co", "doubt", "A. B", None)}


def test_spells(spark):
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    page = "<table>" + row("Season", "Injury", "a", "b", "9 days", "g") + row("23/24", "Knee&nbsp;<i>Injury</i>", "a", "b", "31 days", "5") + row("22/23", "Flu", "a", "b", "?", "1") + row("21/22", "Cold", "a", "b", "1 day", "-") + "</table>"
    found = P.spells(P.page_items(spark.createDataFrame([(1, page)], "id int, html string"), "id", "html", ["td"]), "id")
    assert {tuple(r) for r in found.collect()} == {(1, "23/24", "knee injury", 31.0, 5.0), (1, "21/22", "cold", 1.0, 0.0)}


def escaped(text, all_of=True):
    return "".join(f"\\x{ord(c):02X}" if ord(c) < 256 and (all_of or not c.isalnum()) else c for c in text)


def test_embedded_json(spark):
    data = [{"id": "1", "t": "N'Golo \"K\" \\ é\tx 日本"}, {"id": "2", "t": "a') b"}]
    text = json.dumps(data, ensure_ascii=False)
    shape = "array<struct<id: string, t: string>>"
    quoted = text.replace("\\", "\\\\").replace("'", "\\'")
    pages = [f"<script>var d = JSON.parse('{x}');</script>" for x in (escaped(text), escaped(text, False), quoted)]
    pages += [f"<script>var d = JSON.parse('{escaped(json.dumps([{'id': str(k), 't': 'x' * 40} for k in range(3000)]))}')</script>"]
    broken = [pages[0].replace("\\x7D", "", 1), "<script>var d = JSON.parse('\\x5B')", "<script>var e = JSON.parse('[]')</script>", "var d = JSON.parse('[", None, "", "var d = JSON.parse('\\q')"]
    df = spark.createDataFrame([(k, p) for k, p in enumerate([*pages, *broken])], "k int, html string").withColumn("found", P.embedded_json(F.col("html"), "d", shape))
    got = {r.k: r.found for r in df.collect()}
    for k in range(3):
        assert [(r.id, r.t) for r in got[k]] == [(x["id"], x["t"]) for x in data]
    assert len(got[3]) == 3000
    assert all(not any(r.id for r in got[k] or []) for k in range(4, 4 + len(broken)))


def test_character_references(spark):
    texts = {"N&#039;Golo": "N'Golo", "&#x1F600;&amp;lt;": "😀&lt;", "&#38;lt; &eacute; &#99999999; &#xD800;": "&lt; &eacute; &#99999999; &#xD800;", "a&nbsp;b &quot;": 'a b "', "": ""}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("u", P.unescaped(F.col("t")))
    assert [r.u for r in df.orderBy("k").collect()] == list(texts.values())


def plain_resolution(left, right, overrides):
    taken, claimed = {}, set()

    def take(s, rule, c):
        taken[s] = (c, rule)
        claimed.add(c)

    left = sorted(left)
    for s, name, club in left:
        codes = [c for c, n, k in right if name and n == name and k == club]
        if codes:
            take(s, "exact", max(codes))
    for s, name, club in left:
        codes = {c for c, n, _ in right if name and n == name}
        if s not in taken and len(codes) == 1:
            take(s, "cross_club", codes.pop())
    kin = lambda a, b: a.startswith(b) or b.startswith(a)
    rules = {"token_subset": lambda a, b: set(a) <= set(b) or set(b) <= set(a), "surname_club": lambda a, b: bool(set(a) & set(b)) and kin(a[0], b[0])}
    for rule, test in rules.items():
        for s, name, club in left:
            if s in taken or not name or club is None:
                continue
            hits = {c for c, n, k in right if c not in claimed and k == club and n and test(name.split(), n.split())}
            if len(hits) == 1:
                take(s, rule, hits.pop())
    for s, _, _ in left:
        if s not in taken and s in overrides:
            taken[s] = (overrides[s], "override")
    return taken


def test_names_resolve_as_a_plain_sweep_does(spark):
    rng = random.Random(6)
    first, last = ["ben", "benjamin", "joe", "joseph", "al", "alex", "gabriel"], ["silva", "white", "gomez", "souza", "costa"]
    name = lambda: " ".join([rng.choice(first), *rng.sample(last, rng.randint(0, 2))])
    for _ in range(3):
        left = [(k, rng.choice([name(), name(), None, ""]), rng.choice("xyz")) for k in range(60)] + [(99, name(), None)]
        right = [(100 + k % 45, name(), rng.choice("xyz")) for k in range(45)]
        overrides = {k: 500 + k for k in range(0, 60, 4)}
        got = resolution.resolve_clubs(spark.createDataFrame(left, "source_id long, name string, club string"), spark.createDataFrame(right, "code long, name string, club string"), spark.createDataFrame(list(overrides.items()), "source_id long, code long"))
        assert {r.source_id: (r.code, r.rule) for r in got.collect()} == plain_resolution(left, right, overrides)


def test_copies_of_names_make_no_pairs(spark):
    left = spark.range(300).selectExpr("id source_id", "'ben silva' name", "'x' club").union(spark.createDataFrame([(900, "al costa", "x"), (901, "joe", "y"), (902, "joe", "y")], "source_id long, name string, club string"))
    right = spark.range(300).selectExpr("id + 1000 code", "'ben a silva' name", "'x' club").union(spark.createDataFrame([(5, "al b costa", "x"), (6, "joe white", "y"), (7, "joe white", "y"), (7, "joe gomez", "z")], "code long, name string, club string"))
    for hits in (resolution.subset_hits, resolution.kin_hits):
        found = resolution.open_hits(left, right, hits)
        assert {tuple(r) for r in found.collect()} == {(900, 5), (901, 6), (902, 6), (901, 7), (902, 7)}  # not 90,000 more, of which none is claimed
    assert "Broadcast" not in resolution.subset_hits(left, right)._jdf.queryExecution().executedPlan().toString()


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(20_000).selectExpr("id", "case when id % 3 = 0 then 'hot' else concat('g', id % 40) end g")
    out = sampling.sample(df, ["g"], ["id"], 25, 3)
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2  # before the shuffle and after it
    one, two = (sorted(map(tuple, sampling.sample(df.repartition(n), ["g"], ["id"], 25, 3).collect())) for n in (3, 11))
    assert one == two and all(sum(g == x for _, x in one) == 25 for g in ("hot", "g1"))
    assert sampling.sample(df.where("false"), ["g"], ["id"], 25, 3).count() == 0
    slots = [tuple(r) for r in sampling.sampled_slots(df.select("id"), ["id"], "id", 100, 5, 50).collect()]
    assert len(set(slots)) == 100 and all((p - 1) * 50 + s == i for p, s, i in slots)


def test_items_of_small_pages_share_a_batch():
    pages = pa.record_batch([pa.array(range(900)), pa.array(["<ul><li>a<li>b</ul>"] * 450 + [None] * 449 + ["<li>c" * 6000])], names=["key", "page"])
    got = list(P.item_batches([pages], ["li"], {}))
    assert [b.num_rows for b in got] == [5000, 1900] and [got[0].column(0)[k].as_py() for k in (0, 1, 2, 900)] == [0, 0, 1, 899]


def test_text_without_references_stays_and_numbers_are_strict(spark):
    texts = {"a\x01b": "a\x01b", "&#12ab; &#65 ; &#0000065; &#x0; &#X41; &": "&#12ab; &#65 ; &#0000065; &#x0; &#X41; &", "&#65;&#x42;&#233;&#x1F600;&amp;lt;": "ABé\U0001f600&lt;"}
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("u", P.unescaped(F.col("t")))
    assert {r.t: r.u for r in df.collect()} == texts


def test_scripts_with_escaped_backslashes_and_many_records(spark):
    escaped = lambda s: s.replace("\\", "\\\\").replace("'", "\\'").replace('"', r"\x22")
    rows = [[{"t": r"C:\\xyz it's"}], [{"t": r"a \"b\" \\ c"}], [{"t": "é" * 50}] * 3000]
    pages = ["<script>var d = JSON.parse('" + escaped("[" + ",".join('{"t":"' + x["t"] + '"}' for x in r) + "]") + "');</script>" for r in rows]
    df = spark.createDataFrame(list(enumerate(pages)), "k int, html string").withColumn("m", P.embedded_json(F.col("html"), "d", "array<struct<t: string>>"))
    got = {r.k: [x.t for x in r.m] for r in df.collect()}
    assert got == {0: [r"C:\xyz it's"], 1: ['a "b" \\ c'], 2: ["é" * 50] * 3000}


def plain_row(*cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


def test_plain_rows_are_read_at_once():
    page = f"<div class='x'><table>{plain_row('a', '<b>b</b> &eacute;')}\n{plain_row('c')}<tr><td class='y'>d</td></tr>{plain_row() * 2500}</table></div>"
    kinds = [k for k, _, _ in P.tokens(page, lambda: True)]
    assert kinds.count("rows") == 4 and len(kinds) == 4 + 4 + 5  # tags around, and the row with an attribute
    assert [(n, within, text) for n, _, _, within, _, _, _, text in P.items(page, ["td"], {})] == [(0, "x", "a"), (1, "x", "b é"), (2, "x", "c"), (3, "x", "d")]
    assert list(P.cells(page)) == ["a", "b é", "c", "d"]


def test_plain_rows_read_as_the_fold_reads_them(monkeypatch):
    rng = random.Random(4)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<td class='y'>", " &lt; x", "<b>", "</b>", "<h2>", "</h2>", "<li>", "</li>", "<p>", "<ul>", "<a href=v>", "</a>", "<br>", "<!-- c -->", "< 5"]
    row = lambda: plain_row(*rng.choices(["", "a  b", "x&nbsp;", "<b>T</b> é", "1<i> 2</i>3<em></em>"], k=rng.randint(0, 3)))
    pages = ["".join(row() if rng.random() < 0.5 else rng.choice(bits) for _ in range(rng.randint(1, 16)))[: rng.choice([None, 60])] for _ in range(1500)]
    pages += ["<table>" + p for p in pages]
    cases = [(["td"], {}), (["li", "td", "p"], LEVELS), (["td", "tr"], {}), (["td", "b"], {"h2": 2}), (["td"], {"td": 3}), (["td"], {"b": 1}), (["td"], {".y": 1})]
    read_all = lambda: [[list(P.items(p, *case)) for case in cases] + [list(P.cells(p))] for p in pages]
    fast = read_all()
    monkeypatch.setattr(P, "ROWS", P.re.compile("(?!)"))
    assert fast == read_all()


def test_spells_of_pages_are_those_of_their_cells_without_a_shuffle(spark):
    row = plain_row
    good = row("23/24", "Knee&nbsp;<i>Injury</i>", "a", "b", "31 days", "5 of 6") + row("22/23", "Flu", "a", "b", "?", "1") + row("21/22", "Cold", "a", "b", "1 day", "-") + row("", "", "", "", "007days", "")
    head = row("Season", "Injury", "a", "b", "9 days", "g")
    pages = [f"<table>{head}{good}</table>", f"<h1>x</h1><table class='t'><tbody>{good}</tbody></table>", good.replace("<td>", "<td class='c'>"), f"<li>{good}</li>", f"<table>{good}</b>{good}", f"<table>{good}<tr><td>20/21<td>Cut<td>a<td>b<td>8 days", f"<table>{good}<tr><td>19/20<td>Cut", "none", "", None, f"<table>{good * 900}</table>"]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    found, cells = P.page_spells(df, "id", "html"), P.spells(P.page_items(df, "id", "html", ["td"]), "id")
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert found.schema.simpleString() == cells.schema.simpleString() and rows(found) == rows(cells)
    assert (0, "23/24", "knee injury", 31.0, 56.0) in rows(found) and (5, "20/21", "cut", 8.0, 0.0) in rows(found) and len(rows(found)) == 3 * 907 + 1
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_injury_spells_shuffle_only_lines(spark, sf):
    plan = plans.queries()["injury_spells"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == plan.count("Exchange ") == 1
