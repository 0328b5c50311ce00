"""Bands, squads, stored tables and drifting sources against plain versions."""

import math
import re
import random
import unicodedata
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import normalised_name, odds, rules, table_cells
from tidemark.operators import ordered, reports, squads
from tidemark.sources import contracts, stores

BOUNDS = rules.XI_BOUNDS


def cdf(z):
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def test_normal_cdf(spark):
    rows = spark.range(-500, 501).select((F.col("id") / 100).alias("z")).select("z", rules.normal_cdf(F.col("z")).alias("p")).collect()
    assert max(abs(r.p - cdf(r.z)) for r in rows) < 1e-7


def test_recentred_mean_gives_back_the_mean(spark):
    rows = [(ep, s) for ep in (-1.0, 0.0, 0.05, 0.5, 2.0, 9.0) for s in (0.0, 0.3, 1.0, 4.0)]
    df = spark.createDataFrame(rows, "ep double, sigma double")
    for r in df.select("ep", "sigma", odds.recentred_mean(F.col("ep"), F.col("sigma")).alias("mu"), odds.points_band(F.col("ep"), F.col("sigma")).alias("b")).collect():
        if r.ep <= 0 or r.sigma <= 0:
            assert r.mu == r.ep and r.b.ep_lo == r.b.ep_hi == max(0, r.ep) and r.b.p_blank == float(r.ep <= 2)
        else:
            z = r.mu / r.sigma
            assert r.mu * cdf(z) + r.sigma * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) == pytest.approx(r.ep, abs=2e-6)
            assert r.b.p_haul == pytest.approx(1 - cdf((10 - r.mu) / r.sigma), abs=1e-6) and r.b.p_blank == pytest.approx(cdf((2 - r.mu) / r.sigma), abs=1e-6)
            assert cdf((r.b.ep_hi - r.mu) / r.sigma) == pytest.approx(0.75) and r.b.ep_lo == pytest.approx(max(0, 2 * r.mu - r.b.ep_hi))


def test_shin_sums_to_one_and_favours_favourites(spark):
    df = spark.createDataFrame([([1 / 1.5, 1 / 4.0, 1 / 8.0],), ([0.5, 0.5],), ([0.4, 0.3],), ([0.9],)], "x array<double>")
    got = [r.p for r in df.select(odds.shin_probabilities(F.col("x")).alias("p")).collect()]
    assert all(sum(p) == pytest.approx(1) for p in got)
    assert got[0][0] > (1 / 1.5) / (1 / 1.5 + 1 / 4 + 1 / 8) and got[2] == pytest.approx([4 / 7, 3 / 7]) and got[3] == [1.0]


def legal(kinds):
    count = Counter(kinds)
    return len(kinds) == 11 and all(low <= count.get(k, 0) <= high for k, (low, high) in BOUNDS.items())


def squad_rows(rng, squad):
    kinds = ["GKP"] * 2 + ["DEF"] * 5 + ["MID"] * 5 + ["FWD"] * 3
    starters = [0, 2, 3, 4, 5, 7, 8, 9, 10, 12, 13]
    bench = rng.sample([i for i in range(15) if i not in starters], 4)
    return [(squad, p + 1, kinds[i], rng.random() < 0.6, rng.randint(-2, 14)) for p, i in enumerate(starters + bench)]


def test_best_eleven_against_all_combinations(spark):
    rng = random.Random(4)
    rows = [r for s in range(12) for r in squad_rows(rng, s)] + [(99, p, "MID", True, 5) for p in range(1, 16)]
    got = {r.squad: (r.total, r.captain) for r in squads.best_eleven(spark.createDataFrame(rows, "squad int, place int, kind string, played boolean, points int"), "squad", "kind", "points").collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    want = {}
    for s, members in by.items():
        options = [sum(r[4] for r in c) + max(r[4] for r in c) for c in combinations(members, 11) if legal([r[2] for r in c])]
        if options:
            want[s] = max(options)
    assert {s: t for s, (t, _) in got.items()} == want


def test_substitutions_against_a_loop(spark):
    rng = random.Random(5)
    rows = [r for s in range(60) for r in squad_rows(rng, s)]
    got = {r.squad: (r.n_subs, list(r.ins), r.points) for r in squads.substituted(spark.createDataFrame(rows, "squad int, place int, kind string, played boolean, points int"), "squad", "place", "kind", "played", "points").collect()}
    for s in range(60):
        members = {r[1]: r for r in rows if r[0] == s}
        eleven, ins = list(range(1, 12)), []
        for k in range(11):
            if members[eleven[k]][3]:
                continue
            for sub in range(12, 16):
                trial = [*eleven[:k], sub, *eleven[k + 1 :]]
                if sub not in ins and members[sub][3] and legal([members[p][2] for p in trial]):
                    eleven, ins = trial, [*ins, sub]
                    break
        assert got[s] == (len(ins), ins, sum(members[p][4] for p in eleven))


def test_store_keeps_whole_versions(spark, tmp_path):
    store = stores.Store(spark, f"file://{tmp_path}/store", keep=2)
    assert not store.exists("t")
    with pytest.raises(FileNotFoundError):
        store.load("t")
    names = [store.save(spark.range(n), "t") for n in (1, 2, 3)]
    assert store.load("t").count() == 3 and store.versions("t") == names[1:] and store.load("t", names[1]).count() == 2
    with pytest.raises(Exception, match="boom"):
        store.save(spark.range(5).select(F.assert_true(F.col("id") < 3, F.lit("boom")).alias("x")), "t")
    assert store.load("t").count() == 3


def test_csv_files_that_drift(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,minutes,extra\n1,90.0,x\n,5,y\nbad,7,z\n")
    (tmp_path / "in" / "b.csv").write_text("mins,id,done\n 45 ,2,TRUE\nnone,3,maybe\n")
    got = contracts.read_csv(spark, f"file://{tmp_path}/in/*.csv", {"id": "bigint", "minutes": "int", "done": "boolean"}, aliases={"minutes": ["mins"]}, required=["id"])
    assert {tuple(r) for r in got.collect()} == {(1, 90, None), (2, 45, True), (3, None, None)} and got.dtypes == [("id", "bigint"), ("minutes", "int"), ("done", "boolean")]


def test_orders_by_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice("aab"), rng.randint(0, 40), i, rng.choice([None, rng.randint(0, 9)])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v int").repartition(7)
    got = {r.i: r.n for r in ordered.ranked(df, ["k"], [F.col("t"), F.col("i")], "n").collect()}
    for k in "ab":
        assert [got[r[2]] for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3])] == list(range(1, sum(r[0] == k for r in rows) + 1))
    for forward in (False, True):
        for own in (False, True):
            found = {r.i: r.w for r in ordered.filled(df, ["k"], [F.col("t"), F.col("i")], {"w": F.col("v")}, forward, own).collect()}
            for k in "ab":
                seen = None
                for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3], reverse=forward):
                    before, seen = seen, r[3] if r[3] is not None else seen
                    assert found[r[2]] == (seen if own else before)
    values = sorted(r[3] for r in rows if r[3] is not None)
    p = ordered.percentiles(df, "v", [0.05, 0.5, 0.95]).first()
    at = lambda s: (x := (len(values) - 1) * s, values[int(x)] + (x - int(x)) * (values[min(int(x) + 1, len(values) - 1)] - values[int(x)]))[1]
    assert list(p) == pytest.approx([at(0.05), at(0.5), at(0.95)])


def test_late_rows_and_projection(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 3, 10), ("b", 12, 10)], "k string, t int, due int")
    assert {tuple(r) for r in reports.latest_before(df, "k", "t", [], F.col("due")).collect()} == {("a", 3, 10, False), ("b", 12, 10, True)}
    series = spark.createDataFrame([("a", 1, 10), ("a", 3, 20), ("a", 9, 99), ("b", 1, 5)], "k string, t int, v int")
    assert [tuple(r) for r in reports.projected(series, "k", "t", "v", F.lit(5)).collect()] == [("a", 2, 5.0, 30.0)]


def test_names_and_cells(spark):
    names = ["Łukasz Fabiański", "Ødegaard", "João Félix", "N'Golo Kanté", "Čech-Šesko", "Müller", "Ștefan", "Nguyễn", "Åke", "D’Alè"]
    got = [r.n for r in spark.createDataFrame([(i, x) for i, x in enumerate(names)], "i int, x string").orderBy("i").select(normalised_name("x").alias("n")).collect()]
    plain = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x.lower()) if not unicodedata.combining(c))
    assert got == [" ".join(re.sub("[^a-z0-9]+", " ", re.sub("['’]", "", plain(x))).split()) for x in names]
    html = "<table><!-- <tr><td>no</td></tr> --><tr><th>Player</th><th>Status</th></tr>\n<TR class='x'><td><a href='/p'>Saka</a>  B.</td><td>75%\n fit</td></TR><tr></tr></table>"
    cells = spark.createDataFrame([(html,), ("",), (None,)], "h string").select(table_cells(F.col("h")).alias("c")).collect()
    assert [r.c for r in cells] == [[["Player", "Status"], ["Saka B.", "75% fit"], []], [], None]
