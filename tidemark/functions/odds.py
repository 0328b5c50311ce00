"""Probabilities from prices and means, by bisection, Newton steps and small grids inside array functions: no Python workers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import normal_cdf, normal_pdf

#: Shin's z is sought below MOST_Z; scores go up to GOALS; means on a grid from 0.20 by 0.05 to 4.00.
MOST_Z, GOALS = 0.4, 10
MEANS = tuple(round(0.2 + 0.05 * i, 2) for i in range(77))
#: Band of a normal's middle half, haul and blank lines, and what an expected point adds to the variance of outcomes.
BAND_Z, HAUL, BLANK = 0.6744897501960817, 10.0, 2.0


def _once(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x) with x worked out once, also where x is used in steps over arrays."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def shin_probabilities(implied: Column) -> Column:
    """Array of 1 / price to probabilities by Shin's model; without an overround or with one price, each one's share.

    The book, and what a step has of z alone, are worked out once and not for each price.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def solved(book: Column) -> Column:
        at = lambda z: F.struct(z.alias("z"), (z * z).alias("zz"), (4 * (1 - z)).alias("four"), (2 * (1 - z)).alias("two"))
        root = lambda x, s: (F.sqrt(s["zz"] + s["four"] * x * x / book) - s["z"]) / s["two"]

        def halve(state: Column, _: Column) -> Column:
            def half(s: Column) -> Column:
                above = F.aggregate(implied, F.lit(0.0), lambda a, x: a + root(x, s)) > 1
                return F.when(above, F.struct(s["z"].alias("lo"), state["hi"].alias("hi"))).otherwise(F.struct(state["lo"].alias("lo"), s["z"].alias("hi")))

            return _once(at((state["lo"] + state["hi"]) / 2), half)

        start = F.struct(F.lit(0.0).alias("lo"), F.lit(MOST_Z).alias("hi"))
        z = F.aggregate(F.sequence(F.lit(1), F.lit(50)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
        chances = _once(_once(z, at), lambda s: F.transform(implied, lambda x: root(x, s)))
        return _once(chances, lambda c: _once(total(c), lambda all_: F.transform(c, lambda p: p / all_)))

    return _once(total(implied), lambda book: F.when((F.size(implied) < 2) | (book <= 1), F.transform(implied, lambda x: x / book)).otherwise(solved(book)))


def scoring_rate(price: Column) -> Column:
    """Mean of a Poisson count whose chance of one or more is 1 / price."""
    return -F.ln(1 - F.least(F.greatest(1 / price, F.lit(1e-9)), F.lit(1 - 1e-9)))


def win_probability(mean_for: Column, mean_against: Column, most: int = GOALS) -> Column:
    """That one Poisson count exceeds another, counts up to `most`."""
    x, y = F.greatest(mean_for, F.lit(1e-9)), F.greatest(mean_against, F.lit(1e-9))
    state = F.struct(F.exp(-x).alias("own"), F.lit(0.0).alias("under"), F.exp(-y).alias("other"), F.lit(0.0).alias("won"))

    def step(s: Column, k: Column) -> Column:
        own, under = s["own"] * x / k, s["under"] + s["other"]
        return F.struct(own.alias("own"), under.alias("under"), (s["other"] * y / k).alias("other"), (s["won"] + own * under).alias("won"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, step, lambda s: s["won"])


def recentred_mean(ep: Column, sigma: Column, steps: int = 40) -> Column:
    """The mean of a normal of which the part above 0 has the mean ep, by Newton steps; ep itself where ep or sigma isn't above 0."""

    def step(mu: Column, _: Column) -> Column:
        cdf = normal_cdf(mu / sigma)
        gap = mu * cdf + sigma * normal_pdf(mu / sigma) - ep
        return F.when(F.abs(gap) <= 1e-9, mu).when(cdf <= 1e-12, mu + sigma).otherwise(mu - gap / cdf)

    return F.when((sigma > 0) & (ep > 0), F.aggregate(F.sequence(F.lit(1), F.lit(steps)), ep, step)).otherwise(ep)


def points_band(ep: Column, sigma: Column) -> Column:
    """Struct of the middle half and the chances of a haul and of a blank, of outcomes clipped at 0 with mean ep; all is certain where sigma or ep isn't above 0."""
    # bound once as an array of one, so that the steps aren't repeated for each field
    mu = recentred_mean(ep, sigma)

    def fields(m: Column) -> Column:
        spread = (sigma > 0) & (ep > 0)
        low = F.when(spread, F.greatest(F.lit(0.0), m - BAND_Z * sigma)).otherwise(F.greatest(m, F.lit(0.0)))
        high = F.when(spread, m + BAND_Z * sigma).otherwise(F.greatest(m, F.lit(0.0)))
        haul = F.when(spread, 1 - normal_cdf((HAUL - m) / sigma)).otherwise((m >= HAUL).cast("double"))
        blank = F.when(spread, normal_cdf((BLANK - m) / sigma)).otherwise((m <= BLANK).cast("double"))
        return F.struct(low.alias("ep_lo"), high.alias("ep_hi"), haul.alias("p_haul"), blank.alias("p_blank"))

    return F.transform(F.array(mu), fields)[0]


def mean_grid(spark):
    """A row for each pair of means of the grid: the chances of a win, a draw and three goals or more, in the order of the search."""
    pmf = lambda m: F.transform(F.sequence(F.lit(0), F.lit(GOALS)), lambda k: F.exp(-m) * F.pow(m, k) / F.factorial(k))
    n = len(MEANS)
    grid = spark.range(n * n).select("id", (0.2 + 0.05 * F.floor(F.col("id") / n)).alias("m"), (0.2 + 0.05 * (F.col("id") % n)).alias("a"))
    cells = grid.select("*", F.posexplode(pmf(F.col("m"))).alias("h", "ph")).select("*", F.posexplode(pmf(F.col("a"))).alias("g", "pg"))
    p = F.col("ph") * F.col("pg")
    sums = [F.sum(F.when(c, p).otherwise(0)).alias(n) for c, n in ((F.col("h") > F.col("g"), "win"), (F.col("h") == F.col("g"), "draw"), (F.col("h") + F.col("g") >= 3, "over"))]
    return cells.groupBy("id", F.round("m", 2).alias("mean_home"), F.round("a", 2).alias("mean_away")).agg(*sums)


def inverted(odds, keys, grid):
    """Rows of odds (keys, home, draw, over) with the first pair of means of the grid that fits them best.

    The grid has a fixed size and is broadcast; each distinct triple of chances meets it once and only its best pair is kept.
    """
    packed = grid.agg(F.array_sort(F.collect_list(F.struct("id", "win", "draw", "over", "mean_home", "mean_away"))).alias("grid"))
    start = F.struct(F.lit(math.inf).alias("least"), F.lit(None).cast("double").alias("mean_home"), F.lit(None).cast("double").alias("mean_away"))

    def better(s: Column, g: Column) -> Column:
        err = F.pow(g["win"] - F.col("home"), 2) + F.pow(g["draw"] - F.col("draw"), 2) + 0.5 * F.pow(g["over"] - F.col("over"), 2)
        return F.when(err < s["least"], F.struct(err.alias("least"), g["mean_home"].alias("mean_home"), g["mean_away"].alias("mean_away"))).otherwise(s)

    triples = odds.select("home", "draw", "over").distinct().join(F.broadcast(packed))  # one row
    best = triples.select("home", "draw", "over", F.aggregate("grid", start, better).alias("best")).select("home", "draw", "over", "best.mean_home", "best.mean_away")
    return odds.join(best, ["home", "draw", "over"]).select(*keys, "mean_home", "mean_away")
