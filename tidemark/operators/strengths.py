"""Attack and defence strengths of teams from scores, fitted jointly with the correction of low scores, and refitted at each cut-off from running sums.

Goals are two Poisson counts with means exp(attack + opponent's defence + edge at home), times the correction of Dixon and Coles for 0-0, 1-0,
0-1 and 1-1. All that the likelihood needs of the matches of one pair of teams are weighted sums: matches, goals of either side, and how many ended in
each low score. A match weighs exp(decay x day), which is, up to a factor that no fit feels, what weights that fall from the
newest day give. So sums of slots add up, and a refit at a cut-off reads the pairs' sums before it, not the matches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much a day's age takes off a match's weight, bounds of log strengths, of the edge and of the correction, and the weakest teams that unknown ones are like.
DECAY, MOST, EDGES, RHO_BOUND, WEAKEST = 0.0065, 3.0, (-1.0, 1.5), 0.4, 3
SUMS = ("w", "hg", "ag", "w00", "w01", "w10", "w11", "hp", "ap")


def pair_sums(matches: DataFrame, by: Sequence[str], home: str, away: str, home_goals: str, away_goals: str, day: str, decay: float = DECAY) -> DataFrame:
    """(by, h, a, and SUMS): of each pair's matches the sum of weights, weighted goals, weights of low scores, and the points won. Matches with a null count for nothing."""
    rows = matches.select(*by, F.col(home).cast("string").alias("h"), F.col(away).cast("string").alias("a"), F.col(home_goals).cast("double").alias("x"), F.col(away_goals).cast("double").alias("y"), F.to_date(day).alias("day"))
    rows = rows.dropna(subset=["h", "a", "x", "y", "day"])
    w = F.exp(decay * F.datediff("day", F.lit("2000-01-01").cast("date")))
    low = lambda i, j: F.sum(F.when((F.col("x") == i) & (F.col("y") == j), w).otherwise(0.0))
    points = lambda a, b: F.sum(F.when(a > b, 3.0).when(a == b, 1.0).otherwise(0.0))
    x, y = F.col("x"), F.col("y")
    sums = (F.sum(w), F.sum(w * x), F.sum(w * y), low(0, 0), low(0, 1), low(1, 0), low(1, 1), points(x, y), points(y, x))
    return rows.groupBy(*by, "h", "a").agg(*[s.alias(n) for s, n in zip(sums, SUMS, strict=True)])


def fitted(h: np.ndarray, a: np.ndarray, sums: dict[str, np.ndarray], n: int, rounds: int = 2000, close: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(attack, defence, edge, rho) that make the scores of pairs likeliest, teams by number; attacks have mean 0.

    Each part in turn is set to where its own derivative is 0 given the others: a strength in closed form, but for the low-score terms, which are those of the round before;
    rho by a Newton step. A round takes time in the number of pairs.
    """
    w = sums["w"] / sums["w"].sum()
    s = {k: v / sums["w"].sum() for k, v in sums.items()}
    add = lambda at, x: np.bincount(at, x, n)
    alpha, delta, gamma, rho = np.ones(n), np.ones(n), 1.0, 0.0
    goals_for, goals_against = add(h, s["hg"]) + add(a, s["ag"]), add(a, s["hg"]) + add(h, s["ag"])
    bound = lambda x: np.clip(np.nan_to_num(x, nan=1.0, posinf=np.exp(MOST)), np.exp(-MOST), np.exp(MOST))

    def means() -> tuple[np.ndarray, np.ndarray]:
        return alpha[h] * delta[a] * gamma, alpha[a] * delta[h]

    def low() -> tuple[np.ndarray, np.ndarray]:
        """What the low scores add to the derivatives by the logarithms of both means."""
        lam, mu = means()
        both, left, right = s["w00"] * -lam * mu * rho / (1 - lam * mu * rho), s["w01"] * lam * rho / (1 + lam * rho), s["w10"] * mu * rho / (1 + mu * rho)
        return both + left, both + right

    for _ in range(rounds):
        old = np.concatenate([np.log(alpha), np.log(delta), [np.log(gamma), rho]])
        x, y = low()
        alpha = bound((goals_for + add(h, x) + add(a, y)) / (add(h, w * delta[a] * gamma) + add(a, w * delta[h])))
        x, y = low()
        delta = bound((goals_against + add(a, x) + add(h, y)) / (add(a, w * alpha[h] * gamma) + add(h, w * alpha[a])))
        x, _y = low()
        at_home = (w * alpha[h] * delta[a]).sum()
        gamma = float(np.clip((s["hg"].sum() + x.sum()) / at_home, *np.exp(EDGES)))
        lam, mu = means()
        first, second = 0.0, 0.0
        for weight, t in ((s["w00"], -lam * mu), (s["w01"], lam), (s["w10"], mu), (s["w11"], -np.ones(len(lam)))):
            slope = t / (1 + rho * t)
            first, second = first + (weight * slope).sum(), second + (weight * slope**2).sum()
        # inside the bounds every correction stays above 0
        tops = [np.max(v, initial=0.0, where=k > 0) for v, k in ((lam * mu, s["w00"]), (lam, s["w01"]), (mu, s["w10"]), (np.ones(len(lam)), s["w11"]))]
        most, least = min(RHO_BOUND, 0.95 / max(tops[0], tops[3], 1e-9)), max(-RHO_BOUND, -0.95 / max(tops[1], tops[2], 1e-9))
        rho = float(np.clip(rho + (first / second if second > 0 else 0.0), least, most))
        shift = np.log(alpha).mean()
        alpha, delta = alpha / np.exp(shift), delta * np.exp(shift)
        if np.abs(np.concatenate([np.log(alpha), np.log(delta), [np.log(gamma), rho]]) - old).max() < close:
            break
    return np.log(alpha), np.log(delta), float(np.log(gamma)), rho


def strengths(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, team, attack, defence, edge, rho, weak): a fit a group of pair sums; `weak` marks the WEAKEST teams of fewest points, then of least name.

    A group is one task of a row a pair of teams that have met, however many matches they had; groups (leagues, cut-offs) run side by side.
    """

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        teams = sorted(set(part["h"]) | set(part["a"]))
        number = {t: k for k, t in enumerate(teams)}
        h, a = part["h"].map(number).to_numpy(), part["a"].map(number).to_numpy()
        attack, defence, edge, rho = fitted(h, a, {c: part[c].to_numpy(float) for c in SUMS}, len(teams))
        points = np.bincount(h, part["hp"], len(teams)) + np.bincount(a, part["ap"], len(teams))
        weak = set(sorted(range(len(teams)), key=lambda k: (points[k], teams[k]))[:WEAKEST])
        out = pd.DataFrame({"team": teams, "attack": attack, "defence": defence, "edge": edge, "rho": rho, "weak": [k in weak for k in range(len(teams))]})
        for c in reversed(by):
            out.insert(0, c, part[c].iloc[0])
        return out

    ordered = [f for f in sums.schema if f.name in by]
    ordered.sort(key=lambda f: list(by).index(f.name))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered)
    return sums.groupBy(*by).applyInPandas(fit, f"{shape}, team string, attack double, defence double, edge double, rho double, weak boolean")


def sums_before(sums: DataFrame, by: Sequence[str], slot: str) -> DataFrame:
    """(by, slot, h, a, SUMS): for each slot of a group but its first, every pair's sums over the slots before it. sums is by (by, slot, h, a).

    Running sums of a pair stand from the slot after a match to its next one, so each row of the history is read once.
    """
    slots = sums.select(*by, slot).distinct()
    line = Window.partitionBy(*by).orderBy(slot)  # a group's slots
    numbered = slots.withColumns({"_n": F.row_number().over(line), "_last": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    pair = Window.partitionBy(*by, "h", "a").orderBy("_n")
    upto = pair.rowsBetween(Window.unboundedPreceding, 0)
    rows = sums.join(numbered, [*by, slot]).withColumns({c: F.sum(c).over(upto) for c in SUMS} | {"_until": F.coalesce(F.lead("_n").over(pair), F.col("_last"))})
    spread = rows.where("_n < _last").withColumn("_at", F.explode(F.sequence(F.col("_n") + 1, F.col("_until"))))
    named = numbered.select(*by, F.col(slot).alias("_slot"), F.col("_n").alias("_at"))
    return spread.drop(slot).join(named, [*by, "_at"]).select(*by, F.col("_slot").alias(slot), "h", "a", *SUMS)


def expected(matches: DataFrame, found: DataFrame, keys: Sequence[str], home: str, away: str) -> DataFrame:
    """matches with lam and mu, both sides' expected goals by the strengths of their keys; an unknown team is like the mean of the weak ones. Null where the keys have no fit."""
    whole = found.groupBy(*keys).agg(F.first("edge").alias("_edge"), *[F.avg(F.when(F.col("weak"), F.col(c))).alias(f"_{c}") for c in ("attack", "defence")])
    side = lambda name, to: found.select(*keys, F.col("team").alias(name), F.col("attack").alias(f"{to}_attack"), F.col("defence").alias(f"{to}_defence"))
    rows = matches.withColumns({"_ht": F.col(home).cast("string"), "_at": F.col(away).cast("string")})
    rows = rows.join(side("_ht", "_h"), [*keys, "_ht"], "left").join(side("_at", "_a"), [*keys, "_at"], "left").join(whole, [*keys], "left")
    of = lambda to, c: F.coalesce(f"{to}_{c}", f"_{c}")
    lam, mu = F.exp(of("_h", "attack") + of("_a", "defence") + F.col("_edge")), F.exp(of("_a", "attack") + of("_h", "defence"))
    return rows.withColumns({"lam": lam, "mu": mu}).select(*matches.columns, "lam", "mu")


def walk_forward(matches: DataFrame, by: Sequence[str], slot: str, home: str, away: str, home_goals: str, away_goals: str, day: str, decay: float = DECAY) -> DataFrame:
    """matches with lam, mu, home_clean and away_clean, by a fit on all matches of their group (`by`) in slots before their own; null in a group's first slot.

    A side keeps the other from scoring with the chance that the other's count is 0, which the correction of low scores leaves as it is.
    """
    before = sums_before(pair_sums(matches, [*by, slot], home, away, home_goals, away_goals, day, decay), by, slot)
    found = expected(matches, strengths(before, [*by, slot]), [*by, slot], home, away)
    return found.withColumns({"home_clean": F.exp(-F.col("mu")), "away_clean": F.exp(-F.col("lam"))})
