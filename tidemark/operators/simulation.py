"""Simulation by keyed draws: a draw depends on its keys alone, so results don't depend on partitions, and any executor can make it again."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hash_uniform
from .ordered import dealt, shuffled


def hash_normal(*keys) -> Column:
    """A standard normal number, by the formula of Box and Muller on two uniform ones of the keys."""
    u, v = hash_uniform(*keys, "u"), hash_uniform(*keys, "v")
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * v)


def drawn(df: DataFrame, mean: Column, sigma: Column, keys: Sequence[str], draws: int) -> DataFrame:
    """df once a draw (column draw), with its value; the mean itself where there is no spread. Deal df before: a small file is few tasks, however many draws come of it."""
    rows = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return rows.withColumn("value", mean + F.coalesce(sigma, F.lit(0.0)) * hash_normal(*[F.col(k) for k in keys], F.col("draw")))


def league(entries: DataFrame, by: str, entry: str, mean: str, sigma: str, exposure: str, draws: int = 200) -> DataFrame:
    """(by, entry, p_win, p_top3, finish): shares of draws in which an entry ends first, or in the first three, and its mean place.

    In a draw all entries of a league share one normal number in proportion to their exposure, the rest is their own.
    Leagues are small; a league and draw meet in one group of as many rows as it has entries.
    """
    spread = entries.repartition(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)  # draws stay where their league is
    rows = spread.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    shared, own = hash_normal(F.col(by), F.col("draw")), hash_normal(F.col(by), F.col(entry), F.col("draw"))
    noise = F.col(exposure) * shared + F.sqrt(1 - F.col(exposure) * F.col(exposure)) * own
    totals = rows.withColumn("total", F.col(mean) + F.col(sigma) * noise)
    placed = totals.withColumn("place", F.row_number().over(Window.partitionBy(by, "draw").orderBy(F.desc("total"), entry)))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return placed.groupBy(by, entry).agg(share(F.col("place") == 1).alias("p_win"), share(F.col("place") <= 3).alias("p_top3"), F.avg("place").alias("finish"))


def field_rank(entries: DataFrame, by: str, element: str, mean: str, sigma: str, owned: str, mine: str, draws: int, managers: int) -> DataFrame:
    """(by, p_green, median, own): how often my elements (mine: multiplier) beat the median manager of a field that owns each element with its chance.

    One draw of an element serves me and all managers, so what they share they share. Points are counted in
    whole thousandths, so that sums don't depend on their order. Rows are draws an element, summed on the map
    side into a column a manager; a group and draw are one row of as many totals as there are managers.
    """
    owns = F.transform(F.sequence(F.lit(0), F.lit(managers - 1)), lambda m: hash_uniform(F.col(by), F.col(element), m, "owns") < F.col(owned))
    rows = drawn(dealt(entries, [by, element]).withColumn("_owns", owns), F.col(mean), F.col(sigma), [by, element], draws).withColumn("_v", F.floor(F.col("value") * 1000).cast("bigint"))
    totals = [F.sum(F.when(F.get("_owns", F.lit(m)), F.col("_v")).otherwise(0)).alias(f"_t{m}") for m in range(managers)]
    weeks = rows.groupBy(by, "draw").agg(*totals, F.sum(F.col("_v") * F.col(mine)).alias("_own"))
    known = F.array_sort(F.array_compact(F.array(*[f"_t{m}" for m in range(managers)])))
    at = lambda half: F.get("_known", F.floor((F.size("_known") - 1) / 2.0 + half).cast("int"))
    weeks = weeks.select(by, "_own", known.alias("_known")).select(by, "_own", (at(0.0) * 0.5 + at(0.5) * 0.5).alias("_median"))
    return weeks.groupBy(by).agg(F.avg(F.when(F.col("_own") > F.col("_median"), 1.0).otherwise(0.0)).alias("p_green"), (F.avg("_median") / 1000).alias("median"), (F.avg("_own") / 1000).alias("own"))


def lane_gains(entries: DataFrame, by: str, entry: str, mine: Column, mean: str, sigma: str, lanes: dict[str, Column], draws: int) -> DataFrame:
    """(by, lane, gain): what my chance to end first, in points of a hundred, has over that with a lane's mean in place of mine, on the same draws.

    The best rival of a draw is a map-side maximum, so a group's size doesn't matter. Groups without rivals or without an entry of mine have no row.
    """
    rows = drawn(dealt(entries, [by, entry]), F.lit(0.0), F.lit(1.0), [by, entry], draws)
    best = rows.where(~mine).groupBy(by, "draw").agg(F.max(F.col(mean) + F.col(sigma) * F.col("value")).alias("_best"))
    told = F.array(*[F.struct(F.lit(n).alias("lane"), c.cast("double").alias("_mean")) for n, c in lanes.items()])
    own = rows.where(mine).withColumn("_lane", F.explode(told)).select(by, entry, "draw", "_lane.lane", F.col(mean).alias("_is"), "_lane._mean", (F.col(sigma) * F.col("value")).alias("_noise"))
    wins = lambda m: F.avg(F.when(F.col(m) + F.col("_noise") > F.col("_best"), 1.0).otherwise(0.0))
    return own.join(shuffled(best), [by, "draw"]).groupBy(by, "lane").agg(((wins("_is") - wins("_mean")) * 100).alias("gain"))
