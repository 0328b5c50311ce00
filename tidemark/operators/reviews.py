"""Reviews of forecasts and decisions: gated scores, group biases, lead times, grades, walks over rungs, and repairs of what a log says."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import log_loss

#: The least pairs of a calibration and rows of a bias, the first days of the bands of lead times, the least weeks of a tier.
LEAST_PAIRS, LEAST_ROWS = 30, 200
LEAD_BANDS = ((7, "7d+"), (5, "5-7d"), (3, "3-5d"), (2, "2-3d"), (1, "1-2d"), (0, "<1d"))
LEAST_GRADED = 4


def gated_scores(df: DataFrame, by: Sequence[str], p: str, y: str, least: int = LEAST_PAIRS) -> DataFrame:
    """(by, n, status, brier, log_loss): pairs with a null don't count; groups of fewer than `least` pairs have no scores."""
    pair = F.col(p).isNotNull() & F.col(y).isNotNull()
    sums = df.groupBy(*by).agg(F.count(F.when(pair, 1)).alias("n"), F.avg(F.when(pair, F.pow(F.col(p) - F.col(y), 2))).alias("brier"), F.avg(F.when(pair, log_loss(p, y))).alias("log_loss"))
    enough = F.col("n") >= least
    return sums.select(*by, "n", F.when(enough, "scored").otherwise("insufficient").alias("status"), *[F.when(enough, F.col(c)).alias(c) for c in ("brier", "log_loss")])


def bias_shifted(df: DataFrame, by: str, forecast: str, actual: str, weight: Column, learn: Column, least: int = LEAST_ROWS) -> DataFrame:
    """df with its forecast moved by weight x the mean error of the group's rows to learn from; groups with fewer than `least` of these, and unknown weights, move nothing."""
    means = df.where(learn).groupBy(by).agg(F.avg(F.col(actual) - F.col(forecast)).alias("_bias"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return df.join(means, by, "left").withColumn(forecast, F.col(forecast) + F.coalesce(weight * F.col("_bias"), F.lit(0.0))).select(*df.columns)


def before_deadline(log: DataFrame, deadlines: DataFrame, slot: str, day: str) -> DataFrame:
    """The log's rows of days strictly before the day of their slot's deadline (slot, deadline), with lead_days."""
    due = deadlines.select(slot, F.to_date("deadline").alias("_due"))
    rows = log.join(due, slot).where(F.col(day) < F.col("_due"))
    return rows.withColumn("lead_days", F.datediff("_due", day).cast("bigint")).drop("_due")


def first_changes(log: DataFrame, keys: Sequence[str], order: Sequence[str], status: str) -> DataFrame:
    """A row a key whose status left its first value: from_status, final_status and the lead_days of the first row that differs. Null is a status of its own, ''."""
    at, own = F.struct(*order), F.coalesce(F.col(status), F.lit(""))
    rows = log.withColumns({"_at": at, "_status": own})
    first = rows.groupBy(*keys).agg(F.min_by("_status", "_at").alias("from_status"), F.max_by("_status", "_at").alias("final_status"))
    moved = rows.join(first, list(keys)).where("_status <> from_status")
    return moved.groupBy(*keys).agg(F.first("from_status").alias("from_status"), F.first("final_status").alias("final_status"), F.min_by("lead_days", "_at").alias("lead_days"))


def lead_band(days: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, name in reversed(LEAD_BANDS):
        out = F.when(days >= low, name).otherwise(out)
    return out


def grades(rows: DataFrame, verdict: str, missed: str) -> DataFrame:
    """(verdict, n, missed, precision, recall) of 0/1 outcomes: precision is missed / n, recall the share of all that missed, 0 where none did."""
    parts = rows.groupBy(verdict).agg(F.count(F.lit(1)).alias("n"), F.sum(missed).alias("missed"))
    whole = rows.agg(F.sum(missed).alias("_all"))
    out = parts.join(F.broadcast(whole))  # one row
    return out.select(verdict, "n", "missed", (F.col("missed") / F.col("n")).alias("precision"), F.coalesce(F.col("missed") / F.nullif("_all", F.lit(0)), F.lit(0.0)).alias("recall"))


def tiers(ledger: DataFrame, by: str, delta: str, aligned: str, least: int = LEAST_GRADED) -> DataFrame:
    """(by, reviewed, graded, wins, losses, aligned, tier): a negative delta is a win of the model; aligned, level and unknown weeks are reviewed but not graded."""
    strict = ~F.col(aligned)
    sums = ledger.groupBy(by).agg(
        F.count(F.lit(1)).alias("reviewed"), F.count(F.when(strict & (F.col(delta) < 0), 1)).alias("wins"), F.count(F.when(strict & (F.col(delta) > 0), 1)).alias("losses"), F.count(F.when(F.col(aligned), 1)).alias("aligned")
    )
    graded = F.col("wins") + F.col("losses")
    return sums.withColumns({"graded": graded, "tier": F.when(graded < least, "early").when(F.col("wins") > F.col("losses"), "backed").otherwise("mixed")})


def walk(rungs: DataFrame, by: str, rung: str, values: str, capped: str, bar: float) -> DataFrame:
    """(by, below, above, share, taken), of one row a key and rung whose `values` hold a score a draw: steps from a key's lowest rung upwards, up to and with the first refusal.

    A step is taken where the upper rung isn't capped and beats the lower in at least `bar` of the draws they
    share. A key meets in one window, of as many rows as it has rungs; its draws stay in their arrays.
    """
    steps = Window.partitionBy(by).orderBy(rung)
    low = F.lag(values).over(steps)
    pairs = rungs.withColumns({"below": F.lag(rung).over(steps), "_low": low}).where("below is not null")
    better = F.size(F.filter(F.zip_with(values, "_low", lambda a, b: a > b), lambda x: x))
    pairs = pairs.withColumn("share", F.round(better / F.size(values), 4)).withColumn("taken", ~F.col(capped) & (F.col("share") >= bar))
    earlier = Window.partitionBy(by).orderBy(rung).rowsBetween(Window.unboundedPreceding, -1)
    return pairs.withColumn("_open", F.coalesce(F.min("taken").over(earlier), F.lit(True))).where("_open").select(by, "below", F.col(rung).alias("above"), "share", "taken")


def repeats(df: DataFrame, by: str, rung: str, signature: str) -> DataFrame:
    """df with same_as: the key's first rung of the same signature where that is another, else null."""
    first = df.groupBy(by, signature).agg(F.min(rung).alias("_first"))
    return df.join(first, [by, signature]).withColumn("same_as", F.when(F.col("_first") < F.col(rung), F.col("_first"))).select(*df.columns, "same_as")


def carried(rows: DataFrame, stored: DataFrame, today: DataFrame, key: str, slot: str, value: str) -> DataFrame:
    """rows with `value`: as stored for its (key, slot) if the store has the slot at all, else today's of the key."""
    known = stored.select(key, slot, F.col(value).alias("_kept"))
    seen = stored.select(slot).where(F.col(slot).isNotNull()).distinct().withColumn("_seen", F.lit(True))
    out = rows.join(known, [key, slot], "left").join(seen, slot, "left").join(today.select(key, F.col(value).alias("_today")), key, "left")
    return out.withColumn(value, F.when(F.col("_seen"), F.col("_kept")).otherwise(F.col("_today"))).select(*rows.columns, value)


def covered(rows: DataFrame, batch: str, code: str, least: float) -> DataFrame:
    """The rows with a code, of batches in which at least that share has one; other batches go whole."""
    share = rows.groupBy(batch).agg((F.count(code) / F.count(F.lit(1))).alias("_share")).where(F.col("_share") >= least).select(batch)
    return rows.where(F.col(code).isNotNull()).join(share, batch, "left_semi")


def with_carriers(rows: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """rows with the verdicts (one a key) of their keys, and a row of nulls for each verdict whose key has no row."""
    return rows.join(verdicts, key, "left").unionByName(verdicts.join(rows.select(key), key, "left_anti"), allowMissingColumns=True)


def other_side(rows: DataFrame, fixtures: DataFrame, keys: Sequence[str], opponent: str, at_home: str, fallback: str, name: str) -> DataFrame:
    """rows with the club they played for: the other side (home, away) of the fixture with their keys and opponent.

    It falls back where no fixture or more than one fits, and where the row's home flag contradicts the fixture.
    """
    sides = [fixtures.select(*keys, F.col(a).alias(opponent), F.col(b).alias("_club"), F.lit(home).alias("_home")) for a, b, home in (("away", "home", True), ("home", "away", False))]
    found = sides[0].unionByName(sides[1]).groupBy(*keys, opponent).agg(F.first("_club").alias("_club"), F.first("_home").alias("_home"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    own = F.when(F.col(at_home).isNull() | (F.col(at_home) == F.col("_home")), F.col("_club"))
    return rows.join(found, [*keys, opponent], "left").withColumn(name, F.coalesce(own, F.col(fallback))).select(*rows.columns, name)
