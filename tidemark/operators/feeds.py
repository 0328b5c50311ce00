"""Feeds that meet in one table by precedence, versions that a grade has settled, and the stance against rivals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import return_chance

#: Statuses that news never softens, those that say that an entry is flagged, the one that news gives.
SETTLED, FLAGGED, NEWS_STATUS = ("s", "u", "n"), ("i", "d"), "i"


def one_each(df: DataFrame, key: str) -> DataFrame:
    """One row a key, of several the least by its other columns in their order; null keys go."""
    rest = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*")


def merged_availability(official: DataFrame, injuries: DataFrame, lineups: DataFrame, slot: int) -> DataFrame:
    """A row an official code: (code, status, chance, injury_type, return_slot, p_start_hint, source).

    official: code, status, chance. injuries: code, injury_type, return_slot, pct, source. lineups: code, p_start_hint.
    Settled statuses take no news. A listing whose return lies before `slot` is stale and says nothing. The chance
    of an injury is the lower of what its return and its percentage say, and it only lowers the official one; an
    entry that it lowers and that wasn't flagged becomes injured. Hints are carried, and name a source where none is.
    """
    out = one_each(official, "code")
    news = one_each(injuries, "code").where(F.col("return_slot").isNull() | (F.col("return_slot") >= slot))
    # least skips nulls: with one reading, that one counts
    news = news.withColumn("_chance", F.least(return_chance(F.col("return_slot"), F.lit(slot)), F.col("pct").cast("double"))).drop("pct")
    out = out.join(news, "code", "left").join(one_each(lineups, "code"), "code", "left")
    open_ = ~F.coalesce(F.col("status").isin(*SETTLED), F.lit(False))
    told = {c: F.when(open_, F.col(c)) for c in ("injury_type", "return_slot", "p_start_hint", "_chance")}
    source = F.when(open_, F.coalesce("source", F.when(F.col("p_start_hint").isNotNull(), "lineups")))
    out = out.withColumns(told | {"source": source})
    bites = F.coalesce(F.col("_chance") < F.coalesce(F.col("chance"), F.lit(101.0)), F.lit(False))
    flagged = F.coalesce(F.col("status").isin(*FLAGGED), F.lit(False))
    out = out.withColumns({"chance": F.when(bites, F.col("_chance")).otherwise(F.col("chance")), "status": F.when(bites & ~flagged, NEWS_STATUS).otherwise(F.col("status"))})
    return out.select("code", "status", "chance", "injury_type", "return_slot", "p_start_hint", "source")


def superseded(versions: DataFrame, grades: DataFrame, key: Sequence[str], stamp: str) -> DataFrame:
    """Versions of graded keys other than the one that the grade names, where that one exists; the rest is left alone."""
    named = grades.select(*key, F.col(stamp).alias("_named"))
    standing = named.join(versions.select(*key, F.col(stamp).alias("_named")).distinct(), [*key, "_named"], "left_semi")
    return versions.join(standing, list(key)).where(F.col(stamp) != F.col("_named")).select(*versions.columns)


def strategy(entries: DataFrame, by: str, entry: str, total: str, mine: Column, sigma: str, weeks: int, cap: float, scale: float, band: float) -> DataFrame:
    """(by, rival, gap, z, dial, stance): against the leader while behind, else against the rival nearest in sigmas; the least entry of equals.

    z inside the band is noise: the dial is 0 and the stance neutral. A group without an entry of mine, or without rivals, has no row.
    """
    own = entries.where(mine).groupBy(by).agg(F.max(total).alias("_own"))
    rows = entries.where(~mine).join(own, by).withColumn("_norm", (F.col("_own") - F.col(total)) / (F.col(sigma) * weeks**0.5))
    pick = F.struct(F.col(entry).alias("rival"), F.col(total).alias("total"), F.col("_norm").alias("norm"))
    best = rows.groupBy(by).agg(F.first("_own").alias("_own"), F.min_by(pick, F.struct(-F.col(total), F.col(entry))).alias("top"), F.min_by(pick, F.struct("_norm", entry)).alias("near"))
    behind = F.col("top.total") > F.col("_own")
    best = best.withColumn("_at", F.when(behind, F.col("top")).otherwise(F.col("near")))
    z = F.when(F.abs(F.col("_at.norm")) < band, 0.0).otherwise(-F.col("_at.norm"))
    best = best.select(by, F.col("_at.rival").alias("rival"), F.abs(F.col("_own") - F.col("_at.total")).alias("gap"), z.alias("z"))
    dial = cap * F.tanh(F.abs("z") / scale) * F.signum("z")
    return best.withColumn("dial", dial).withColumn("stance", F.when(F.col("dial") == 0, "neutral").when(F.col("dial") > 0, "chase").otherwise("defend"))
