"""Window operators over entity-ordered facts. Leakage-safe: what is called lagged never sees the row itself or later rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip, days_between, ratio

ALL = Window.unboundedPreceding


def _by(entity: Sequence[str] | str, order: Sequence[str]):
    return Window.partitionBy(*([entity] if isinstance(entity, str) else entity)).orderBy(*order)


def lagged_means(df: DataFrame, entity: str, order: Sequence[str], stats: Sequence[str], windows: Sequence[int]) -> DataFrame:
    """Adds `<stat>_r<w>`: the mean of a stat over the entity's w rows before this one; nulls are skipped but use up a row."""
    return df.withColumns({f"{s}_r{w}": F.avg(s).over(_by(entity, order).rowsBetween(-w, -1)) for s in stats for w in windows})


def as_of_end(df: DataFrame, entity: str, order: Sequence[str], stats: Sequence[str], windows: Sequence[int]) -> DataFrame:
    """One row per entity: `<stat>_r<w>`, the mean over its last w rows, the last one included."""
    last = Window.partitionBy(entity).orderBy(*[F.desc(c) for c in order])
    ranked = df.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= max(windows))
    return ranked.groupBy(entity).agg(*[F.avg(F.when(F.col("_n") <= w, F.col(s))).alias(f"{s}_r{w}") for s in stats for w in windows])


def lagged_ratio(entity: str, order: Sequence[str], value: str, per: str, window: int, scale: float = 1.0) -> Column:
    """scale * sum(value) / sum(per) over the window rows before; null where the denominator is 0 or no row is before."""
    w = _by(entity, order).rowsBetween(-window, -1)
    return ratio(F.sum(value).over(w), F.sum(per).over(w)) * scale


def expanding_share(entity: Sequence[str], order: Sequence[str], flag: Column) -> Column:
    """Mean of a flag over all earlier rows of the group."""
    return F.avg(flag.cast("double")).over(_by(entity, order).rowsBetween(ALL, -1))


def days_since(entity: str, order: Sequence[str], time: str, flag: Column, most: int) -> Column:
    """Whole days since the entity's last earlier row with the flag, at most `most`; null if there is none."""
    last = F.last(F.when(flag, F.col(time)), ignorenulls=True).over(_by(entity, order).rowsBetween(ALL, -1))
    return clip(days_between(time, last), 0, most)


def day_streaks(df: DataFrame, entity: str, day: str) -> DataFrame:
    """Distinct (entity, day) with `streak`: how many consecutive days end there (gaps and islands)."""
    days = df.select(entity, day).distinct()
    numbered = days.withColumn("_island", F.date_sub(F.col(day), F.row_number().over(_by(entity, [day]))))
    return numbered.withColumn("streak", F.row_number().over(_by([entity, "_island"], [day])).cast("bigint")).drop("_island")


def neighbour_gaps(entity: str, order: Sequence[str], time: str, most: int) -> tuple[Column, Column]:
    """Whole days since the row before and until the row after, at most `most`."""
    w = _by(entity, order)
    return clip(days_between(time, F.lag(time).over(w)), 0, most), clip(days_between(F.lead(time).over(w), time), 0, most)


def range_count(entity: str, time: str, days: int) -> Column:
    """Rows of the entity in the `days` times 24 hours before this one."""
    w = Window.partitionBy(entity).orderBy(F.unix_seconds(F.col(time))).rangeBetween(-days * 86400, -1)
    return F.count(F.lit(1)).over(w)


def active_days_before(df: DataFrame, entity: str, day: str, days: int, covered_from: Column) -> DataFrame:
    """Distinct (entity, day) with `density`: active days in the `days` calendar days before; null where those aren't all covered."""
    active = df.select(entity, day).distinct().withColumn("_d", F.datediff(F.col(day), F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy(entity).orderBy("_d").rangeBetween(-days, -1)
    return active.withColumn("density", F.when(F.date_sub(F.col(day), days) >= covered_from, F.count(F.lit(1)).over(w))).drop("_d")


def last_share(entity: Sequence[str], order: Sequence[str], flag: Column, k: int) -> Column:
    """Mean of a flag over the last k earlier rows of the group; null under k rows."""
    w = _by(entity, order).rowsBetween(-k, -1)
    return F.when(F.count(F.lit(1)).over(w) == k, F.avg(flag.cast("double")).over(w))


def set_churn(df: DataFrame, group: str, slot: str, member: str, window: int) -> DataFrame:
    """Per (group, slot): `n_new` members that the group's slot before lacked (null in the first), and its trailing mean over `window` slots.

    Slots are numbered per group and matched by number, so no set of members is ever gathered.
    """
    rows = df.select(group, slot, member).distinct()
    slots = rows.select(group, slot).distinct().withColumn("_n", F.row_number().over(_by(group, [slot])))
    placed = rows.join(slots, [group, slot])
    earlier = placed.select(group, member, (F.col("_n") + 1).alias("_n"), F.lit(True).alias("_seen"))
    new = placed.join(earlier, [group, member, "_n"], "left").groupBy(group, slot, "_n").agg(F.count(F.when(F.col("_seen").isNull(), 1)).alias("_new"))
    counted = new.withColumn("n_new", F.when(F.col("_n") > 1, F.col("_new")))
    w = _by(group, ["_n"]).rowsBetween(1 - window, 0)
    return counted.select(group, slot, "n_new", F.avg("n_new").over(w).alias("churn"))


def competition_award(group: Sequence[str], score: str, awards: Sequence[int] = (3, 2, 1)) -> Column:
    """Awards by competition rank: equal scores share the better award, and the next ones are skipped."""
    place = F.rank().over(Window.partitionBy(*group).orderBy(F.desc(score)))
    out = F.lit(0)
    for k, a in enumerate(awards, 1):
        out = F.when(place == k, F.lit(a)).otherwise(out)
    return out.cast("bigint")


def top_per_group(df: DataFrame, group: str, score: str, tie: str, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))).where(F.col("_n") <= n).drop("_n")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Whole rows, the last of each key; nulls in other columns stay as that row has them."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).where("_n = 1").drop("_n")


# -- strictly earlier priors ---------------------------------------------------------------------------


def shrunk_ratio(df: DataFrame, entity: str, group: str, slot: str, value: str, per: str, k: float, as_of_end: bool = False) -> DataFrame:
    """Empirical-Bayes rates: (own value + k * prior) / (own n + k) by (entity, slot).

    The prior is the group's ratio over strictly earlier slots, summed by slot first so that a slot never sees
    its own members; own sums are of strictly earlier slots too. as_of_end: one row per entity, all slots included.
    """
    own = df.groupBy(entity, group, slot).agg(F.sum(value).alias("_v"), F.sum(per).alias("_n"))
    slots = own.groupBy(group, slot).agg(F.sum("_v").alias("_gv"), F.sum("_n").alias("_gn"))
    if as_of_end:
        prior = slots.groupBy(group).agg(ratio(F.sum("_gv"), F.sum("_gn")).alias("_prior"))
        sums = own.groupBy(entity, group).agg(F.sum("_v").alias("_v"), F.sum("_n").alias("_n"))
        return sums.join(prior, group).select(entity, group, ((F.col("_v") + k * F.col("_prior")) / (F.col("_n") + k)).alias("rate"))
    w = _by(group, [slot]).rowsBetween(ALL, -1)
    prior = slots.select(group, slot, ratio(F.sum("_gv").over(w), F.sum("_gn").over(w)).alias("_prior"))
    e = _by([entity, group], [slot]).rowsBetween(ALL, -1)
    before = own.select(entity, group, slot, F.coalesce(F.sum("_v").over(e), F.lit(0)).alias("_v"), F.coalesce(F.sum("_n").over(e), F.lit(0)).alias("_n"))
    return before.join(prior, [group, slot]).select(entity, group, slot, ((F.col("_v") + k * F.col("_prior")) / (F.col("_n") + k)).alias("rate"))
