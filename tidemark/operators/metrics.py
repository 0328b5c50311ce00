"""Error, calibration and spread tables; every one is a single aggregation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import kept


def stratified_errors(df: DataFrame, pred: str, actual: str, bucket: str) -> DataFrame:
    """n, rmse and mae per bucket, and pooled in the bucket 'all'."""
    err = F.col(pred) - F.col(actual)
    out = df.where(F.col(pred).isNotNull() & F.col(actual).isNotNull()).rollup(bucket).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"))
    return out.withColumn(bucket, F.coalesce(bucket, F.lit("all")))


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Equal-width calibration bins: n, mean prediction, mean outcome."""
    own = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("bigint")
    return df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(own.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def sigma_table(df: DataFrame, value: str, bins: Sequence[str], least: int) -> DataFrame:
    """Population deviation per cell, per first bin and overall, where at least `least` rows are; null bins are the margins."""
    names = ", ".join(bins)
    return df.sparkSession.sql(f"SELECT {names}, count(*) AS n, stddev_pop({value}) AS sigma FROM {{rows}} GROUP BY GROUPING SETS (({names}), ({bins[0]}), ()) HAVING count(*) >= {least}", rows=df)


def empirical_cdf(df: DataFrame, group: str, value: str, steps: Sequence[int]) -> DataFrame:
    """Share of rows at or under each step, long form."""
    cells = F.explode(F.transform(F.array(*[F.lit(int(s)) for s in steps]), lambda s: F.struct(s.cast("bigint").alias("step"), (F.col(value) <= s).cast("double").alias("under")))).alias("c")
    return df.select(group, cells).groupBy(group, "c.step").agg(F.avg("c.under").alias("share"))


def weighted_share_se(df: DataFrame, key: str, weight: str, n: Column) -> DataFrame:
    """Percent of n that the key's weights make up, with the standard error from sums and squares."""
    mean = F.sum(weight) / n
    return df.groupBy(key).agg((mean * 100).alias("share"), (F.sqrt(F.greatest(F.sum(F.col(weight) * F.col(weight)) / n - mean * mean, F.lit(0.0)) / n) * 100).alias("se"))


def _tops(df: DataFrame, group: str, score: Callable[[Column], Column], draws: int) -> DataFrame:
    """(_in, _tops): the greatest score of a group in each draw, as an array of a number a draw; a maximum of numbers, on the map side."""
    drawn = df.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select(F.col(group).alias("_in"), F.col("_draw").alias("_at"), score(F.col("_draw")).alias("_s"))
    best = drawn.groupBy("_in", "_at").agg(F.max("_s").alias("_top"))
    return best.groupBy("_in").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_top"))), lambda x: x["_top"]).alias("_tops"))


def _winners(df: DataFrame, group: str, key: str, score: Callable[[Column], Column], draws: int, bounds: tuple[Column, Column] | None) -> DataFrame:
    """(_g, _k, _draw): who has his group's greatest score in a draw, all of equals. Rows that no draw lifts to what their group has in every draw are not drawn."""
    if bounds is not None:
        low, high = bounds
        floors = df.groupBy(F.col(group).alias("_in")).agg(F.max(low).alias("_floor"))
        df = df.join(floors, F.col(group).eqNullSafe(F.col("_in")), "left").where(F.coalesce(high >= F.col("_floor"), F.lit(True))).drop("_in", "_floor")
    spread = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = spread.join(_tops(spread, group, score, draws), F.col(group).eqNullSafe(F.col("_in")), "left")  # every row has its group's; so that rows are never what is broadcast
    wins = F.filter(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: score(i) == F.get("_tops", i))
    return rows.select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.explode(wins).alias("_draw"))


def last_best(df: DataFrame, group: str, key: str, score: Callable[[Column], Column], draws: int, bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """(group, key, p_best) of the keys that have their group's best score in a draw, the greatest key of equals: the share of draws. See p_best."""
    best = _winners(df, group, key, score, draws, bounds).groupBy("_g", "_draw").agg(F.max("_k").alias("_k"))
    return best.groupBy(F.col("_g").alias(group), F.col("_k").alias(key)).agg((F.count(F.lit(1)) / float(draws)).alias("p_best"))


def p_best(df: DataFrame, group: str, key: str, score: Callable[[Column], Column], draws: int = 2000, bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """(group, key, p_best) for each row of df: the share of draws in which its score is its group's best, ties split evenly.

    score gives a row's score in a draw; whether it is null must not depend on the draw. A group with an unknown score has
    no winners, so p_best is null for all of it. Keys are unique. Rows times draws are met twice (for the best, then for who
    has it) and never shuffled: the best of a group's draws are an array, which each of its rows is compared with.
    With `bounds`, a row's least and greatest score over all draws, rows whose greatest is below another's least are
    losers without a draw.
    """
    won = kept(_winners(df, group, key, score, draws, bounds))  # mostly a row a group and draw
    tied = won.groupBy(F.col("_g").alias("_in"), F.col("_draw").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    shares = won.join(tied, F.col("_g").eqNullSafe(F.col("_in")) & (F.col("_draw") == F.col("_at"))).groupBy("_k").agg((F.sum(1 / F.col("_n")) / draws).alias("_p"))
    unknown = df.groupBy(F.col(group).alias("_in")).agg(F.bool_or(score(F.lit(0)).isNull()).alias("_unknown"))
    every = df.select(group, key).join(unknown, F.col(group).eqNullSafe(F.col("_in")), "left").join(shares, F.col(key) == F.col("_k"), "left")
    return every.select(group, key, F.when(~F.col("_unknown"), F.coalesce("_p", F.lit(0.0))).alias("p_best"))
