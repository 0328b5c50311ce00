"""Scores of forecasts, choices on grids, boundaries in time, and tables of weights and plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip, log_loss


def ranking_metrics(df: DataFrame, slot: str, key: str, pred: str, actual: str, starter: Column, top: int = 15) -> DataFrame:
    """One row: mean absolute error of all and of starters, root mean square of starters, mean outcome of each slot's best forecast and of the sum of its `top`.

    The best of a slot come from partial top lists of bounded length, so a slot may hold any number of rows.
    """
    err = F.col(pred) - F.col(actual)
    errors = df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae_all"), F.avg(F.when(starter, F.abs(err))).alias("mae_starters"), F.sqrt(F.avg(F.when(starter, err * err))).alias("rmse_starters"))
    place = Window.partitionBy(slot).orderBy(F.desc(pred), key)
    best = df.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= top)
    slots = best.groupBy(slot).agg(F.sum(F.when(F.col("_place") == 1, F.col(actual))).alias("first"), F.sum(actual).alias("sum"))
    tops = slots.agg(F.avg("first").alias("top1"), F.avg("sum").alias(f"top{top}"))
    return errors.join(F.broadcast(tops))  # a row each


def correlation_grid(df: DataFrame, grid: Sequence[float], estimate, actual: str) -> DataFrame:
    """(k, corr): the correlation of estimate(k) with the outcome for each k of a fixed grid, in one pass: an aggregate a value."""
    found = df.agg(*[F.corr(estimate(F.lit(float(k))), F.col(actual)).alias(f"c{i}") for i, k in enumerate(grid)])
    rows = F.array(*[F.struct(F.lit(float(k)).alias("k"), F.col(f"c{i}").alias("corr")) for i, k in enumerate(grid)])
    return found.select(F.explode(rows).alias("x")).select("x.*")


def blend_weight(df: DataFrame, a: str, b: str, y: str, step: float = 0.01) -> DataFrame:
    """One row: the smallest weight of a (against b) whose mean log loss is within one standard error, of the paired differences, of the best weight's.

    Two passes with an aggregate for each weight of the grid; rows with a null don't count.
    """
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(y).isNotNull())
    grid = [round(i * step, 2) for i in range(round(1 / step) + 1)]
    loss = lambda w: log_loss(F.lit(w) * F.col(a) + F.lit(1.0 - w) * F.col(b), F.col(y), 1e-12)
    means = known.agg(*[F.avg(loss(w)).alias(f"m{i}") for i, w in enumerate(grid)]).first()
    values = [means[i] for i in range(len(grid))]
    if values[0] is None:
        return df.sparkSession.createDataFrame([], "weight double, best double")
    best = min(range(len(grid)), key=lambda i: values[i])
    spread = known.agg(F.count(F.lit(1)).alias("n"), *[F.stddev_samp(loss(w) - loss(grid[best])).alias(f"s{i}") for i, w in enumerate(grid[:best])]).first()
    near = [i for i in range(best) if spread["n"] > 1 and values[i] - values[best] <= spread[f"s{i}"] / spread["n"] ** 0.5]
    return df.sparkSession.createDataFrame([(grid[min(near, default=best)], grid[best])], "weight double, best double")


def nth_last_slot(df: DataFrame, slots: Sequence[str], n: int) -> DataFrame:
    """The n-th distinct slot from the end; no row where there are not more than n."""
    distinct = df.select(*slots).distinct()
    last = distinct.orderBy(*[F.desc(s) for s in slots]).limit(n + 1)
    whole = last.agg(F.sort_array(F.collect_list(F.struct(*slots))).alias("x"))  # n + 1 slots
    return whole.where(F.size("x") > n).select(F.col("x")[1].alias("at")).select("at.*")


def suffix_floor(df: DataFrame, ordinal: str, counted: Column, least: int) -> DataFrame:
    """One row: the greatest ordinal from which on `least` counted rows stand, else the first ordinal."""
    by = df.groupBy(ordinal).agg(F.count(F.when(counted, 1)).alias("n"))
    later = by.withColumn("after", F.sum("n").over(Window.orderBy(F.desc(ordinal))))  # a row an ordinal
    return later.agg(F.coalesce(F.max(F.when(F.col("after") >= least, F.col(ordinal))), F.min(ordinal)).alias(ordinal))


def latest_before(df: DataFrame, key: str, at: str, order: Sequence[str], deadline: Column) -> DataFrame:
    """Of each key the last row strictly before its deadline, else its last row, flagged late."""
    stamp = F.struct(at, *order)
    row = F.struct(*df.columns)
    early = F.max_by(row, F.when(F.col(at) < deadline, stamp))
    found = df.groupBy(key).agg(early.alias("early"), F.max_by(row, stamp).alias("last"))
    return found.select(F.coalesce("early", "last").alias("r"), F.col("early").isNull().alias("late")).select("r.*", "late")


def last_values(df: DataFrame, key: str, order: Sequence[str], value: str, n: int = 4) -> DataFrame:
    """(key, values): the last n values in time order."""
    place = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    top = df.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= n)
    lists = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("_place")).alias("p"), F.col(value).alias("v")))).alias("x"))  # n values
    return lists.select(key, F.transform("x", lambda v: v["v"]).alias("values"))


def projected(df: DataFrame, key: str, slot: str, value: str, at: Column, least: int = 2) -> DataFrame:
    """(key, value, weeks, rise): a line through the first and the last slot before `at`, carried on to it; keys with fewer slots than `least` have none."""
    known = df.where(F.col(slot) < at).groupBy(key).agg(F.count(F.lit(1)).alias("weeks"), F.min(F.struct(slot, value)).alias("a"), F.max(F.struct(slot, value)).alias("b"))
    rise = (F.col(f"b.{value}") - F.col(f"a.{value}")) / (F.col(f"b.{slot}") - F.col(f"a.{slot}"))
    return known.where(F.col("weeks") >= max(2, least)).select(key, "weeks", rise.alias("rise"), (F.col(f"b.{value}") + rise * (at - F.col(f"b.{slot}"))).alias("value"))


def modal_plan(df: DataFrame, key: str, count: str, value: str) -> DataFrame:
    """(key, modal count and value, runner_up, margin): the most frequent plan, the dearer of equals, and the best value of the others."""
    rows = df.groupBy(key).agg(F.max(F.struct(count, value)).alias("modal"), F.max_by(value, F.struct(count, value)).alias("_v"), F.count(F.lit(1)).alias("n"), F.max(value).alias("top"))
    best = rows.select(F.col(key).alias("_k"), "modal")
    rest = df.join(best, F.col(key) == F.col("_k")).where((F.col(count) != F.col(f"modal.{count}")) | (F.col(value) != F.col(f"modal.{value}"))).groupBy(key).agg(F.max(value).alias("runner_up"))
    same = df.join(best, F.col(key) == F.col("_k")).where((F.col(count) == F.col(f"modal.{count}")) & (F.col(value) == F.col(f"modal.{value}"))).groupBy(key).agg((F.count(F.lit(1)) > 1).alias("twice"))
    out = rows.join(rest, key, "left").join(same, key)
    runner = F.when(F.col("twice"), F.greatest(F.col(f"modal.{value}"), F.coalesce("runner_up", F.col(f"modal.{value}")))).otherwise(F.col("runner_up"))
    return out.select(key, F.col(f"modal.{count}").alias("count"), F.col(f"modal.{value}").alias("value"), runner.alias("runner_up"), (F.col(f"modal.{value}") - runner).alias("margin"))


def weighted_cover(picks: DataFrame, weights: DataFrame, entry: str, item: str, multiplier: str, weight: str) -> DataFrame:
    """(item, cover, captain_cover): weighted by entry, how much of an item is held, twice at most, and how often it counts double; neither above 1."""
    held = picks.join(weights.where(F.coalesce(F.col(weight), F.lit(0)) != 0), entry).where(F.col(multiplier) > 0)
    own = F.sum(F.col(weight) * F.least(F.col(multiplier), F.lit(2)))
    return held.groupBy(item).agg(clip(own, high=1.0).alias("cover"), clip(F.sum(F.when(F.col(multiplier) >= 2, F.col(weight)).otherwise(0.0)), high=1.0).alias("captain_cover"))


def field_exposures(picks: DataFrame, sigmas: DataFrame, entry: str, item: str, multiplier: str, sigma: str, default: float = 0.0) -> DataFrame:
    """(entry, exposure): correlation, between 0 and 1, of an entry's items with the field's mean holding, items being independent with their sigmas."""
    n = picks.select(F.count_distinct(entry).alias("entries"))
    field = picks.groupBy(item).agg(F.sum(multiplier).alias("_m")).join(F.broadcast(n)).select(item, (F.col("_m") / F.col("entries")).alias("_w"))  # one row
    known = field.join(sigmas, item, "left").select(item, "_w", F.coalesce(sigma, F.lit(0.0)).alias("_s"))
    variance = known.agg(F.sum(F.pow(F.col("_w") * F.col("_s"), 2)).alias("_field"))
    own = picks.join(known, item).groupBy(entry).agg(F.sum(F.pow(F.col(multiplier) * F.col("_s"), 2)).alias("_var"), F.sum(F.col(multiplier) * F.col("_w") * F.col("_s") * F.col("_s")).alias("_cov"))
    both = F.when((F.col("_var") > 0) & (F.col("_field") > 0), clip(F.col("_cov") / F.sqrt(F.col("_var") * F.col("_field")), 0.0, 1.0)).otherwise(F.lit(default))
    return own.join(F.broadcast(variance)).select(entry, both.alias("exposure"))


def option_values(df: DataFrame, key: str, surplus: str, weeks: int, cap: int = 5) -> DataFrame:
    """(key, k, week, value, gain): worth of k banked moves with so many weeks left, and of the k-th itself.

    A week's surplus s pays s times 1 + 1/2 + ... + 1/j for j moves used; one move comes back a week, up to cap. Each week is one
    aggregate over the surpluses by key, so a key may have any number of them; weeks and cap are small.
    """
    paid = [sum(1 / i for i in range(1, j + 1)) for j in range(cap + 1)]
    before = df.select(key).distinct().withColumn("v", F.array(*[F.lit(0.0)] * (cap + 1)))
    tables = []
    for week in range(1, weeks + 1):
        best = [F.greatest(*[F.col(surplus) * paid[j] + F.col("v")[min(k - j + 1, cap)] for j in range(k + 1)]) if k else F.col("v")[1] for k in range(cap + 1)]
        before = df.join(before, key).groupBy(key).agg(F.array(*[F.avg(x) for x in best]).alias("v"))
        gain = lambda v, k: F.when(k > 0, F.greatest(F.lit(0.0), v - F.get(F.col("v"), k - 1)))
        rows = F.transform("v", lambda v, k: F.struct(k.cast("bigint").alias("k"), v.alias("value"), gain(v, k).alias("gain")))
        tables.append(before.select(key, F.lit(week).cast("bigint").alias("week"), F.explode(rows).alias("x")).select(key, "x.k", "week", "x.value", "x.gain"))
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out
