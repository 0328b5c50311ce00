"""Joins over entities and time: guarded lookups, intervals, as-of in both directions, conflict-free keys, dense grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import filled


def unique_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of df; the query fails if a key occurs twice."""
    counted = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return counted.where(F.assert_true(F.col("_n") == 1, F.lit(f"a key of {', '.join(keys)} occurs twice")).isNull()).drop("_n")


def many_to_one(df: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join to a dimension that must have each key once."""
    return df.join(unique_by(dim, on), list(on), "left")


def interval_join(facts: DataFrame, spells: DataFrame, on: str, time: str) -> DataFrame:
    """Left join to the spell (start, end, ...) that holds the time, start included and end not; a null end is open. Of several the earliest start counts.

    A key's spells become one array, sorted and with the latest end so far beside each, which never falls: the first spell whose
    latest end is after a fact's time is found by halving, and it holds the time or none does. Facts aren't grouped again.
    """
    told = [c for c in spells.columns if c not in (on, "start", "end")]
    before = Window.partitionBy(on).orderBy("start", "end", *told).rowsBetween(Window.unboundedPreceding, 0)  # a key's spells
    ended = spells.withColumns({"_open": F.max(F.col("end").isNull()).over(before), "_upto": F.max("end").over(before)})
    packed = ended.groupBy(on).agg(F.array_sort(F.collect_list(F.struct("start", F.struct("_open", "_upto").alias("last"), "end", *told))).alias("_spells"))
    after = lambda i: F.get("_spells", i)["last"]["_open"] | (F.get("_spells", i)["last"]["_upto"] > F.col(time))
    halves = F.sequence(F.lit(0), F.ceil(F.log2(F.size("_spells") + 1.0)).cast("int"))

    def halved(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        ends = (s["lo"] >= s["hi"]) | after(mid)
        return F.struct(F.when(ends, s["lo"]).otherwise(mid + 1).alias("lo"), F.when((s["lo"] < s["hi"]) & after(mid), mid).otherwise(s["hi"]).alias("hi"))

    first = F.aggregate(halves, F.struct(F.lit(0).alias("lo"), F.size("_spells").alias("hi")), halved)["lo"]
    found = facts.join(packed, on, "left").withColumn("_spell", F.get("_spells", F.when(F.col("_spells").isNotNull(), first)))
    found = found.withColumn("_spell", F.when(F.col(time) >= F.col("_spell.start"), F.col("_spell")))
    return found.select(*facts.columns, *[F.col(f"_spell.{c}").alias(c) for c in told])


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, value: str, forward: bool = False, strict: bool = True, bucket: Column | None = None) -> DataFrame:
    """left with `value` of the nearest right row (one per key and time) before or after; strict leaves out equal times.

    Both sides meet in one order by key and time, dealt to ranges or to buckets of the time (see filled), so a key costs its rows once and a hot key is split.
    """
    tagged = left.withColumns({value: F.lit(None).cast(right.schema[value].dataType), "_side": F.lit(1)})
    seen = right.select(*by, time, value, F.lit(0).alias("_side"))
    rows = tagged.unionByName(seen, allowMissingColumns=True)
    # among equal times, those of the right that may count stand on the side that is looked at
    ahead = F.col("_side") if strict == forward else -F.col("_side")
    out = filled(rows, by, [F.col(time), ahead], {value: F.when(F.col("_side") == 0, F.col(value))}, forward, bucket=bucket)
    return out.where("_side = 1").drop("_side").select(*left.columns, value)


def agreed(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the value that all its rows share; null where they differ."""
    return df.groupBy(key).agg(F.min(value).alias("_a"), F.max(value).alias("_b")).select(key, F.when(F.col("_a") == F.col("_b"), F.col("_a")).alias(value))


def dense_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts for each pair of occurring values (both lists are dimensions), zeros included."""
    grid = df.select(a).distinct().crossJoin(F.broadcast(df.select(b).distinct()))
    return grid.join(df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")), [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def replace_append(log: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The log with the new rows in place of those with the same keys, so that a repeated append changes nothing."""
    return log.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)
