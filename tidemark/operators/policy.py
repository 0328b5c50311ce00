"""Decisions over a short horizon: optimal stopping, sample mixtures, best slots, thresholds with a near-miss band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stopping_thresholds(samples: DataFrame, key: str, slot: str, value: str) -> DataFrame:
    """(key, slot, threshold): the value of going on, so an offer at a slot is taken if it is at or above it.

    samples holds draws of the offer at each slot. Backwards: after the last slot going on is worth 0, and before
    slot t it is worth the mean over the draws of t of max(draw, value of going on after t). The draws of a slot are
    reduced to (value, count) pairs first; the recursion folds over the few slots of a key.
    """
    draws = samples.where(F.col(value).isNotNull()).groupBy(key, slot, value).agg(F.count(F.lit(1)).alias("n"))
    slots = draws.groupBy(key, slot).agg(F.collect_list(F.struct(F.col(value).cast("double").alias("x"), F.col("n").cast("double").alias("n"))).alias("draws"))
    line = slots.groupBy(key).agg(F.reverse(F.array_sort(F.collect_list(F.struct(F.col(slot).alias("slot"), "draws")))).alias("line"))

    def back(seen: Column, at: Column) -> Column:
        ahead = F.when(F.size(seen) == 0, F.lit(0.0)).otherwise(F.element_at(seen, -1)["worth"])
        mass = lambda acc, d: acc + d["n"]
        total = F.aggregate(at["draws"], F.lit(0.0), mass)
        worth = F.aggregate(at["draws"], F.lit(0.0), lambda acc, d: acc + d["n"] * F.greatest(d["x"], ahead)) / total
        return F.concat(seen, F.array(F.struct(at["slot"].cast("bigint").alias("slot"), ahead.alias("threshold"), worth.alias("worth"))))

    empty = F.array().cast("array<struct<slot:bigint,threshold:double,worth:double>>")
    return line.select(key, F.explode(F.aggregate("line", empty, back)).alias("s")).select(key, F.col("s.slot").alias(slot), F.col("s.threshold").alias("threshold"), F.col("s.worth").alias("worth"))


def mixture(samples: DataFrame, share: Column, twice: Column, copies: int) -> DataFrame:
    """Each sample `copies` times, of which round(share * copies) hold `twice` instead of the value: a two-part mixture of equal weights."""
    with_copies = samples.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return with_copies.withColumn("value", F.when(F.col("copy") < F.round(share * copies), twice).otherwise(F.col("value")))


def best_slot(table: DataFrame, key: str, slot: str, gain: str) -> DataFrame:
    """Per key the slot of the greatest gain (the earliest of equals) and that gain."""
    top = F.max_by(F.struct(F.col(slot).alias("s"), F.col(gain).alias("g")), F.struct(F.col(gain), -F.col(slot)))
    return table.where(F.col(gain).isNotNull()).groupBy(key).agg(top.alias("t")).select(key, F.col("t.s").alias(slot), F.col("t.g").alias(gain))


def gate(frequency: Column, bar: float, band: float) -> Column:
    """act at or above the bar, near within the band under it, else hold; null stays null."""
    return F.when(frequency >= bar, "act").when(frequency >= bar - band, "near").when(frequency.isNotNull(), "hold")


def schedule(gains: DataFrame, by: Sequence[str], slot: str, chip: str, gain: str, chips: Sequence[str], lasting: Sequence[str] = ()) -> DataFrame:
    """(by, slot, chip, gain, per_week, total): which chips a key plays when, so that their gains sum to the most; each at most once, one a slot, none at a loss.

    by names what a key's set of chips is good for, such as a player and half of a season: sets don't carry over. Of schedules that
    gain the same, the one that plays later and earlier chips of the list first stays. gains are whole numbers; of several rows of a
    slot and chip the largest counts, nulls and chips not listed for nothing. per_week spreads a `lasting` chip's gain
    over the weeks from its slot to the key's last one, others have one week. A key with nothing to gain has no row.

    A dynamic programme over subsets: the fold over a key's slots holds, for each set of chips played, the best sum so far and where they
    went, 2 to the number of chips in all. A key meets in one row of slots times chips.
    """
    n, name = len(chips), F.array(*map(F.lit, chips))
    rows = gains.where(F.col(gain).isNotNull() & F.col(slot).isNotNull() & F.col(chip).isin(list(chips)))
    best = rows.groupBy(*by, slot, chip).agg(F.max(F.col(gain).cast("bigint")).alias("_g"))
    line = best.groupBy(*by, slot).agg(*[F.max(F.when(F.col(chip) == c, F.col("_g"))).alias(f"_{k}") for k, c in enumerate(chips)])
    offer = F.struct(F.col(slot).cast("bigint").alias("slot"), F.array(*[F.col(f"_{k}") for k in range(n)]).alias("g"))
    keys = line.groupBy(*by).agg(F.array_sort(F.collect_list(offer)).alias("_slots"))
    # a state is (minus the sum, which chip each slot so far got: a letter a slot); the least is the best
    state = "struct<m:bigint,p:string>"
    start = F.array(*[F.struct(F.lit(0).cast("bigint").alias("m"), F.lit("").alias("p")).cast(state) if mask == 0 else F.lit(None).cast(state) for mask in range(1 << n)])
    letter = lambda k: chr(ord("a") + k)

    def step(acc: Column, at: Column) -> Column:
        def ends(mask: int) -> Column:
            stays = F.get(acc, F.lit(mask))
            options = [F.when(stays.isNotNull(), F.struct(stays["m"].alias("m"), F.concat(stays["p"], F.lit("-")).alias("p")))]
            for k in range(n):
                if mask >> k & 1:
                    was, g = F.get(acc, F.lit(mask ^ 1 << k)), F.get(at["g"], F.lit(k))
                    options.append(F.when(was.isNotNull() & (g > 0), F.struct((was["m"] - g).alias("m"), F.concat(was["p"], F.lit(letter(k))).alias("p"))))
            return F.array_min(F.array(*options)).cast(state)

        return F.array(*[ends(mask) for mask in range(1 << n)])

    told = keys.withColumn("_best", F.array_min(F.aggregate("_slots", start, step)))
    last = F.element_at("_slots", -1)["slot"]
    places = F.posexplode(F.split("_best.p", ""))
    plays = told.select(*by, "_slots", F.col("_best.m").alias("_m"), last.alias("_last"), places.alias("_i", "_c")).where("_c between 'a' and 'z'")
    k, at = F.ascii("_c") - ord("a"), F.get("_slots", F.col("_i"))
    out = plays.select(*by, at["slot"].alias(slot), F.get(name, k).alias(chip), F.get(at["g"], k).alias(gain), (-F.col("_m")).alias("total"), "_last")
    weeks = F.when(F.col(chip).isin(list(lasting)), F.col("_last") - F.col(slot) + 1).otherwise(1)
    return out.select(*by, slot, chip, gain, (F.col(gain) / weeks).alias("per_week"), "total")
