"""What a plan of moves comes to, week by week: swaps priced over the weeks left, free moves and money carried on, charges or a reason for none, and moves that can't be made."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Prices:
    """Weeks of the horizon, decay a week, the price of a move beyond the free ones, and what a free move, the last bank and a fall of price are worth."""

    weeks: int
    decay: float = 0.85
    hit: float = 4.0
    free_value: float = 0.5
    bank_value: float = 0.08
    fall: float = 0.1
    most_free: int = 5


def swaps(moves: DataFrame, players: DataFrame, squad: str, p: Prices) -> DataFrame:
    """(squad, week, n, bought, sold, gain, reason): the moves of a week in pairs of one kind, by code, with the decayed points of the weeks left.

    moves holds (squad, week, side in|out, code), players (squad, code, kind, ep). A move of an unknown player, one that finds no
    partner of its kind and one outside the horizon have no gain but a reason. Pairs are numbered within a week. Repeated moves count once.
    """
    known = players.select(squad, "code", "kind", "ep")
    rows = moves.select(squad, "week", "side", "code").distinct().join(known, [squad, "code"], "left")
    place = F.row_number().over(Window.partitionBy(squad, "week", "side", "kind").orderBy("code"))  # the moves of a week
    rows = rows.withColumn("_i", F.when(F.col("kind").isNotNull(), place).otherwise(-F.col("code")))
    side = lambda s, name: rows.where(F.col("side") == s).select(squad, "week", F.coalesce("kind", F.lit("")).alias("_k"), "_i", F.col("code").alias(name), F.col("ep").alias(f"_{name}"))
    pairs = side("in", "bought").join(side("out", "sold"), [squad, "week", "_k", "_i"], "full")
    inside = F.col("week").between(0, p.weeks - 1)
    reason = F.when(F.col("_k") == "", "unknown player").when(F.col("bought").isNull() | F.col("sold").isNull(), "no partner of the kind").when(~inside, "outside the horizon")
    point = lambda name, t: F.coalesce(F.get(F.col(f"_{name}"), t), F.lit(0.0))
    weeks = F.filter(F.sequence(F.lit(0), F.lit(p.weeks - 1)), lambda t: t >= F.col("week"))
    gain = F.aggregate(weeks, F.lit(0.0), lambda a, t: a + F.pow(F.lit(p.decay), t) * (point("bought", t) - point("sold", t)))
    order = Window.partitionBy(squad, "week").orderBy(F.coalesce("bought", "sold"), "sold")
    return pairs.withColumns({"reason": reason, "n": F.row_number().over(order).cast("bigint")}).select(squad, "week", "n", "bought", "sold", F.when(reason.isNull(), gain).alias("gain"), "reason")


def ledger(moves: DataFrame, players: DataFrame, state: DataFrame, squad: str, p: Prices, chips: DataFrame | None = None, falls: DataFrame | None = None) -> DataFrame:
    """A row a squad of `state` (squad, bank, free) and week: gain, moves, hits, hit_cost, used, free, bank, bank_value, charge, note, faults.

    A fold over a squad's weeks whose state is its players, money and free moves. gain is null where a swap has none. In a week of a chip
    "wildcard" (squad, week, chip) moves are free and no free move comes in. bank_value is told for the last week alone, which is the only one that
    counts it. charge prices sales after the first week against `falls` (squad, code, chance); it is null, and note says why, where
    falls aren't given or don't have every player sold. faults list, by code, what can't be done: to sell a player who isn't there, to buy one who is or who is unknown, and
    money below 0; such sales and purchases don't happen. Weeks outside the horizon aren't in the ledger (see swaps).
    """
    known = players.groupBy(squad).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", F.struct("cost", "sell"))))).alias("_prices"), F.array_sort(F.collect_list(F.when(F.col("owned"), F.col("code")))).alias("_have"))
    rows = moves.where(F.col("week").between(0, p.weeks - 1)).select(squad, "week", "side", "code").distinct()
    of = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("code"))))
    done = rows.groupBy(squad, "week").agg(of("in").alias("ins"), of("out").alias("outs"))
    gains = swaps(moves, players, squad, p).groupBy(squad, "week").agg(F.when(F.bool_and(F.col("gain").isNotNull()), F.sum("gain")).alias("gain"))
    weeks = state.select(squad, F.explode(F.sequence(F.lit(0), F.lit(p.weeks - 1))).alias("week")).join(done, [squad, "week"], "left").join(gains, [squad, "week"], "left")
    if chips is not None:
        weeks = weeks.join(chips.select(squad, "week", "chip"), [squad, "week"], "left")
    else:
        weeks = weeks.withColumn("chip", F.lit(None).cast("string"))
    none = F.array().cast("array<bigint>")
    chance = F.lit(None).cast("map<bigint,double>")
    if falls is not None:
        known = known.join(falls.groupBy(squad).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "chance")))).alias("_falls")), squad, "left")
        chance = F.coalesce("_falls", F.map_from_arrays(none, F.array().cast("array<double>")))
    row = F.struct("week", F.coalesce("ins", none).alias("ins"), F.coalesce("outs", none).alias("outs"), F.when(F.size(F.coalesce("ins", none)) + F.size(F.coalesce("outs", none)) == 0, F.lit(0.0)).otherwise(F.col("gain")).alias("gain"), F.coalesce(F.col("chip") == "wildcard", F.lit(False)).alias("wild"))
    line = weeks.groupBy(squad).agg(F.array_sort(F.collect_list(row)).alias("_weeks")).join(state, squad).join(known, squad, "left").withColumn("_chance", chance)

    def step(s: Column, w: Column) -> Column:
        price = lambda c, what: F.get(F.array(F.try_element_at("_prices", c)), F.lit(0))[what]
        sold = F.filter(w["outs"], lambda c: F.array_contains(s["have"], c))
        left = F.array_except(s["have"], sold)
        bought = F.filter(w["ins"], lambda c: ~F.array_contains(left, c) & price(c, "cost").isNotNull())
        bank = s["bank"] + F.aggregate(sold, F.lit(0).cast("bigint"), lambda a, c: a + F.coalesce(price(c, "sell"), F.lit(0))) - F.aggregate(bought, F.lit(0).cast("bigint"), lambda a, c: a + price(c, "cost"))
        n = F.size(bought)
        hits = F.when(w["wild"], 0).otherwise(F.greatest(n - s["free"], F.lit(0)))
        free = F.when(w["wild"], s["free"]).otherwise(F.least(F.greatest(s["free"] - n, F.lit(0)) + 1, F.lit(p.most_free)))
        told = lambda codes, what: F.transform(codes, lambda c: F.concat(c.cast("string"), F.lit(what)))
        faults = F.array_sort(F.concat(told(F.array_except(w["outs"], sold), " not there to sell"), told(F.array_except(w["ins"], bought), " not to be bought"), F.when(bank < 0, F.array(F.lit("money below 0"))).otherwise(F.array().cast("array<string>"))))
        later = (w["week"] > 0) & (F.size(sold) > 0)
        fall = lambda c: F.try_element_at(F.col("_chance"), c)
        charge = F.when(~later, 0.0).when(F.col("_chance").isNotNull() & F.forall(sold, lambda c: fall(c).isNotNull()), F.aggregate(sold, F.lit(0.0), lambda a, c: a + fall(c) * p.fall * p.bank_value))
        note = F.when(charge.isNull(), F.when(F.col("_chance").isNull(), "no chances of a fall given").otherwise("a chance of a fall is unknown"))
        out = F.struct(
            w["week"].alias("week"), w["gain"].alias("gain"), n.cast("bigint").alias("moves"), hits.cast("bigint").alias("hits"), (p.hit * F.pow(F.lit(p.decay), w["week"]) * hits).alias("hit_cost"),
            F.when(w["wild"], 0).otherwise(F.least(n, s["free"])).cast("bigint").alias("used"), free.cast("bigint").alias("free"), bank.alias("bank"), F.when(w["week"] == p.weeks - 1, p.bank_value / 10 * bank).alias("bank_value"), charge.alias("charge"), note.alias("note"), F.array_join(faults, "; ").alias("faults"),
        )
        return F.struct(F.concat(left, bought).alias("have"), bank.alias("bank"), free.cast("int").alias("free"), F.concat(s["rows"], F.array(out)).alias("rows"))

    shape = "array<struct<week:int,gain:double,moves:bigint,hits:bigint,hit_cost:double,used:bigint,free:bigint,bank:bigint,bank_value:double,charge:double,note:string,faults:string>>"
    start = F.struct(F.coalesce("_have", none).alias("have"), F.coalesce(F.col("bank").cast("bigint"), F.lit(0)).alias("bank"), F.coalesce(F.col("free").cast("int"), F.lit(0)).alias("free"), F.array().cast(shape).alias("rows"))
    return line.select(squad, F.explode(F.aggregate("_weeks", start, step)["rows"]).alias("r")).select(squad, "r.*")
