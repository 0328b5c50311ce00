"""Squads as arrays: best legal elevens, substitutions in order, points of picks. A squad has fifteen rows, so it is one array of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import XI_BOUNDS

KINDS = tuple(XI_BOUNDS)
FORMATIONS = [(1, d, m, 10 - d - m) for d in range(3, 6) for m in range(2, 6) if 1 <= 10 - d - m <= 3]


def best_eleven(rows: DataFrame, squad: str, kind: str, points: str) -> DataFrame:
    """(squad, total, captain): the most points that eleven of the squad in a legal formation give, their best counted twice; no row where no formation fits.

    Within a kind the best come first, so a formation's eleven are the first few of each kind.
    """
    score = F.coalesce(F.col(points), F.lit(0)).cast("bigint")
    lists = rows.groupBy(squad).agg(*[F.sort_array(F.collect_list(F.when(F.col(kind) == k, score)), asc=False).alias(k) for k in KINDS])

    def total(counts: tuple[int, ...]) -> Column:
        fits, parts = F.lit(True), F.lit(0).cast("bigint")
        for k, n in zip(KINDS, counts, strict=True):
            fits = fits & (F.size(k) >= n)
            parts = parts + F.aggregate(F.slice(k, 1, n), F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.when(fits, parts)

    captain = F.greatest(*[F.get(k, F.lit(0)) for k in KINDS])
    return lists.select(squad, (F.array_max(F.array(*map(total, FORMATIONS))) + captain).alias("total"), captain.alias("captain")).where("total is not null")


def substituted(rows: DataFrame, squad: str, place: str, kind: str, played: str, points: str) -> DataFrame:
    """(squad, n_subs, ins, points): starters (places 1 to 11) who did not play give way, in order, to the first on the bench (12 on) who played, isn't used and keeps the formation legal.

    ins lists the places that came on; points are those of the eleven after the substitutions.
    """
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind)).cast("int") - 1
    row = F.struct(F.col(place).cast("int").alias("i"), number.alias("kind"), F.coalesce(F.col(played), F.lit(False)).alias("played"), F.coalesce(F.col(points), F.lit(0)).cast("bigint").alias("points"))
    squads = rows.groupBy(squad).agg(F.array_sort(F.collect_list(row)).alias("x"))
    squads = squads.select(squad, F.filter("x", lambda r: r["i"] <= 11).alias("xi"), F.filter("x", lambda r: r["i"] > 11).alias("bench"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.size(F.filter("xi", lambda r: r["kind"] == k)))
    low, high = (F.array(*[F.lit(XI_BOUNDS[k][j]) for k in KINDS]) for j in (0, 1))

    def step(state: Column, starter: Column) -> Column:
        swap = lambda sub: F.transform(state["counts"], lambda n, k: n - (k == starter["kind"]).cast("int") + (k == sub["kind"]).cast("int"))
        legal = lambda c: F.forall(F.sequence(F.lit(0), F.lit(3)), lambda k: F.get(c, k).between(F.get(low, k), F.get(high, k)))
        fits = F.filter("bench", lambda sub: sub["played"] & ~F.array_contains(state["ins"], sub["i"]) & legal(swap(sub)))
        sub = F.get(fits, F.lit(0))
        stays = starter["played"] | sub["i"].isNull()
        return F.struct(
            F.when(stays, state["counts"]).otherwise(swap(sub)).alias("counts"),
            F.when(stays, state["ins"]).otherwise(F.concat(state["ins"], F.array(sub["i"]))).alias("ins"),
            (state["points"] + F.when(stays, starter["points"]).otherwise(sub["points"])).alias("points"),
        )

    start = F.struct(counts.alias("counts"), F.array().cast("array<int>").alias("ins"), F.lit(0).cast("bigint").alias("points"))
    done = squads.withColumn("s", F.aggregate("xi", start, step))
    return done.select(squad, F.size("s.ins").cast("bigint").alias("n_subs"), F.col("s.ins").alias("ins"), F.col("s.points").alias("points"))


def effective_multipliers(picks: DataFrame, squad: str, place: str, multiplier: str, captain: str, vice: str, starters: int = 11) -> DataFrame:
    """The picks that count in an ordinary week, with their multiplier: starters once, one armband twice.

    The armband is the captain's if that one starts, else the vice's, else the first doubled starter's. In a
    squad with an unknown place the stored multipliers stand, up to 2. A squad is a window of fifteen rows.
    """
    whole = Window.partitionBy(squad)
    starts = F.col(place) <= starters
    claim = F.when(starts & F.col(captain), 1).when(starts & F.col(vice), 2).when(starts & (F.col(multiplier) >= 2), 3)
    claim = F.when(claim.isNotNull(), F.struct(claim, F.col(place)))
    rows = picks.withColumns({"_claim": claim, "_best": F.min(claim).over(whole), "_unknown": F.max(F.col(place).isNull()).over(whole)})
    ordinary = F.when(starts, F.when(F.col("_claim") == F.col("_best"), 2).otherwise(1))
    stored = F.least(F.coalesce(multiplier, F.lit(0)), F.lit(2))
    out = rows.withColumn(multiplier, F.when(F.col("_unknown"), stored).otherwise(ordinary).cast("bigint"))
    return out.where(F.col(multiplier) > 0).select(*picks.columns)
