"""Seeded samples without replacement: the least hashes of a key's rows, so the same rows whatever the partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranked


def draw(seed: int, *parts: Column | str) -> Column:
    """A hash of the seed and the parts, as text in order; nulls are a part of their own."""
    shown = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("~")) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *shown).cast("binary"))


def sample(df: DataFrame, by: Sequence[str], keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """n rows of each group `by`, or all of a smaller one, every choice as likely: those with the least hash of seed and keys.

    keys tell the rows of a group apart; of rows equal in them any may come. The limit on the rank is applied before rows are
    shuffled too, so a task sends n rows a group at most and a hot group is never gathered.
    """
    order = Window.partitionBy(*by).orderBy("_draw", *keys)
    return df.withColumn("_draw", draw(seed, *by, *keys)).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n).drop("_draw", "_place")


def sampled_slots(df: DataFrame, order: Sequence[str], key: str, n: int, seed: int, page_size: int) -> DataFrame:
    """(page, slot, key): n places of the whole (ascending) order, from page 1 and slot 0, drawn by their number alone, and who stands there.

    Ranks go by ranges of the order; the n least draws are merged from each task's.
    """
    placed = ranked(df.select(*order, key), [], [*map(F.col, order), F.col(key)], "_rank")
    rows = placed.select(key, (F.floor((F.col("_rank") - 1) / page_size) + 1).cast("bigint").alias("page"), ((F.col("_rank") - 1) % page_size).cast("bigint").alias("slot"))
    return rows.withColumn("_draw", draw(seed, "page", "slot")).orderBy("_draw", "page", "slot").limit(n).select("page", "slot", key)
