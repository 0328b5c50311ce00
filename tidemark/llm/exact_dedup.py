"""Exact deduplication with a heavy-hitter split.

Misra-Gries counters find digests that may be frequent; an exact count keeps those above
1/HOT_KEYS of all rows (so at most HOT_KEYS of them), which are broadcast and resolved map-side.
No other digest holds more than that share, and these meet in an ordinary shuffle of digests.
Only digests move, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, WS, frequent, written


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", " ")


def first_of_equals(rows: DataFrame) -> DataFrame:
    """Adds group_size and `first` (none, doc_id, row: the least of the group, null doc_ids last) to a written table with doc_id, row, digest and h, a 64-bit hash of the digest."""
    n = rows.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    maybe = frequent(rows, "h", n)
    winners = (
        rows.join(F.broadcast(maybe), "h", "left_semi")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), first)
        .where(F.col("group_size") * HOT_KEYS > n)
    )
    winners = written(winners, "winners")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.count("*").alias("group_size"), first)
    return rows.join(F.broadcast(winners), "digest").unionByName(rest.join(groups, "digest"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised texts, the one with the smallest doc_id stays (a null doc_id
    comes last; of repeated doc_ids one row stays). Null and empty texts are equal. Other
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    rows = written(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"),
        ).withColumn("h", F.xxhash64("digest")),
        "digests",
    )
    return first_of_equals(rows).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
