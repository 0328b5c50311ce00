"""Line deduplication: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, WS_CHARS, whole_row, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ("k1", "k2")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case (lower() is the quick way where all is ASCII)."""
    bare = F.trim(line, F.lit(WS_CHARS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def long_lines(text: Column, min_chars: int) -> Column:
    """Array of (k1, k2, pos) of the lines whose key has min_chars code points at least; k1 and k2 are hashes of the key."""
    keys = F.transform(F.split(text, "\n"), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("pos")))
    kept = F.filter(keys, lambda x: F.char_length(x["key"]) >= min_chars)
    return F.transform(kept, lambda x: F.struct(F.xxhash64(x["key"]).alias("k1"), F.xxhash64(F.lit(7), x["key"]).alias("k2"), x["pos"].alias("pos")))


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines at the positions of an array, in time linear in its lines: the split array is bound once."""
    kept = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    bound = F.transform(F.array(F.split(text, "\n")), lambda lines: F.array_join(F.transform(kept(lines), lambda i: F.get(lines, i)), "\n"))
    return F.get(bound, F.lit(0))


def line_dedup(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs with kept_text, n_lines and n_dropped added (columns of those names are replaced, all others stay).

    A key of at least min_chars code points found in at least min_docs documents (different doc_ids) loses all its
    lines except in the largest doc_id that holds it. Null text is one empty line. Rows that repeat a doc_id count
    as one document, and those with the largest all keep the line. Rows without a doc_id count for nothing and keep all
    lines. An empty table gives no rows. Counts are of all documents, a key's documents first told apart and
    then added up, so no task gets a key whole. Lines of keys in more than 1/HOT_KEYS of all lines (at most HOT_KEYS
    such) are resolved by a broadcast of those keys, others by a shuffle of 128-bit hashes.
    """
    rows = docs.select(
        whole_row(docs).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"), F.col(doc_id).cast("long").alias("id")
    ).withColumn("h", F.xxhash64("id", "body"))
    lines = written(
        rows.where("id IS NOT NULL").select("id", "h", F.explode(long_lines(F.col("body"), min_chars)).alias("l")).select("id", "h", "l.*"), "lines"
    )
    by_doc = lines.groupBy(*KEY, "id").agg(F.count("*").alias("n"))
    common = by_doc.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("id").alias("last"), F.sum("n").alias("n_lines"))
    common = written(common.where(F.col("n_docs") >= min_docs), "common_lines")
    hot = F.broadcast(common.where(F.col("n_lines") * HOT_KEYS > lines.count()).select(*KEY, "last"))
    rest = lines.join(hot.select(*KEY), [*KEY], "left_anti").join(common.select(*KEY, "last"), [*KEY])
    gone = lines.join(hot, [*KEY]).unionByName(rest).where("id < last").groupBy("id", "h").agg(F.collect_set("pos").alias("gone"))
    joined = rows.join(gone, ["id", "h"], "left")
    added = {
        "kept_text": F.when(F.col("gone").isNull(), F.col("body")).otherwise(without_lines(F.col("body"), F.col("gone"))),
        "n_lines": F.size(F.split("body", "\n")).cast("long"),
        "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
    }
    found = joined.select("row", F.struct(*[c.alias(n) for n, c in added.items()]).alias("added"))
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in added], "added.*")
