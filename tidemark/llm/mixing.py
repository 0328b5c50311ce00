"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, then seeded block selection.

Targets are levelled by weight under a cap per source. Blocks of equal length go to sources, and a
source's blocks to its shards, by the highest quotients votes / (2k + 1). A shard's documents stand
end to end in seeded order, so its blocks are a random cut of it; the quota is a cyclic run of blocks
from a seeded one. Documents stay whole but for the two where the run begins and ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, row_hash, running, whole_row, written

ADDED = ("size", "source_size", "target", "taken", "whole", "cuts")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Adds source_no, weight and target to (source, source_size): share times all words split by weight, none above most times its size.

    Sources count by code point, null last. In order of cap / weight, all before some place are at their
    cap, and the level there settles the rest, so the repeated resharing has a closed form. Running sums go by ranges of
    sources, so there may be as many as there are sites.
    """
    named = running(totals, [F.col("source").isNull(), F.col("source")], {"source_no": F.lit(1)}, "source_numbers")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    named = named.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = named.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    by_fill = [F.col("cap") / F.col("weight"), F.col("source_no")]
    ranked = running(named, by_fill, {"place": F.lit(1), "caps": F.col("cap"), "weights": F.col("weight")}, "source_levels")
    full, left = F.col("caps") - F.col("cap"), F.lit(everything["weight"] or 0) - F.col("weights") + F.col("weight")
    levels = ranked.withColumn("level", (F.lit(float((everything["size"] or 0) * share)) - full) / left)
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = levels.agg(F.min_by("level", F.when(fits, F.col("place")))).first()[0]
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return named.withColumn("target", target).select("source", "source_size", "source_no", "weight", "target")


def sainte_lague(parties: DataFrame, votes: str, seats: Column, by: Sequence[str], party: str) -> DataFrame:
    """Adds `quota`: the seats of each party within its group `by` (seats is the group's number), ties to the lower party.

    For the divisor that settles a group of n parties, the rounded quotients sum to the seats, so it gives the
    parties within n / 2 of as many seats before rounding, and each its part of that. Only the quotients in
    that interval are compared, some four a party, ranked by ranges of all groups' quotients.
    """
    groups = parties.groupBy(*by).agg(F.sum(votes).alias("_all"), F.count("*").alias("_n"))
    shares = parties.withColumn("_seats", seats).join(groups, [*by])
    part = F.when(F.col("_all") > 0, F.col(votes) / F.col("_all")).otherwise(0.0)
    reach = part * F.col("_n") / 2 + 0.5 + 1e-6
    lo, hi = F.greatest(F.lit(0), F.floor(part * F.col("_seats") - reach)), F.ceil(part * F.col("_seats") + reach)
    shares = written(shares.withColumn("_lo", F.when(F.col(votes) > 0, lo).otherwise(0).cast("long")).withColumn("_hi", hi.cast("long")), "shares")
    quotients = shares.where(F.col(votes) > 0).select(*by, party, F.col(votes).alias("_v"), F.explode(F.sequence("_lo", "_hi")).alias("_k"))
    best = [*map(F.col, by), F.desc(F.col("_v") / (2 * F.col("_k") + 1)), F.col(party), F.col("_k")]
    ranked = written(running(quotients, best, {"_place": F.lit(1)}, "quotients"), "places")
    given = shares.groupBy(*by).agg((F.first("_seats") - F.sum("_lo")).alias("_open"))
    limits = ranked.groupBy(*by).agg(F.min("_place").alias("_first")).join(given, [*by])
    won = ranked.join(limits, [*by]).where(F.col("_place") - F.col("_first") < F.col("_open")).groupBy(*by, party).agg(F.count("*").alias("_won"))
    return shares.join(won, [*by, party], "left").withColumn("quota", F.col("_lo") + F.coalesce("_won", F.lit(0))).select(*parties.columns, "quota")


def _mixed(docs: DataFrame, weights: Sequence[int], share: float, most: float, block: int, seed: int, shard_words: int, size: Column | None, text: str, doc_id: str, source: str) -> DataFrame:
    """(row, size, source_size, target, taken, whole, cuts): row holds all columns of docs, so none of them can clash with those made here."""
    size = n_words(F.col(text)) if size is None else size
    tie = row_hash(docs)
    who = F.xxhash64(F.lit(seed), F.col(doc_id), tie)
    base = docs.select(whole_row(docs).alias("row"), size.alias("size"), F.col(doc_id).alias("id"), tie.alias("tie"), who.alias("who"), F.col(source).alias("source"))
    order = [F.xxhash64(F.lit(seed + 1), "id", "tie"), F.col("id"), F.col("size"), F.col("tie")]
    totals = written(base.groupBy("source").agg(F.sum("size").alias("source_size")), "source_sizes")
    words = written(source_targets(totals, weights, share, most), "source_targets")
    blocks = int((words.agg(F.sum("target")).first()[0] or 0) // block)
    sources = sainte_lague(words.withColumn("_one", F.lit(0)), "target", F.lit(blocks).cast("long"), ["_one"], "source_no").drop("_one").withColumnRenamed("quota", "blocks")
    n_shards = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("source_size") / F.lit(shard_words), F.lit(1.0))))).cast("long")
    known = written(sources.select(F.col("source").alias("of"), "source_size", "target", n_shards.alias("n_shards"), "source_no", "blocks"), "sources")
    dealt = base.join(known.drop("blocks"), F.col("source").eqNullSafe(F.col("of")), "left").withColumn("shard", F.pmod("who", "n_shards")).drop("of", "n_shards", "who", "source")
    shards = dealt.groupBy("source_no", "shard").agg(F.sum("size").alias("shard_size"))
    shards = sainte_lague(shards.join(known.select("source_no", "blocks"), "source_no"), "shard_size", F.col("blocks"), ["source_no"], "shard")
    shards = shards.withColumn("words", F.least(F.col("quota") * block, (F.col("shard_size") * F.lit(most)).cast("long")))
    passes = [F.when(F.col("shard_size") > 0, x).otherwise(0) for x in (F.expr("words div shard_size"), F.col("words") % F.col("shard_size"))]
    begin = F.pmod(F.xxhash64(F.lit(seed), "source_no", "shard"), F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block))) * block
    plan = written(shards.select("source_no", "shard", "shard_size", passes[0].alias("passes"), passes[1].alias("rest"), begin.alias("begin")), "shards")
    run = Window.partitionBy("source_no", "shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("upto", F.sum("size").over(run)).join(plan, ["source_no", "shard"], "left")
    at, end = F.col("upto") - F.col("size"), F.col("begin") + F.col("rest")

    def cut(lo: Column, hi: Column) -> Column:
        return F.struct((F.greatest(at, lo) - at).alias("from"), (F.least(F.col("upto"), hi) - at).alias("to"))

    cuts = F.filter(F.array(cut(F.col("begin"), F.least(end, F.col("shard_size"))), cut(F.lit(0), end - F.col("shard_size"))), lambda x: x["from"] < x["to"])
    out = placed.withColumn("cuts", cuts).withColumn("whole", F.col("passes").cast("long"))
    taken = F.aggregate("cuts", F.col("whole") * F.col("size"), lambda a, x: a + x["to"] - x["from"])
    return out.withColumn("taken", taken).select("row", *ADDED)


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 64, seed: int = 17,
    shard_words: int = 1 << 20, size: Column | None = None, text: str = "text", doc_id: str = "doc_id", source: str = "source",
) -> DataFrame:
    """The rows of docs with size, source_size, target, taken, whole and cuts added (columns of those names are replaced).

    taken counts the words the mix takes from the document, repeats included: `whole` passes over all of
    it, and in `cuts` the ranges (from, to) of its words that a further pass takes. size: the column's own
    word counts, if known; otherwise words of `text`. Null and empty texts have size 0 and are never
    taken; a null source is a source of its own, the last. Rows that repeat a doc_id are documents of their own, dealt and ordered by a hash of
    all their values too, so reruns agree whatever order rows come in; an
    empty table gives no rows. A source has a shard for each shard_words of its words (to a power of two), and running sums
    go by shard, so no task holds more of a source however large it is, or however many rows have no doc_id.
    """
    found = _mixed(docs, weights, share, most, block, seed, shard_words, size, text, doc_id, source)
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ADDED], *ADDED)


def mixed_documents(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 64, seed: int = 17,
    shard_words: int = 1 << 20, text: str = "text", doc_id: str = "doc_id", source: str = "source",
) -> DataFrame:
    """The mix itself, in the columns of docs: each document as often as it is taken whole, and where it is cut, the words of the cut joined by spaces (n_chars follows, other columns stay as they are).

    Null and empty texts, of which no word can be taken, are left out; an empty table gives no rows.
    """
    mixed = _mixed(docs, weights, share, most, block, seed, shard_words, None, text, doc_id, source)
    body = F.col("row").getField(text)
    words = lambda x: F.array_join(F.slice(F.regexp_extract_all(body, F.lit(f"({WORD})"), 1), (x["from"] + 1).cast("int"), (x["to"] - x["from"]).cast("int")), " ")
    uncut = lambda x: (x["from"] == 0) & (x["to"] == F.col("size"))
    copies = F.concat(F.array_repeat(body, F.col("whole").cast("int")), F.transform("cuts", lambda x: F.when(uncut(x), body).otherwise(words(x))))
    out = mixed.where("taken > 0").select("row", F.explode(copies).alias("copy"))
    new = {text: F.col("copy")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("copy") == body, F.col("row").getField("n_chars")).otherwise(F.char_length("copy").cast("long"))
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
