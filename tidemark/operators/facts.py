"""What a text says and its facts don't: numbers and capitalised names, token by token."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = r"[ \t\n\r\f\x0b]+"
#: A number: a sign or none, digits, and at most one part of decimals after a point or comma.
SIGNS, POINTS = "-+−", ".,"
NUMBER = f"[{SIGNS}]?[0-9]+(?:[{POINTS}][0-9]+)?"
#: What stands around a word: all that is neither letter nor digit.
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def normalised_number(found: Column) -> Column:
    """A plain minus, a point for the decimals, no plus."""
    return F.ltrim(F.translate(found, "−,", "-."), F.lit("+"))


def clean_word(word: Column) -> Column:
    """Without what stands around it, and then without a possessive s."""
    return F.regexp_replace(F.regexp_replace(word, EDGES, ""), "['’]s$", "")


def calendar_names(spark: SparkSession) -> DataFrame:
    """(token): the names of months and weekdays, which are capitalised but name nobody."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int") * 31)
    months = spark.range(12).select(F.date_format(day, "MMMM").alias("token"))
    return months.unionByName(spark.range(7).select(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "EEEE").alias("token")))


def tokens(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, sentence, kind, token, opener): each number and word of each sentence, from 1; opener is a sentence's first word."""
    whole = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), rf"^{BLANK}|{BLANK}$", "")
    sentences = df.select(*keys, F.posexplode(F.split(whole, rf"(?<=[.!?]){BLANK}")).alias("_n", "_sentence"))
    numbers = F.transform(F.regexp_extract_all("_sentence", F.lit(NUMBER), 0), lambda x: F.struct(F.lit("number").alias("kind"), normalised_number(x).alias("token"), F.lit(False).alias("opener")))
    words = F.transform(F.split("_sentence", BLANK), lambda w, i: F.struct(F.lit("name").alias("kind"), clean_word(w).alias("token"), (i == 0).alias("opener")))
    return sentences.select(*keys, (F.col("_n") + 1).cast("bigint").alias("sentence"), F.explode(F.concat(numbers, words)).alias("_t")).select(*keys, "sentence", "_t.*").where("token <> ''")


def offences(facts: DataFrame, prose: DataFrame, by: str, turn: str, text: str, allow: DataFrame | None = None, codes: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """(by, turn, sentence, kind, token, n): numbers and capitalised words of the prose that no fact with the same `by` has.

    A number is told if the facts have it as it is or without its minus. A sentence's first word is a name only if `known`
    (name) has it. The caller's `allow` (token) and words that match the pattern `codes` are never names. Tokens meet in equi-joins, so no pair of texts is ever formed.
    """
    told = tokens(facts, [by], text).select(F.col(by).alias("_by"), F.col("kind").alias("_kind"), F.col("token").alias("_token")).distinct()
    said = tokens(prose, [by, turn], text).groupBy(by, turn, "sentence", "kind", "token", "opener").agg(F.count(F.lit(1)).alias("n"))
    numbers = said.where("kind = 'number'")
    names = said.where((F.col("kind") == "name") & ~F.col("opener") & F.col("token").rlike(r"^\p{Lu}"))
    names = names if codes is None else names.where(~F.col("token").rlike(codes))
    if known is not None:
        names = names.unionByName(said.where((F.col("kind") == "name") & F.col("opener")).join(known.select(F.col("name").alias("token")).distinct(), "token", "left_semi"))
    names = names if allow is None else names.join(allow.select("token"), "token", "left_anti").select(*said.columns)
    same = lambda token: F.col(by).eqNullSafe(F.col("_by")) & (F.col("kind") == F.col("_kind")) & (token == F.col("_token"))
    left = numbers.unionByName(names).join(told, same(F.col("token")), "left_anti")
    left = left.join(told, same(F.when(F.col("kind") == "number", F.ltrim("token", F.lit("-"))).otherwise(F.col("token"))), "left_anti")
    return left.groupBy(by, turn, "sentence", "kind", "token").agg(F.sum("n").alias("n"))
