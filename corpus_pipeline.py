"""A training corpus from the documents table: five stages, each written as Parquet and read again by the next.

toxicity        documents that score 0.5 or more go
line dedup      lines found in many documents go, except in the last document that holds them
n-gram join     of documents linked by near equality one stays
mixing          sources are brought to their target weights, documents repeated or left out
packing         what is left becomes sequences of at most 2048 token ids
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import toxicity
from tidemark.llm.common import whole_row, written
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.ngram_join import near_distinct
from tidemark.llm.packing import pack
from tidemark.llm.queries import tokenizer_file


def changed(rows: DataFrame, columns: list[str], new: dict[str, Column]) -> DataFrame:
    """The columns of rows.row, in their order, some of them anew; others keep whatever they hold."""
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of the stage's own documents and keeps the rows that score under 0.5, unchanged.

    Null and empty texts are scored as texts without a match; rows that repeat a doc_id or a text are scored each for itself, alike. Without
    labels of both kinds listed words decide. An empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select(whole_row(docs).alias("row"), F.col("text"))
    return changed(toxicity.toxicity(rows, toxicity.train(docs, labels)).where("score < 0.5"), docs.columns, {})


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text without the lines that go and n_chars to match; null texts stay null, a text that loses nothing is unchanged.

    A line stays in all rows of the largest doc_id that holds it; rows without a doc_id keep theirs. An empty table gives no rows.
    """
    kept = line_dedup(docs.select(whole_row(docs).alias("row"), F.col("doc_id"), F.col("text")))
    new = {"text": F.when(F.col("text").isNotNull(), F.col("kept_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length(new["text"]).cast("long")).otherwise(F.col("row").getField("n_chars"))
    return changed(kept, docs.columns, new)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the least doc_id (null last), of each class of the similarity join, unchanged.

    Null, empty and blank texts are one class. Of rows equal in doc_id and text any one stays. An empty table gives no rows.
    """
    return near_distinct(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; where it takes a part of one, that part's words, with n_chars to match.

    A null source is one of its own; null and empty texts have nothing to take and go. Rows that repeat a doc_id are documents of their own, and
    a rerun takes the same of each. An empty table gives no rows.
    """
    return mixed_documents(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in their sequences.

    Null and empty texts are their end id alone, a null doc_id stays null, rows that repeat a doc_id are packed each
    for itself. An empty table gives no rows.
    """
    return pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, length=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("n-gram join", drop_near_copies),
    ("mixing", mix),
    ("packing", pack_tokens),
]

#: The first and the last stage are beyond SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "_"))
    return docs
