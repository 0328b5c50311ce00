"""The stages on their own, each against a plain version of what it decides."""

import functools
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_dedup import plain_join, plain_lines
from test_others import plain_targets

from tidemark.llm import toxicity


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = docs.columns, [f for _, f in corpus_pipeline.STAGES]
    plain = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]
    # toxicity: exactly the rows that score under 0.5
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    out = stages[0](spark, docs, sf)
    assert out.columns == columns
    assert Counter(plain(out)) == Counter((r.doc_id, r.text, r.source) for r in toxicity.toxicity(docs, model).collect() if r.score < 0.5)
    out = corpus_pipeline.written(out, "t")
    # line dedup
    before, out = plain(out), corpus_pipeline.written(stages[1](spark, out, sf), "l")
    texts = {d: t for d, t, _ in before}
    assert out.columns == columns
    assert Counter((d, t) for d, t, _ in plain(out)) == Counter((d, None if texts[d] is None else k) for d, _, _, k in plain_lines(before))
    # one document of each class
    before, out = plain(out), corpus_pipeline.written(stages[2](spark, out, sf), "n")
    assert out.columns == columns
    assert sorted(d for d, _, _ in plain(out)) == sorted({c for _, c, _, _ in plain_join(before)})
    # mixing
    before, out = plain(out), corpus_pipeline.written(stages[3](spark, out, sf), "m")
    assert out.columns == columns
    sizes, taken = Counter(), Counter()
    for _, t, s in before:
        sizes[s] += words(t)
    for _, t, s in plain(out):
        taken[s] += words(t)
    targets = plain_targets(sizes)
    assert all(abs(taken[s] - targets[s]) <= 128 + 0.01 * targets[s] for s in sizes)
    # packing
    n = stages[4](spark, out, sf).selectExpr("count(distinct sequence_id) s", "sum(length) n").first()
    assert n.n > 0 and n.s <= 1.02 * n.n / 2048 + 8 * 12


def test_stages_leave_other_columns_alone(spark, sf):
    """Columns whose names the operators use inside come out as they went in, and text and n_chars agree."""
    names = ["size", "_size", "_shard", "_to", "n_dropped", "kept_text", "_score", "score", "row", "taken", "cuts", "target", "source_no", "id", "copy", "added", "h1", "tie", "a`b"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({n: F.concat(F.lit(f"{n} of "), "doc_id") for n in names})
    docs = docs.withColumn("n_chars", F.length("text").cast("long")).unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string")))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = corpus_pipeline.written(stage(spark, docs, sf), "kept")
        assert out.columns == docs.columns and out.count() > 0
        told = [F.col(f"`{n.replace('`', '``')}`") != F.concat(F.lit(f"{n} of "), "doc_id") for n in names]
        assert out.where(functools.reduce(lambda a, b: a | b, told)).count() == 0, name
        assert out.where("text is not null and n_chars <> length(text)").count() == 0, name


def test_empty_tables_run_through(spark, sf, tmp_path):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{table}.parquet").where("false").write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
