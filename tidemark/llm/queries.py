"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .common import row_hash, written
from .conversation_repair import damaged, repair
from .exact_dedup import exact_dedup
from .fill_middle import fill_in_middle, restored
from .fingerprints import fingerprint_neighbours
from .line_dedup import line_dedup
from .mixing import mix_sources, n_words
from .ngram_join import ngram_join
from .packing import pack
from .repetition import quality_rules
from .substring_dedup import substring_dedup
from .token_files import read_token_files, write_token_files
from .warc import chunk_table, read_archives, roles, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the installed package of public tokenizers keeps a vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("n"), row_hash(docs).alias("h")), "sizes")
    return mix_sources(sized, size=F.col("n")).select("doc_id", "size", "source_size", "target", "taken")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1, length=2048)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_neighbours(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_table(_table(spark, sf_dir, "pages"))
    return read_archives(write_archives(chunks, roles(chunks))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_table(spark, sf_dir, "documents"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select(*base, "n_repeats", "covered_chars", "longest_chars")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return repair(damaged(turns), turns.select(F.col("conv_id").cast("long").alias("conv_id")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(_table(spark, sf_dir, "documents"))
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_mixing": op2_mixing,
    "op3_token_files": op3_token_files,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_line_dedup": op8_line_dedup,
    "op9_warc": op9_warc,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_quality_rules": op11_quality_rules,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL = {
    "op8_line_dedup": f"""
WITH split AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
lines AS (SELECT doc_id, r, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS line FROM split),
keyed AS (SELECT *, translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
flagged AS (SELECT k.*, coalesce(k.doc_id <> c.last, false) AS gone FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY r, doc_id""",
    "op9_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
g AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM g)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""",
    "op10_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op12_conversation_repair": """
WITH RECURSIVE z AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
k AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT) % 20 AS kind FROM z),
a AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM a),
f AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM o),
e AS (SELECT conv_id, i, ini, role, text, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS t FROM f),
n AS (SELECT conv_id, max(i) AS n FROM e GROUP BY 1),
c AS (SELECT conv_id, n + 1 AS i, [0, 4, 2, 0]::BIGINT[] AS c FROM n
  UNION ALL SELECT conv_id, i, [least(x[1], 2 + x[3], 4 + x[4]), least(x[2], 2 + x[3], 4 + x[4]), least(x[3], 2 + x[4]), least(x[4], 2 + x[3])]
  FROM (SELECT e.conv_id, e.i, CASE WHEN gone THEN list_transform(c.c, lambda v: v + 3) ELSE [
      least(3 + c.c[1], t + CASE ini WHEN 's' THEN c.c[2] WHEN 'u' THEN c.c[3] ELSE 999999999 END, 2 + t + c.c[3]), least(3 + c.c[2], t + CASE WHEN ini = 'u' THEN 0 ELSE 2 END + c.c[3]),
      least(3 + c.c[3], t + CASE WHEN ini = 'a' THEN 0 ELSE 2 END + c.c[4]), least(3 + c.c[4], t + CASE WHEN ini = 'u' THEN 0 ELSE 2 END + c.c[3])] END AS x
    FROM c JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.i = c.i - 1)),
p AS (SELECT c.conv_id, c.i, c.c, d.c AS after, e.ini, e.role, e.text, e.gone, e.t FROM c LEFT JOIN c d ON d.conv_id IS NOT DISTINCT FROM c.conv_id AND d.i = c.i + 1 LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.i = c.i),
w AS (SELECT conv_id, 1::BIGINT AS i, 1 AS g, '' AS audit, NULL::VARCHAR AS body, false AS over FROM n
  UNION ALL SELECT conv_id, CASE WHEN l IN ('I', '') THEN i ELSE i + 1 END, CASE WHEN l IN ('D', '') THEN g WHEN l = 'K' AND ini = 's' THEN 2 ELSE [3, 3, 4, 3][g] END, audit || l,
    CASE WHEN l IN ('D', '') THEN body ELSE concat_ws(chr(10), body, CASE WHEN l = 'K' THEN role ELSE ['user', 'user', 'assistant', 'user'][g] END || ':' || CASE WHEN l = 'I' THEN '' ELSE text END) END, l = ''
  FROM (SELECT w.*, p.ini, p.role, p.text, CASE
      WHEN p.after IS NULL THEN CASE WHEN g IN (1, 4) THEN '' ELSE 'I' END
      WHEN 3 + p.after[g] = p.c[g] THEN 'D'
      WHEN 2 + p.c[[3, 3, 4, 3][g]] = p.c[g] THEN 'I'
      WHEN NOT gone AND ((g = 1 AND ini = 's' AND t + p.after[2] = p.c[g]) OR (ini = ['u', 'u', 'a', 'u'][g] AND t + p.after[[3, 3, 4, 3][g]] = p.c[g])) THEN 'K' ELSE 'R' END AS l
    FROM w JOIN p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i WHERE NOT over)),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(p.c[1], 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM q.conv_id AND w.over LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM q.conv_id AND p.i = 1""",
    "op13_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, list_transform([0, 1, 2, 3], lambda k: CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT)) AS x FROM d),
c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS lo, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 90 THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, lo) || '<S>' || substr(t, hi + 1) || '<M>' || substr(t, lo + 1, hi - lo)
    ELSE '<S>' || substr(t, hi + 1) || '<P>' || substr(t, 1, lo) || '<M>' || substr(t, lo + 1, hi - lo) END) AS output_sha256, sha256(t) AS restored_sha256
FROM c""",
}
