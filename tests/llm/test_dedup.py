"""Exact, line, n-gram and substring deduplication against plain versions."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.ngram_join import choose_bands, near_distinct, ngram_join, verified
from tidemark.llm.substring_dedup import substring_dedup

LAST = 2**63 - 1
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
null_last = lambda d: (d is None, d or 0)


def test_pairs_at_the_threshold_itself_are_links():
    """Sets of 4 in 5 alike, of all sizes: the counts are 32-bit floats, in which 1.8 times a count falls below 0.8 times the sizes' sum now and then."""
    for k in [*range(1, 120), 270, 1001, 40_001]:
        union = np.arange(5 * k, dtype=np.uint64)
        a, b, c = union[: 4 * k + k // 2], np.concatenate([union[: 4 * k], union[4 * k + k // 2 :]]), np.concatenate([union[: 4 * k - 1], union[4 * k + k // 2 :], union[-1:] + np.uint64(1)])
        near = {i: (0, 0, 0, 0, i, bytes(8), x.tobytes()) for i, x in enumerate((a, b))}
        assert verified(near, 0.8)[1].sum() == 2, k
        far = {i: (0, 0, 0, 0, i, bytes(8), x.tobytes()) for i, x in enumerate((a, c))}
        assert len(np.intersect1d(a, c)) * 5 < 4 * len(np.union1d(a, c)) and verified(far, 0.8)[1].sum() == 0, k


def test_exact_dedup(rows, docs, empty):
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    want = Counter((d, min(g, key=null_last), len(g), sha(t)) for t, g in groups.items() for d in g)
    got = exact_dedup(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_hot_group(spark):
    n = 5000
    df = spark.range(n).selectExpr("id doc_id", "CASE WHEN id % 3 = 0 THEN 'hot  text' ELSE concat('t', id % 1500) END text")
    got = {(r.keep_id, r.group_size) for r in exact_dedup(df).where("doc_id % 3 = 0").collect()}
    assert got == {(0, (n + 2) // 3)}


def plain_lines(rows, least=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(list)
    for d, t, _ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(d)
    ids = {k: {d for d in v if d is not None} for k, v in holders.items()}
    gone = {k: max(v) for k, v in ids.items() if len(v) >= least}
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or d == gone.get(key(x), d)]
        yield d, len(lines), len(lines) - len(kept), "\n".join(kept)


def test_line_dedup(rows, docs, empty):
    want = Counter(plain_lines(rows))
    got = line_dedup(docs)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == want
    assert sum(n for (_, _, n, _) in want) > 0
    assert set(got.columns) == {*docs.columns, "n_lines", "n_dropped"}
    assert line_dedup(empty).count() == 0


def test_line_dedup_counts_doc_ids_not_rows(spark):
    line = "a line that is long enough to be looked at by the operator"
    df = lambda ids: spark.createDataFrame([(d, line, 1, "x", 2) for d in ids], "doc_id long, text string, h int, row string, gone int")
    got = line_dedup(df([1, 1, 1, 2, 2, None, None, None])).collect()
    assert not any(r.n_dropped for r in got)
    got = line_dedup(df([1, 1, 2, 3, 4, 5, 5, None, -(2**63)])).collect()
    assert Counter((r.doc_id, r.n_dropped, r.row, r.h, r.gone) for r in got) == Counter((d, int(d is not None and d != 5), "x", 1, 2) for d in [1, 1, 2, 3, 4, 5, 5, None, -(2**63)])


def test_line_dedup_is_linear_in_the_lines_of_a_text(spark):
    shared = [f"line {i} of a very long text, and it is shared by all of the documents" for i in range(100_000)]
    rows = [(d, "\n".join(x for i in range(100_000) for x in (shared[i], f"{d} {i}"))) for d in range(5)]
    start = time.monotonic()
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.n) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("doc_id", "n_lines", "n_dropped", "length(kept_text) n").collect()}
    assert got == {d: (200_000, 100_000 * (d < 4), len("\n".join(f"{d} {i}" for i in range(100_000))) if d < 4 else len(rows[4][1])) for d in range(5)}
    assert time.monotonic() - start < 60


def test_line_dedup_hot_line(spark):
    line = "This very common line stands in a third of all of the documents"
    df = spark.range(3000).selectExpr("id doc_id", f"CASE WHEN id % 3 = 0 THEN '{line}' ELSE concat('own line with enough letters in it to count as one, number ', id) END text")
    got = {r.doc_id: r.n_dropped for r in line_dedup(df).where("doc_id % 3 = 0").collect()}
    assert sum(got.values()) == 999 and got[2997] == 0


def plain_join(rows, threshold=0.8, width=5):
    words = lambda t: tuple(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    texts = defaultdict(list)
    for d, t, _ in rows:
        texts[words(t)].append(d)
    keys = list(texts)
    sets = [{w[i : i + width] for i in range(max(1, len(w) - width + 1))} if w else set() for w in keys]
    root, links = list(range(len(keys))), [0] * len(keys)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i, k in enumerate(keys):
        members[find(i)] += texts[k]
    return Counter((d, min(members[find(i)], key=null_last), links[i], len(texts[k])) for i, k in enumerate(keys) for d in texts[k])


def test_ngram_join(rows, docs, empty):
    want = plain_join(rows)
    assert sum(k[2] for k in want) > 10
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngram_join(docs).collect()) == want
    assert ngram_join(empty).count() == 0
    kept = near_distinct(docs)
    classes = {k[1] for k in want if k[1] is not None}
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {d for d in ids if d is not None} == classes and ids.count(None) == len({1 for k in want if k[1] is None})


def test_ngram_join_blocks(spark, monkeypatch):
    """A bucket of many near copies is verified in several blocks and loses no link."""
    from tidemark.llm import ngram_join as module

    monkeypatch.setattr(module, "BLOCK_TEXTS", 16)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*base[:k], f"other{k}", *base[k + 1 :]]), "s") for k in range(70)]
    df = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngram_join(df).collect()) == plain_join(rows)


def test_bands_reach_recall():
    for t in (0.7, 0.8, 0.9):
        b, r = choose_bands(t, 0.999, 256)
        assert b * r <= 256 and 1 - (1 - t**r) ** b >= 0.999


def plain_substring(rows, width=13):
    first = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows]
    for d, w in split:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, LAST), LAST if d is None else d)
    for d, w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (LAST if d is None else d):
                gone |= set(range(i, i + width))
        yield d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("small", [False, True])
def test_substring_dedup(rows, docs, empty, monkeypatch, small):
    from tidemark.llm import substring_dedup as module

    if small:
        monkeypatch.setattr(module, "BLOCK_BYTES", 4000)
        monkeypatch.setattr(module, "TASK_BYTES", 20_000)
        monkeypatch.setattr(module, "RANGE_BYTES", 20_000)
    want = Counter(plain_substring(rows))
    assert sum(k[2] for k in want) > 100
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs).collect()) == want
    assert substring_dedup(empty).count() == 0


def test_ngram_join_hot_repeated_rows(spark):
    """Rows that repeat a representative's doc_id and text are one text."""
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base), "s")] * 300 + [(2, " ".join([*base[:59], "x"]), "s"), (None, " ".join([*base[:58], "y", "z"]), "s")]
    df = spark.createDataFrame([(d, t, 1, "c") for d, t, _ in rows], "doc_id long, text string, h1 int, _k1 string").repartition(5)
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngram_join(df).collect()) == plain_join(rows)
    kept = near_distinct(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, " ".join(base), 1, "c")]


def test_automata_of_reference_shards(spark, rows, docs):
    """Spans of all shards together cover what the substring query removes."""
    from pyspark.sql import functions as F

    from tidemark.llm.automaton import matched_spans

    numbered = [(i, d, t) for i, (d, t, _) in enumerate(r for r in rows if r[0] is not None)]
    df = spark.createDataFrame(numbered, "row long, doc_id long, text string")
    spans = defaultdict(set)
    for r in matched_spans(df, df, 13, 20_000, owner="doc_id").collect():
        spans[r["row"]] |= set(range(r["from"], r["to"]))
    want = Counter((d, n) for d, _, n, _ in plain_substring([(d, t, None) for _, d, t in numbered]))
    assert Counter((d, len(spans[i])) for i, d, _ in numbered) == want
    whole = matched_spans(df, df.where("doc_id = 901"), 13).count()
    assert whole == 0


def test_ranges_take_time_by_keys():
    from tidemark.llm import substring_dedup as module

    keys = np.unique(np.random.default_rng(0).integers(0, 2**64, 5000, dtype=np.uint64))
    for n in (1, 7, 10**6):
        of, at = module._ranges(keys, n)
        assert [int(k) * n >> 64 for k in keys] == np.repeat(of, np.diff(at)).tolist() or all(abs((int(k) * n >> 64) - r) <= 1 for k, r in zip(keys, np.repeat(of, np.diff(at))))
        assert len(of) == len(set(of.tolist())) <= n
    assert module._bits(None, module._ranges(keys[:0], 5)).size == 0
