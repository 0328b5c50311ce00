"""Similarity join of texts by the Jaccard similarity of their word n-gram sets.

Texts with the same words form a class first, and only class representatives are joined. MinHash values
of a representative are banded; band and row counts follow from the wanted recall at the threshold.
Representatives meet on band hashes alone. Buckets with the same members (a pair usually shares most bands)
are joined once. The n-gram sets of those that met anybody go to their buckets, large buckets
to pairs of blocks of bounded size, where every pair is verified on the whole sets. A pair that shares several
buckets counts in the first. Out come sums per text and the parts of the link graph, never lists of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, signed, text_slices, whole_row, written

BLOCK_GRAMS, BLOCK_TEXTS = 1 << 19, 1024


def choose_bands(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """(bands, rows) of at most `most` MinHash values: the most rows at which a pair at the threshold meets with the wanted probability."""
    fit = [(r, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**r)))) for r in range(1, most + 1)]
    rows, bands = max((r, b) for r, b in fit if r * b <= most)
    return bands, rows


def grams(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram hashes, the text of each, and 128-bit digests of each text's words. A text of fewer words has one n-gram, of all its words."""
    hashes = words.hashes(0)
    values, _, owner = words.windows(hashes, width)
    n = len(words.counts)
    digests = np.zeros((n, 2), np.uint64)
    full = np.flatnonzero(words.counts)
    if len(full):
        place = (np.arange(len(hashes)) - np.repeat(words.first[:-1], words.counts)).astype(np.uint64)
        for k, h in enumerate((hashes, words.hashes(1))):
            digests[full, k] = mix(np.add.reduceat(mix(h + mix(place + np.uint64(k + 1))), words.first[:-1][full]) + words.counts[full].astype(np.uint64))
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        values, owner = np.concatenate([values, digests[short, 0]]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    return values, owner, digests


def band_hashes(values: np.ndarray, owner: np.ndarray, n: int, bands: int, rows: int) -> np.ndarray:
    """n x bands; texts without n-grams have zeros."""
    rng = np.random.default_rng(20230815)
    out = np.zeros((n, bands), np.uint64)
    have = np.unique(owner)
    if not len(have):
        return out
    starts = np.searchsorted(owner, have)
    for b in range(bands):
        folded = np.full(len(have), b + 1, np.uint64)
        for a in rng.integers(1, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1):
            x = values * a
            folded = mix(folded * np.uint64(0x9E3779B97F4A7C15) ^ np.minimum.reduceat(x ^ (x >> np.uint64(29)), starts))
        out[have, b] = folded
    return out


def _signatures(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(3)):
                words = Words(data, offsets)
                values, owner, digests = grams(words, width)
                found = band_hashes(values, owner, j - i, bands, rows)
                some = words.counts > 0
                at = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
                size = np.bincount(owner, minlength=j - i)
                part = batch.slice(i, j - i)
                yield pa.record_batch(
                    [*part.columns[:3], *(pa.array(signed(digests[:, k])) for k in range(2)), pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(signed(found[some].ravel())))],
                    ["doc_id", "h1", "h2", "c1", "c2", "n_grams", "bands"],
                )

    return run


def _gram_sets(width: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that repeat a representative's doc_id and text give its set once a task
        for batch in batches:
            new = []
            for cid in batch.column(0).to_pylist():
                new.append(cid not in seen)
                seen.add(cid)
            batch = batch if all(new) else batch.filter(pa.array(new))
            for i, j, data, offsets in text_slices(batch.column(2)):
                values, owner, _ = grams(Words(data, offsets), width)
                ends = np.searchsorted(owner, np.arange(j - i + 1))
                sets = [np.unique(values[a:b]).tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                part = batch.slice(i, j - i)
                at = part.column(1).flatten()
                canon = np.full((j - i, bands), -1, np.int64)
                canon[np.repeat(np.arange(j - i), part.column(1).value_lengths().to_numpy()), at.field("b").to_numpy()] = at.field("bid").to_numpy()
                yield pa.record_batch([part.column(0), part.column(1), pa.array([c.tobytes() for c in canon], pa.binary()), pa.array(sets, pa.binary())], ["cid", "met", "canon", "grams"])

    return run


def overlaps(sets: list[np.ndarray], at_once: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the n-grams that occur twice at least."""
    n = len(sets)
    if n == 2:
        return np.array([[len(sets[0]), k := len(np.intersect1d(*sets, assume_unique=True))], [k, len(sets[1])]], np.float32)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    again = times[place] > 1
    column = np.cumsum(times > 1) - 1
    place, owner = column[place[again]], owner[again]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    total = np.zeros((n, n), np.float32)
    for k in range(0, int(place[-1]) + 1 if len(place) else 0, at_once):
        a, b = np.searchsorted(place, [k, k + at_once])
        part = np.zeros((n, at_once), np.float32)
        part[owner[a:b], place[a:b] - k] = 1
        total += part @ part.T
    return total


def verified(by_cid: dict[int, tuple], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's block pair, rows (bid, one, two, mine, cid, canon, grams) by cid: the cids that have links, their links counted here, and the least cid of their part of the graph."""
    cids = np.array(sorted(by_cid))
    rows = [by_cid[c] for c in cids.tolist()]
    bid, one, two = rows[0][:3]
    sets = [np.frombuffer(r[6], np.uint64) for r in rows]
    both = overlaps(sets) if len(rows) > 1 else np.zeros((1, 1))
    sizes, mine = np.array([len(s) for s in sets], np.float64), np.array([r[3] for r in rows])
    found = []
    for k in range(len(rows)):  # inter >= t * (a + b - inter), a row of the matrix at a time
        like = both[k, k + 1 :].astype(float) * (1 + threshold) >= threshold * (sizes[k] + sizes[k + 1 :]) - 1e-6
        if one != two:
            like &= mine[k + 1 :] != mine[k]
        found.append(np.flatnonzero(like).astype(np.int32) + np.int32(k + 1))
    p, q = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in found]), np.concatenate(found)
    del both
    if not len(p):
        return (np.zeros(0, np.int64),) * 3
    canon = np.frombuffer(b"".join(r[5] for r in rows), np.int64).reshape(len(rows), -1)
    counted = np.zeros(len(p), bool)
    for k in range(0, len(p), 1 << 15):
        a, b = canon[p[k : k + (1 << 15)]], canon[q[k : k + (1 << 15)]]
        first = ((a == b) & (a >= 0)).argmax(1)
        counted[k : k + (1 << 15)] = a[np.arange(len(a)), first] == bid
    n_links = np.bincount(p[counted], minlength=len(rows)) + np.bincount(q[counted], minlength=len(rows))
    label = np.arange(len(rows))
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    some = np.unique(np.concatenate([p, q]))
    return cids[some], n_links[some], cids[label[some]]


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[dict[int, tuple]]:
            held: dict[int, tuple] = {}  # a text that comes twice is held once
            at = None
            for batch in batches:
                for row in (r for k in range(0, len(batch), 500) for r in zip(*(c.to_pylist() for c in batch.slice(k, 500).columns), strict=True)):
                    if held and row[:3] != at:
                        yield held
                        held = {}
                    at = row[:3]
                    held[row[4]] = row
            if held:
                yield held

        found: list[tuple] = []
        n = 0
        for group in groups():
            part = verified(group, threshold)
            if len(part[0]):
                found.append(part)
                n += len(part[0])
            if n >= 50_000:
                yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], ["cid", "links", "least"])
                found, n = [], 0
        if found:
            yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], ["cid", "links", "least"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links to (node, least node of its component) for all nodes that have a link, by large and small stars; each round is a written table."""
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now, before = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("least")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct())
        before = mark
        around = both(now)
        low = written(around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "large_low")
        large = written(around.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "small_low")
        pairs = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = written(pairs.where("u <> v").distinct(), "edges")


def _key(text: Column, doc_id: Column) -> list[Column]:
    body = F.coalesce(text, F.lit(""))
    return [doc_id.cast("long").alias("doc_id"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(11), body).alias("h2")]


def ngram_join(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.999, most_hashes: int = 256, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, n_copies, first (and h1, h2, hashes of the text).

    Two different texts are linked if the sets of their runs of `width` words (unchanged, parted by ASCII white
    space) have a Jaccard similarity of the threshold or more. n_links counts the different texts that a row's text is
    linked with, n_copies the rows with the same words; class_id is the least doc_id among all that
    links and copies connect (null only if no member has a doc_id), `first` marks the rows whose doc_id and text
    represent the class. Null, empty and blank texts are copies of each other. Shorter texts have one n-gram. Rows that repeat
    a doc_id are rows of their own; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    bands, rows = choose_bands(threshold, recall, most_hashes)
    signs = written(docs.select(*_key(F.col(text), F.col(doc_id)), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(_signatures(width, bands, rows), "doc_id long, h1 long, h2 long, c1 long, c2 long, n_grams long, bands array<long>"), "signatures")
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    classes = written(signs.groupBy("c1", "c2").agg(F.min(who).alias("who"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"), F.first("n_grams").alias("n_grams")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    banded = classes.select("cid", "n_grams", F.posexplode("bands").alias("b", "hash"))
    buckets = banded.groupBy("b", "hash").agg(F.count("*").alias("n"), F.sum("n_grams").alias("total"), F.min("cid").alias("low"), F.bit_xor(F.xxhash64("cid")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(3), "cid")).alias("x2")).where("n > 1")
    alike = buckets.groupBy("n", "total", "low", "x1", "x2").agg(F.collect_list(F.struct("b", "hash")).alias("at"))
    blocks = F.greatest(F.ceil(F.col("total") / BLOCK_GRAMS), F.ceil(F.col("n") / BLOCK_TEXTS)).cast("int")
    buckets = written(alike.select(F.monotonically_increasing_id().alias("bid"), blocks.alias("blocks"), F.explode("at").alias("a")).select("bid", "blocks", "a.*"), "buckets")
    met = written(banded.join(buckets, ["b", "hash"]).groupBy("cid").agg(F.collect_list(F.struct("b", "bid", "blocks")).alias("met")), "met")
    wanted = met.join(classes.select("cid", "who.doc_id", "who.h1", "who.h2"), "cid")
    texts = docs.select(*_key(F.col(text), F.col(doc_id)), F.coalesce(text, F.lit("")).alias("text"))
    same = F.col("w.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("w.h1") == F.col("t.h1")) & (F.col("w.h2") == F.col("t.h2"))
    sets = texts.alias("t").join(wanted.alias("w"), same).select("w.cid", "w.met", "t.text").mapInArrow(_gram_sets(width, bands), "cid long, met array<struct<b:int,bid:long,blocks:int>>, canon binary, grams binary")
    own = lambda x: F.pmod(F.xxhash64("cid"), x["blocks"]).cast("int")
    ways = F.flatten(F.transform(F.array_distinct(F.transform("met", lambda m: F.struct(m["bid"].alias("bid"), m["blocks"].alias("blocks")))), lambda x: F.transform(F.sequence(F.lit(0), x["blocks"] - 1), lambda j: F.struct(x["bid"].alias("bid"), F.least(own(x), j).alias("one"), F.greatest(own(x), j).alias("two"), own(x).alias("mine")))))
    sent = sets.select(F.explode(ways).alias("w"), "cid", "canon", "grams").select("w.*", "cid", "canon", "grams")
    parts = sent.repartition("bid", "one", "two").sortWithinPartitions("bid", "one", "two").mapInArrow(_verify(threshold), "cid long, links long, least long")
    parts = written(parts, "links")
    links = parts.groupBy("cid").agg(F.sum("links").alias("n_links"))
    roots = components(parts.select(F.col("cid").alias("u"), F.col("least").alias("v")))
    rooted = written(classes.select("cid", "c1", "c2", "who", "n_copies").join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("least", "cid")).drop("bands"), "rooted")
    tops = rooted.groupBy("root").agg(F.min("who").alias("top"))
    named = written(rooted.join(tops, "root").select("c1", "c2", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", "top"), "named")
    out = signs.select("doc_id", "h1", "h2", "c1", "c2").join(named, ["c1", "c2"])
    first = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("h1") == F.col("top.h1")) & (F.col("h2") == F.col("top.h2"))
    return out.select("doc_id", F.col("top.doc_id").alias("class_id"), "n_links", "n_copies", first.alias("first"), "h1", "h2")


def near_distinct(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of docs, one of each class: that with the least doc_id, and of rows equal in doc_id and text any one. All columns stay, whatever their names."""
    keep = ngram_join(docs, text=text, doc_id=doc_id, **how).where("first").select(F.col("doc_id").alias("d"), F.col("h1").alias("g1"), F.col("h2").alias("g2")).distinct()
    keyed = docs.select(whole_row(docs).alias("row"), *_key(F.col(text), F.col(doc_id)))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    return keyed.join(keep, same, "left_semi").dropDuplicates(["doc_id", "h1", "h2"]).select("row.*")
