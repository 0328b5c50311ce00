"""Context-triggered piecewise hashing.

A hash of the last eight bytes, rolled along the text, ends a chunk wherever its low bits are zero. The block
size is the power of two at which the chunk count comes nearest to WANTED; each chunk gives one of 64
characters, at that block size and at twice that. Signatures at the same block size are compared by edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _BYTE, _powers, dealt_by_id, mix, written

WANTED = 48
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
SLICE = 1 << 19
PAIR = "doc_id long, n_chars long, edited_sha256 string, k int, s1 string, s2 string, ek int, e1 string, e2 string, nk int, n1 string, n2 string"


def fingerprints(texts: list[bytes]) -> list[tuple[int, str, str]]:
    """(k, signature at block size 2**k, signature at 2**(k + 1)) of each text; equal texts have equal ones."""
    out: list[tuple[int, str, str]] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= SLICE):
            size += len(texts[j])
            j += 1
        out += _slice(texts[i:j])
        i = j
    return out


def _slice(texts: list[bytes]) -> list[tuple[int, str, str]]:
    sizes = np.array([len(t) for t in texts])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    n, total = len(texts), int(offsets[-1])
    if not total:
        return [(0, "", "")] * n
    raw = b"".join(texts)
    data = np.frombuffer(raw, np.uint8)
    level = np.zeros(total, np.int8) - 1  # -1: no whole window of this text ends here
    if total >= 8:
        window = mix(np.ndarray((total - 7,), "<u8", raw, strides=(1,)).astype(np.uint64))
        level[7:] = np.bitwise_count(~window & (window - np.uint64(1)))
    for k in range(7):
        heads = offsets[:-1][sizes > k] + k
        level[heads] = -1
    owner = np.repeat(np.arange(n), sizes)
    some = level >= 0
    counts = np.bincount(owner[some] * 66 + level[some], minlength=n * 66).reshape(n, 66)
    counts = counts[:, ::-1].cumsum(1)[:, ::-1]
    best = np.abs(np.log((counts + 1) / (WANTED + 1))).argmin(1)
    ups, downs = _powers(total + 1, 0)
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(_BYTE[0][data] * ups[:total], out=sums[1:])
    found = []
    for more in range(2):
        ends = level >= (best + more).astype(np.int8)[owner]
        ends[offsets[1:][sizes > 0] - 1] = True
        ends = np.flatnonzero(ends) + 1
        starts = np.concatenate([[0], ends[:-1]])
        letters = ALPHABET[(mix((sums[ends] - sums[starts]) * downs[starts]) & np.uint64(63)).astype(np.int64)].tobytes().decode()
        cut = np.searchsorted(ends, offsets, "right").tolist()
        found.append([letters[a:b] for a, b in zip(cut, cut[1:], strict=False)])
    return list(zip(best.tolist(), *found, strict=True))


def likeness(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """0 to 1: the best over block sizes that both have of 1 - edit distance / longer length; 0 if there is none."""

    def near(x: Column, y: Column) -> Column:
        longer = F.greatest(F.length(x), F.length(y))
        return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(x, y) / longer)

    (ka, a1, a2), (kb, b1, b2) = a, b
    return F.when(ka == kb, F.greatest(near(a1, b1), near(a2, b2))).when(ka == kb + 1, near(a1, b2)).when(kb == ka + 1, near(a2, b1)).otherwise(0.0)


def _pairs(docs: list[tuple[int | None, str]], follows: list[str]) -> pa.RecordBatch:
    """Rows of PAIR for documents and the texts that follow them."""
    edited = [t[: len(t) - len(t) // 4] + nxt[: len(t) // 4] for (_, t), nxt in zip(docs, follows, strict=True)]
    edited_bytes = [t.encode("utf-8", "surrogatepass") for t in edited]
    n = len(docs)
    all_of = fingerprints([t.encode("utf-8", "surrogatepass") for t in [*(t for _, t in docs), *follows]] + edited_bytes)
    columns = [[d for d, _ in docs], [len(t) for _, t in docs], [hashlib.sha256(t).hexdigest() for t in edited_bytes]]
    for part in (all_of[:n], all_of[2 * n :], all_of[n : 2 * n]):
        columns += [list(x) for x in zip(*part, strict=True)]
    kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int32(), pa.string(), pa.string()] * 3]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PAIR.split(", ")])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted documents of a partition: PAIR of all but the last, then the first and the last document in columns of their own."""
    edge = pa.schema([("first_id", pa.int64()), ("first_h", pa.int64()), ("first_place", pa.int64()), ("first_text", pa.string()), ("last_id", pa.int64()), ("last_text", pa.string())])
    names = [x.split()[0] for x in PAIR.split(", ")]
    first, held, size = None, [], 0

    def rows() -> pa.RecordBatch:
        part = _pairs([d[:2] for d in held[:-1]], [d[1] for d in held[1:]])
        return pa.record_batch([*part.columns, *(pa.nulls(part.num_rows, f.type) for f in edge), pa.array([False] * part.num_rows)], [*names, *edge.names, "edge"])

    for batch in batches:
        for doc in (d for k in range(0, len(batch), 200) for d in zip(*(c.to_pylist() for c in batch.slice(k, 200).columns), strict=True)):
            first = first or doc
            held.append(doc)
            size += len(doc[1]) + 64
            if size >= SLICE // 4 and len(held) > 1:
                yield rows()
                held, size = held[-1:], len(held[-1][1]) + 64
    if len(held) > 1:
        yield rows()
    if first:
        schema = pa.schema([(n, k) for n, k in zip(names, [pa.int64(), pa.int64(), pa.string(), *[pa.int32(), pa.string(), pa.string()] * 3], strict=True)])
        yield pa.record_batch([*(pa.nulls(1, f.type) for f in schema), *(pa.array([x], f.type) for x, f in zip((first[0], *first[2:], first[1], *held[-1][:2]), edge, strict=True)), pa.array([True])], [*names, *edge.names, "edge"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, follows = (c.to_pylist() for c in batch.columns)
        for k in range(len(ids)):
            yield _pairs([(ids[k], texts[k])], [follows[k]])


def fingerprint_neighbours(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint, near_edited, near_next.

    Order is ascending doc_id, null first, repeated ids by a hash of the text; the first document follows the
    last. The edited text is the text with its last quarter of code points (rounded down) replaced by as many
    from the start of the next text, or by all of that. Null texts are empty. A document alone follows itself.
    Texts move once, sorted into ranges, which part the rows of an id too; only the two documents at each range's ends meet again.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    edge = "first_id long, first_h long, first_place long, first_text string, last_id long, last_text string, edge boolean"
    found = written(dealt_by_id(rows).mapInArrow(_in_order, f"{PAIR}, {edge}"), "neighbours")
    ends = found.where("edge")
    first = [F.col(c) for c in ("first_h", "first_place")]
    ranked = written(ends.select("first_id", *first).withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_first("first_id"), *first))), "ranges")  # a row a range
    n = ranked.count()
    same = F.col("first_id").eqNullSafe(F.col("_i")) & (F.col("first_h") == F.col("_h")) & (F.col("first_place") == F.col("_p"))
    numbered = ends.join(ranked.select(F.col("first_id").alias("_i"), F.col("first_h").alias("_h"), F.col("first_place").alias("_p"), "place"), same)
    heads = numbered.select((F.pmod(F.col("place") - 2, F.lit(max(1, n))) + 1).alias("place"), F.col("first_text").alias("follows"))
    last = numbered.select("place", "last_id", "last_text").join(heads, "place").select("last_id", "last_text", "follows").mapInArrow(_edges, PAIR)
    whole = found.where("not edge").select(*last.columns).unionByName(last)
    of = lambda a, b, c: (F.col(a), F.col(b), F.col(c))
    own, edited, after = of("k", "s1", "s2"), of("ek", "e1", "e2"), of("nk", "n1", "n2")
    shown = lambda x: F.concat_ws(":", F.pow(F.lit(2.0), x[0]).cast("long"), x[1], x[2])
    return whole.select("doc_id", "n_chars", "edited_sha256", shown(own).alias("fingerprint"), shown(edited).alias("edited_fingerprint"), shown(after).alias("next_fingerprint"), likeness(own, edited).alias("near_edited"), likeness(own, after).alias("near_next"))
