"""Removal of word runs that also stand in an earlier document.

Documents are dealt into blocks by a hash and kept as a bucketed table with a row per block, so that
what is found out about a block joins it without moving texts again.

1. Anchors. Every window of `width` words has as its anchor the least hash among its runs of ANCHOR words; equal
   windows have equal anchors. Blocks send their distinct anchors, sorted and packed, to the hash range that owns them,
   and get a bit for each back: does it occur in another document? Most text ends here.
2. Windows. For windows with such an anchor, a block sends each distinct window once, with its least doc_id
   (64 bits of one hash of its words and 16 of another), and gets a bit back: does it start in a document with a smaller doc_id?
3. Words under windows with such a bit, or whose window starts earlier in the block, are removed.

A key that stands in a third of all documents is one entry per block, so no range is hot.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, scratch_path, text_slices, written

ANCHOR = 5
BLOCK_BYTES, TASK_BYTES, RANGE_BYTES = 1 << 20, 16 << 20, 16 << 20
LAST = np.iinfo(np.int64).max  # where documents without a doc_id stand: they come last


def block_tasks(total: int) -> int:
    """Tasks for so many bytes: of TASK_BYTES up to 200 of them, and where that would be more than 16 TASK_BYTES each, as many as that takes."""
    return max(1, min(200, total // TASK_BYTES), total // (16 * TASK_BYTES))


def block_table(docs: DataFrame, total: int) -> DataFrame:
    """(block, docs): a block's doc_ids and texts, ascending by doc_id, as one Arrow stream. Bucketed by block in the shared folder.

    Blocks are dealt by doc_id, text and partition, so neither rows without a doc_id nor repeated rows gather in one.
    """
    spark = docs.sparkSession
    n_blocks, n_tasks = max(1, total // BLOCK_BYTES), block_tasks(total)
    if n_tasks > int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")):
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", str(n_tasks))
    block = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n_blocks))
    rows = docs.select(block.alias("block"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def row() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                for part in held:
                    out.write_batch(part)
            return pa.record_batch([pa.array([now], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "docs"])

        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and block[a] != now:
                    yield row()
                    held = []
                now = int(block[a])
                # a copy, so that what is held isn't the whole batch
                held.append(pa.record_batch([c.slice(a, b - a).take(pa.array(range(b - a))) for c in batch.columns[1:]], ["doc_id", "text"]))
        if held:
            yield row()

    name = f"tidemark_blocks_{uuid.uuid4().hex}"
    packed = rows.repartition(n_tasks, "block").sortWithinPartitions("block", "doc_id").mapInArrow(pack, "block long, docs binary")
    packed.write.format("parquet").bucketBy(n_tasks, "block").option("path", scratch_path(spark, "blocks")).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and the plan knows them
    return table


class Block:
    """A block's words, windows and the distinct anchors that it sends."""

    def __init__(self, raw: bytes, width: int):
        table = pa.ipc.open_stream(raw).read_all()
        ids = table.column("doc_id").combine_chunks()
        self.ids, self.doc_ids = ids, ids.fill_null(int(LAST)).to_numpy(zero_copy_only=False)
        texts = table.column("text").cast(pa.large_string()).combine_chunks()
        self.width = width
        ((_, _, data, offsets),) = text_slices(texts, 1 << 62)
        self.words = Words(data, offsets)
        self.hashes = self.words.hashes(0)
        grams, at, _ = self.words.windows(self.hashes, ANCHOR)
        spread = np.zeros(len(self.hashes), np.uint64)
        spread[at] = grams
        text = np.repeat(np.arange(len(self.doc_ids)), self.words.counts)
        n = len(self.hashes) - width + 1
        self.at = np.flatnonzero(text[:n] == text[width - 1 :]) if n > 0 else np.zeros(0, np.int64)
        low = spread[self.at]
        for k in range(1, width - ANCHOR + 1):
            low = np.minimum(low, spread[self.at + k])
        self.owner = text[self.at]
        low &= np.uint64(2**64 - 2**16)  # 48 bits travel
        self.anchors, self.of = np.unique(low, return_inverse=True)
        first, last = np.full(len(self.anchors), len(self.doc_ids)), np.full(len(self.anchors), -1)
        np.minimum.at(first, self.of, self.owner)
        np.maximum.at(last, self.of, self.owner)
        self.several = first < last

    def windows(self, again: np.ndarray) -> None:
        """Distinct windows whose anchor stands in several documents: self.keys with the least doc_id of each in self.least."""
        self.some = np.flatnonzero(again[self.of])
        h = self._hash(self.hashes, self.some)
        self.keys, first, self.key_of = np.unique(h, return_index=True, return_inverse=True)
        self.doc = self.doc_ids[self.owner[self.some]]
        self.least = np.full(len(self.keys), LAST)
        np.minimum.at(self.least, self.key_of, self.doc)
        self.more = (self._hash(self.words.hashes(1) if len(first) else self.hashes, self.some[first]) >> np.uint64(48)).astype("<u2")

    def _hash(self, hashes: np.ndarray, some: np.ndarray) -> np.ndarray:
        at, total = self.at[some], np.zeros(len(some), np.uint64)
        for k in range(self.width):
            total = mix(total + hashes[at + k] + np.uint64(1))
        return total

    def result(self, earlier: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Words removed of each document, and the text of what is left."""
        gone = self.some[earlier[self.key_of] | (self.doc > self.least[self.key_of])]
        n = len(self.hashes)
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, self.at[gone], 1)
        np.add.at(cover, self.at[gone] + self.width, -1)
        kept = np.cumsum(cover)[:n] == 0
        so_far = np.concatenate([[0], np.cumsum(kept)])
        left = np.diff(so_far[self.words.first])
        starts, ends = self.words.starts[kept], self.words.ends[kept]
        at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        source = np.repeat(starts - at[:-1], ends - starts + 1) + np.arange(at[-1])
        out = np.append(self.words.data, np.uint8(32))[source]
        out[at[1:] - 1] = 32
        raw, bounds = out.tobytes(), at[so_far[self.words.first]].tolist()
        return self.words.counts - left, pa.array([raw[a : max(a, b - 1)] for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary()).cast(pa.string())


def _ranges(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash ranges, of n equal ones, that hold any of sorted 64-bit keys, and where each begins, with the end: work by keys, not by n."""
    of = ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    starts = np.flatnonzero(np.diff(of, prepend=np.uint64(2**63)))
    return of[starts].astype(np.int64), np.append(starts, len(keys))


def _bits(got: list | None, ranges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The bits that came back for a block's sorted keys, range by range."""
    of, at = ranges
    out = np.zeros(at[-1], bool)
    for x in got or ():
        k = int(np.searchsorted(of, x["range"]))
        out[at[k] : at[k + 1]] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=at[k + 1] - at[k])
    return out


def _rows(columns: list[tuple]) -> pa.RecordBatch:
    r, block, packed, several = zip(*columns, strict=True)
    return pa.record_batch([pa.array(r, pa.int32()), pa.array(block, pa.int64()), pa.array(packed, pa.binary()), pa.array(several, pa.binary())], ["range", "block", "packed", "several"])


def _send_anchors(width: int, n_ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                block = Block(batch.column(1)[k].as_py(), width)
                of, cut = _ranges(block.anchors, n_ranges)
                six = block.anchors.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]
                own = batch.column(0)[k].as_py()
                rows = [(r, own, six[a:b].tobytes(), np.packbits(block.several[a:b]).tobytes()) for r, a, b in zip(of.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                if rows:
                    yield _rows(rows)

    return run


def _send_windows(width: int, n_ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                block = Block(batch.column(1)[k].as_py(), width)
                block.windows(_bits(batch.column(2)[k].as_py(), _ranges(block.anchors, n_ranges)))
                of, cut = _ranges(block.keys, n_ranges)
                columns = block.keys.astype("<u8"), block.more, block.least.astype("<i8")
                own = batch.column(0)[k].as_py()
                rows = [(r, own, b"".join(c[a:b].tobytes() for c in columns), b"") for r, a, b in zip(of.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                if rows:
                    yield _rows(rows)

    return run


def _answer(find, size: int):
    """For all rows of a hash range together: find(packed parts, several parts) gives a bit for each of their entries, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answered(held: list[tuple]) -> pa.RecordBatch:
            bits = find([h[2] for h in held], [h[3] for h in held])
            ends = np.cumsum([0, *(len(h[2]) // size for h in held)]).tolist()
            packed = [np.packbits(bits[a:b]).tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            return pa.record_batch([pa.array([h[1] for h in held], pa.int64()), pa.array([h[0] for h in held], pa.int32()), pa.array(packed, pa.binary())], ["block", "range", "bits"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield answered(held)
                    held = []
                held.append(row)
        if held:
            yield answered(held)

    return run


def anchors_again(packed: list[bytes], several: list[bytes]) -> np.ndarray:
    """Which anchors stand in several documents of one block, or in several blocks."""
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 6)
    keys = np.zeros((len(raw), 8), np.uint8)
    keys[:, 2:] = raw
    keys = keys.view(">u8").ravel().astype(np.uint64)
    del raw
    local = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(p) // 6) for p, s in zip(packed, several, strict=True)]).astype(bool)
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    return again | local


def windows_earlier(packed: list[bytes], several: list[bytes]) -> np.ndarray:
    """Which windows stand in a document with a smaller doc_id than the entry's."""
    n = [len(p) // 18 for p in packed]
    keys = np.concatenate([np.frombuffer(p, "<u8", k) for p, k in zip(packed, n, strict=True)])
    more = np.concatenate([np.frombuffer(p, "<u2", k, 8 * k) for p, k in zip(packed, n, strict=True)])
    doc = np.concatenate([np.frombuffer(p, "<i8", k, 10 * k) for p, k in zip(packed, n, strict=True)])
    order = np.lexsort((doc, more, keys))
    keys, more, doc = keys[order], more[order], doc[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros(len(keys), bool)
    out[order] = doc > least
    return out


def _finish(width: int, n_ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                block = Block(batch.column(1)[k].as_py(), width)
                block.windows(_bits(batch.column(2)[k].as_py(), _ranges(block.anchors, n_ranges)))
                removed, kept = block.result(_bits(batch.column(3)[k].as_py(), _ranges(block.keys, n_ranges)))
                yield pa.record_batch([block.ids, pa.array(block.words.counts, pa.int64()), pa.array(removed, pa.int64()), kept], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, width: int = 13, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (the words that stay, joined by one space).

    A word goes if a run of `width` words that covers it also starts in a document with a smaller doc_id; all is
    judged on the input. Words are parted by ASCII white space and unchanged. Null texts have no words. Documents
    without doc_id come last and do not remove from each other, nor do rows that repeat a doc_id; runs that repeat
    within one document stay. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    n_ranges = max(1, total // RANGE_BYTES)
    blocks = block_table(rows, total)
    sent, got = "range int, block long, packed binary, several binary", "block long, range int, bits binary"

    def answers(parts: DataFrame, find, size: int, name: str) -> DataFrame:
        bits = parts.repartition("range").sortWithinPartitions("range", "block").mapInArrow(_answer(find, size), got)
        return bits.groupBy("block").agg(F.collect_list(F.struct("range", "bits")).alias(name))

    again = answers(blocks.mapInArrow(_send_anchors(width, n_ranges), sent), anchors_again, 6, "again")
    again = written(again, "anchors_again")
    known = blocks.join(again, "block", "left").select("block", "docs", "again")
    earlier = written(answers(known.mapInArrow(_send_windows(width, n_ranges), sent), windows_earlier, 18, "earlier"), "windows_earlier")
    full = known.join(earlier, "block", "left").select("block", "docs", "again", "earlier")
    return full.mapInArrow(_finish(width, n_ranges), "doc_id long, n_words long, n_removed long, kept_text string")
