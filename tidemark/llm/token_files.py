"""Token ids in Arrow files of equal-length sequences and masks, open to zero-copy random access.

Documents are sorted by doc_id into shards. A shard is one Arrow IPC file whose record batches hold
`ids` (fixed-size list of the smallest unsigned type for the vocabulary) and `mask` (fixed-size list of bool,
false on the padding that ends the shard), and beside it an index file (doc_id, begin, n_tokens).
A task writes under a name of its own, and only names in the committed manifest count, so a lost
executor or a repeated task leaves no wrong data behind.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt_by_id, scratch_path, written

MANIFEST = "path string, first_doc long, first_h long, first_place long, n_docs long, n_tokens long, n_sequences long"


def opened(path: str):
    """The file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def source(path: str):
    """A readable Arrow source: mapped memory where the file is local, else a random-access stream."""
    from pyarrow import fs

    system, name = opened(path)
    return pa.memory_map(name) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(name)


class SequenceWriter:
    """Appends documents' ids and writes full batches of sequences; holds at most one batch and the index of one shard part."""

    def __init__(self, path: str, length: int, per_batch: int, kind: np.dtype):
        self.path, self.length, self.per_batch, self.kind = path, length, per_batch, np.dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("begin", pa.int64()), ("n_tokens", pa.int64())])
        self.system, name = opened(path)
        self.sink = self.system.open_output_stream(name)
        self.index_sink = self.system.open_output_stream(name + ".index")
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.index = pa.ipc.new_file(self.index_sink, self.index_schema)
        self.parts: list[np.ndarray] = []
        self.rows: list[tuple] = []
        self.waiting = self.total = self.docs = self.sequences = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.total, len(ids)))
        self.parts.append(ids.astype(self.kind))
        self.docs, self.total, self.waiting = self.docs + 1, self.total + len(ids), self.waiting + len(ids)
        if self.waiting >= self.length * self.per_batch:
            self._write(False)

    def _write(self, last: bool) -> None:
        flat = np.concatenate(self.parts) if self.parts else np.zeros(0, self.kind)
        n = -(-len(flat) // self.length) if last else len(flat) // self.length
        for k in range(0, n, self.per_batch):
            part = flat[k * self.length : min(n, k + self.per_batch) * self.length]
            rows = -(-len(part) // self.length)
            ids, mask = np.zeros(rows * self.length, self.kind), np.zeros(rows * self.length, bool)
            ids[: len(part)], mask[: len(part)] = part, True
            self.file.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)], schema=self.schema))
        self.sequences += n
        self.parts = [flat[n * self.length :]]
        self.waiting = max(0, len(flat) - n * self.length)
        if self.rows:
            self.index.write_batch(pa.record_batch([pa.array(x, pa.int64()) for x in zip(*self.rows, strict=True)], schema=self.index_schema))
            self.rows = []

    def close(self) -> None:
        self._write(True)
        for x in (self.file, self.index, self.sink, self.index_sink):
            x.close()


def sequence(path: str, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence i of a shard: views of its ids and its mask, without reading the others."""
    with pa.ipc.open_file(source(path)) as file:
        per_batch = file.get_batch(0).num_rows
        batch, length = file.get_batch(i // per_batch), file.schema.field("ids").type.list_size
        ids, mask = (batch.column(k).flatten() for k in range(2))
        at = (i % per_batch) * length
        return ids.slice(at, length).to_numpy(zero_copy_only=True), mask.slice(at, length).to_numpy(zero_copy_only=False)


def documents_in(path: str) -> Iterator[tuple[int | None, int, int, int]]:
    """(doc_id, begin, n_tokens, crc32 of the ids as little-endian 32-bit integers) of a shard's documents, batch by batch."""
    with pa.ipc.open_file(source(path)) as file, pa.ipc.open_file(source(path + ".index")) as index:

        def stream() -> Iterator[np.ndarray]:
            for k in range(file.num_record_batches):
                batch = file.get_batch(k)
                n = batch.column(1).flatten().true_count
                yield batch.column(0).flatten().to_numpy(zero_copy_only=True)[:n].astype("<u4")

        arrays, now, at = stream(), np.zeros(0, "<u4"), 0
        for k in range(index.num_record_batches):
            for doc_id, begin, n in zip(*(c.to_pylist() for c in index.get_batch(k).columns), strict=True):
                crc, left = 0, n
                while left:
                    if at == len(now):
                        now, at = next(arrays), 0
                    part = now[at : at + left]
                    crc, at, left = zlib.crc32(part, crc), at + len(part), left - len(part)
                yield doc_id, begin, n, crc


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None = 0, length: int = 2048, per_batch: int = 64, folder: str | None = None, keep: int = 600_000, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes the shards and returns their manifest with `start`, the ids before each shard.

    Order: ascending doc_id, null first, repeated doc_ids by a hash of the text; the rows of an id may be parted too. Null and empty texts
    have the end id alone. An empty table has no shard, and so no row. A Python worker remembers the ids of
    about twice `keep` pieces, some 200 bytes each.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    system, name = opened(folder)
    system.create_dir(name, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoded, encoder_of

        writer, first, encoder, end = None, None, None, np.array([] if end_id is None else [end_id], "<u4").tobytes()
        for batch in batches:
            for doc, key, ids in zip(batch.column(0).to_pylist(), zip(*(batch.column(k).to_pylist() for k in (2, 3)), strict=True), encoded(encoder := encoder_of(tokenizer, keep), batch.column(1)), strict=True):
                if writer is None:
                    kind = np.uint16 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
                    writer, first = SequenceWriter(f"{folder}/{uuid.uuid4().hex}.arrow", length, per_batch, kind), (doc, *key)
                writer.add(doc, np.frombuffer(ids + end, "<u4"))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"path": writer.path, "first_doc": first[0], "first_h": first[1], "first_place": first[2], "n_docs": writer.docs, "n_tokens": writer.total, "n_sequences": writer.sequences}], schema=pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("first_doc", "first_h", "first_place", "n_docs", "n_tokens", "n_sequences"))]))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    manifest = written(dealt_by_id(rows).mapInArrow(write, MANIFEST), "manifest")
    before = Window.orderBy(F.asc_nulls_first("first_doc"), "first_h", "first_place").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    names = ("doc_id", "start", "n_tokens", "ids_crc32")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for doc_id, begin, n, crc in documents_in(path):
                    rows.append((doc_id, start + begin, n, crc))
                    if len(rows) == 20_000:
                        yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

    files = written(manifest.select("path", "start"), "shards")
    return files.repartition(max(1, files.count())).mapInArrow(read, ", ".join(f"{n} long" for n in names))
