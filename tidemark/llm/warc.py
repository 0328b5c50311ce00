"""Web archives (WARC 1.1, a gzip member a record) by way of a chunked record table.

Payloads are cut at once into rows (record, chunk number, chunk), and only these are written, shuffled and sorted, so
neither a writer nor a reader ever holds more than a chunk, and digests are carried from chunk to chunk. Of records with equal payloads the first is a response,
the others revisit it. A task writes archives under names of its own; the committed manifest names those that count.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, written
from .exact_dedup import first_of_equals
from .token_files import opened

URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunk_table(pages: DataFrame, chunk_bytes: int = 1 << 16, payload: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """The payloads as a written table with a row per chunk: record, page_id, url, n_bytes, digest (SHA-256), n_chunks, chunk_no, chunk (binary).

    `record` tells the pages apart, repeated ones too. A page without payload (null counts as empty) has one empty
    chunk. Past this scan, where the page's own cell is read, no row holds more than a chunk.
    """
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    told = pages.select(F.monotonically_increasing_id().alias("record"), F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("body"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / chunk_bytes)).cast("int")
    sized = told.select("*", F.octet_length("body").cast("long").alias("n_bytes"), F.unhex(F.sha2("body", 256)).alias("digest"), n.alias("n_chunks"))
    numbered = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_no"))
    part = F.substring(F.col("body"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    return written(numbered.select("record", "page_id", "url", "n_bytes", "digest", "n_chunks", "chunk_no", part.alias("chunk")), "chunks", "zstd")


def roles(chunks: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Of each record of a chunk table: record, revisit, refers_to (null for a response).

    Payloads of at least min_bytes that are equal revisit the one with the smallest page_id. A null page_id comes last among
    equals; of repeated page_ids one row is the response.
    """
    light = chunks.where("chunk_no = 0").select(F.col("page_id").alias("doc_id"), F.col("record").alias("row"), "n_bytes", "digest", F.xxhash64("digest").alias("h"))
    found = first_of_equals(written(light, "payload_digests"))
    again = (F.col("row") != F.col("first.row")) & (F.col("n_bytes") >= min_bytes)
    return found.select(F.col("row").alias("record"), again.alias("revisit"), F.when(again, F.col("first.doc_id")).alias("refers_to"))


def _urn(page_id: int | None) -> str:
    return f"<{URN}{'' if page_id is None else page_id}>"


def record_head(page_id, url, n_bytes: int, digest: bytes, revisit: bool, refers_to, date: str) -> bytes:
    """The WARC header and the HTTP header; the payload and two line ends follow."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url else []), f"WARC-Payload-Digest: sha256:{digest.hex()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else n_bytes)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _write(folder: str, date: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = sink = member = digest = refers_to = due = None
        revisit = False
        written_bytes = n_records = 0
        done: list[tuple] = []

        def close() -> None:
            nonlocal sink, written_bytes, n_records
            if sink:
                sink.close()
                done.append((path, n_records, written_bytes))
            sink, written_bytes, n_records = None, 0, 0

        for batch in batches:
            rows = (r for k in range(0, len(batch), 200) for r in zip(*(c.to_pylist() for c in batch.slice(k, 200).columns), strict=True))
            for record, chunk_no, page_id, url, n_bytes, told, n_chunks, chunk, is_revisit, points_to in rows:
                if chunk_no < 0:
                    revisit, refers_to, due = is_revisit, points_to, (record, 0)
                    continue
                if (record, chunk_no) != due:
                    raise ValueError(f"chunk {chunk_no} of record {record} came where {due} was due")
                due = (record, chunk_no + 1)
                if revisit:
                    if chunk_no:
                        continue
                    n_chunks, chunk = 1, b""
                if chunk_no == 0:
                    if written_bytes >= archive_bytes:
                        close()
                    if sink is None:
                        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        system, name = opened(path)
                        sink = system.open_output_stream(name, compression=None)
                    member, digest = zlib.compressobj(1, wbits=31), hashlib.sha256()
                    out = member.compress(record_head(page_id, url, n_bytes, told, revisit, refers_to, date))
                else:
                    out = b""
                digest.update(chunk)
                out += member.compress(chunk)
                if chunk_no == n_chunks - 1:
                    if not revisit and digest.digest() != told:
                        raise ValueError(f"page {page_id}: chunks don't give the payload's digest")
                    out += member.compress(b"\r\n\r\n") + member.flush()
                    n_records += 1
                sink.write(out)
                written_bytes += len(out)
        close()
        if done:
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "n_records", "n_bytes"])

    return run


def write_archives(chunks: DataFrame, kinds: DataFrame, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = 1 << 30, folder: str | None = None) -> DataFrame:
    """Writes a chunk table with its roles(); returns the manifest (path, n_records, n_bytes). An empty table has no archive.

    A record's role travels as a row before its first chunk, so chunks are shuffled once and joined with nothing, and
    neither equal payloads nor repeated rows make a hot key.
    """
    folder = folder or scratch_path(chunks.sparkSession, "warc")
    system, name = opened(folder)
    system.create_dir(name, recursive=True)
    heads = kinds.select("record", F.lit(-1).alias("chunk_no"), "revisit", "refers_to")
    ordered = chunks.unionByName(heads, allowMissingColumns=True).repartition("record").sortWithinPartitions("record", "chunk_no")
    rows = ordered.select("record", "chunk_no", "page_id", "url", "n_bytes", "digest", "n_chunks", "chunk", "revisit", "refers_to")
    return written(rows.mapInArrow(_write(folder, date, archive_bytes), "path string, n_records long, n_bytes long"), "archives")


def read_archive(path: str, chunk_bytes: int = 1 << 16) -> Iterator[tuple]:
    """(page_id, record_type, refers_to, chunk_no, last, chunk, payload_bytes so far, SHA-256 so far) of each chunk of each record; a revisit has the length and digest that its headers tell."""
    system, name = opened(path)

    def number(urn: str) -> int | None:
        return int(urn[1 + len(URN) : -1]) if len(urn) > 2 + len(URN) else None

    def fields(stream) -> dict[str, str]:
        found = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().partition(":")
            found[key.strip().lower()] = value.strip()
        return found

    with system.open_input_stream(name, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) as stream:
        while first := stream.readline():
            if not first.startswith(b"WARC/"):
                raise ValueError(f"{path}: no record starts with {first[:40]!r}")
            head = fields(stream)
            stream.readline()
            http = fields(stream)
            page_id, kind = number(head["warc-record-id"]), head["warc-type"]
            refers_to = number(head["warc-refers-to"]) if kind == "revisit" else None
            n = int(http["content-length"])
            if kind == "revisit":
                yield page_id, kind, refers_to, 0, True, b"", n, head["warc-payload-digest"].removeprefix("sha256:")
            else:
                digest, at, chunk_no = hashlib.sha256(), 0, 0
                while at < n or chunk_no == 0:
                    chunk = stream.read(min(chunk_bytes, n - at))
                    if len(chunk) < min(chunk_bytes, n - at):
                        raise ValueError(f"{path}: page {page_id} ends early")
                    digest.update(chunk)
                    at += len(chunk)
                    yield page_id, kind, refers_to, chunk_no, at == n, chunk, at, digest.hexdigest()
                    chunk_no += 1
            stream.read(4)


def read_archives(manifest: DataFrame, with_chunks: bool = False, chunk_bytes: int = 1 << 16) -> DataFrame:
    """The record table: a row per chunk (with_chunks), or the last row of each record, which has the whole payload's length and digest."""
    schema = [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()), *([("chunk", pa.binary())] if with_chunks else []), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 64 if with_chunks else 20_000
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for row in read_archive(path, chunk_bytes):
                    if with_chunks:
                        rows.append(row)
                    elif row[4]:
                        rows.append(row[:5] + row[6:])
                    if len(rows) == most:
                        yield pa.record_batch([pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True), schema, strict=True)], [n for n, _ in schema])
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True), schema, strict=True)], [n for n, _ in schema])

    paths = manifest.select("path").repartition(max(1, manifest.count()))
    return paths.mapInArrow(run, "page_id long, record_type string, refers_to long, chunk_no int, last boolean, " + ("chunk binary, " if with_chunks else "") + "payload_bytes long, payload_digest string")
