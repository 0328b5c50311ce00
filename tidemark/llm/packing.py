"""Sum-of-squares online packing of token ids into windows.

Fill levels are `unit` ids wide, and a level array counts the open windows at each. A document's full
windows are closed at once. Its rest goes where the sum over levels of (open windows at that level)
squared becomes least: into a new window, into an open one with room for it, or, at a price of CUT, over the end of
an open one, which it fills, and on. The price keeps documents whole while levels are low, and bounds how many windows
can be open, whatever the sizes: no count is too high for the rule. A window with less than a
level of room is filled up by the start of the next document. What is still open at the end of a task
is laid end to end; the very last is cut into powers of two, which need no padding.
Each task packs the documents that it reads, so no text is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
#: What cutting a document costs, in the measure of the sum of squares.
CUT = 64


class SumOfSquares:
    """Feed documents with add(); closed windows come out as lists of pieces (doc_id, start, ids, doc_tokens)."""

    def __init__(self, length: int = 2048, unit: int = 32):
        self.length, self.unit = length, min(unit, length)
        self.counts = [0] * -(-length // self.unit)
        self.windows: list[list[tuple[int, list]]] = [[] for _ in self.counts]  # (fill, pieces) by level
        self.nearly: list[tuple[int, list]] = []  # less than a level of room

    def change(self, level: int, size: int) -> int:
        """What `size` ids in the next window of a level (-1: a new one) add to the sum of squares, the price of a cut included."""
        n, unit = self.counts, self.unit
        fill = self.windows[level][-1][0] + size if level >= 0 else size
        found = 1 - 2 * n[level] if level >= 0 else 0
        if fill > self.length:
            fill -= self.length
            found += CUT
        if 0 < fill <= self.length - unit:  # else the window leaves the array
            found += 2 * n[fill // unit] + 1 - 2 * (fill // unit == level)
        return found

    def level(self, size: int) -> int:
        """The level whose next window takes `size` more ids, the fullest of equals; -1, a new window, if that changes the sum less than any."""
        best, least = -1, self.change(-1, size)
        for level, n in enumerate(self.counts):
            if n and (found := self.change(level, size)) <= least:
                best, least = level, found
        return best

    def _open(self, fill: int, pieces: list) -> None:
        if fill > self.length - self.unit:
            self.nearly.append((fill, pieces))
        else:
            self.windows[fill // self.unit].append((fill, pieces))
            self.counts[fill // self.unit] += 1

    def _taken(self, level: int) -> tuple[int, list]:
        self.counts[level] -= 1
        return self.windows[level].pop()

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list]:
        total, at = len(ids), len(ids) // self.length * self.length
        for k in range(0, at, self.length):
            yield [(doc_id, k, ids[k : k + self.length], total)]
        while self.nearly and at < total:
            fill, pieces = self.nearly.pop()
            room = min(self.length - fill, total - at)
            pieces.append((doc_id, at, ids[at : at + room], total))
            at += room
            if fill + room == self.length:
                yield pieces
            else:
                self.nearly.append((fill + room, pieces))
        while at < total:
            best = self.level(total - at)
            fill, pieces = (0, []) if best < 0 else self._taken(best)
            took = min(self.length - fill, total - at)
            pieces.append((doc_id, at, ids[at : at + took], total))
            at += took
            if fill + took == self.length:
                yield pieces
            else:
                self._open(fill + took, pieces)

    @property
    def n_open(self) -> int:
        return sum(self.counts) + len(self.nearly)

    def rest(self) -> Iterator[list]:
        """What is open end to end, cut at the length, and the last part into powers of two."""
        held = [w for level in self.windows for w in level] + self.nearly
        queue = iter([p for _, pieces in reversed(held) for p in pieces])
        left = sum(fill for fill, _ in held)
        self.__init__(self.length, self.unit)
        piece = next(queue, None)
        while left:
            room = self.length if left >= self.length else 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                doc_id, start, ids, total = piece
                took = min(room, len(ids))
                window.append((doc_id, start, ids[:took], total))
                room -= took
                piece = (doc_id, start + took, ids[took:], total) if took < len(ids) else next(queue, None)
            yield window


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, with_ids: bool = False, keep: int = 600_000,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the ids (little-endian 32 bit).

    Each id of each document (null and empty texts: the end id alone) lies in exactly one piece.
    Rows that repeat a doc_id are documents of their own, a null doc_id stays null. Every window is full or a power of two
    long. Other columns of docs are ignored, whatever their names; an empty table gives no rows. A Python worker
    remembers the ids of about twice `keep` pieces, some 200 bytes each. sequence_id holds the number of the task in its high bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import encoded, encoder_of

        encoder, packer, end = encoder_of(tokenizer, keep), SumOfSquares(length), np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 40
        schema = pa.schema([*((c, pa.int64()) for c in FIELDS), *([("ids", pa.binary())] if with_ids else [])])

        def windows() -> Iterator[list]:
            for batch in batches:
                for doc, ids in zip(batch.column(0).to_pylist(), encoded(encoder, batch.column(1)), strict=True):
                    yield from packer.add(doc, np.frombuffer(ids + end, "<u4"))
            yield from packer.rest()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        rows: list[tuple] = []
        for window in windows():
            offset = 0
            for doc, start, ids, total in window:
                own = [ids.tobytes()] if with_ids else []
                rows.append((doc, start, len(ids), zlib.crc32(ids), total, number, offset, *own))
                offset += len(ids)
            number += 1
            if len(rows) >= 10_000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in FIELDS) + (", ids binary" if with_ids else ""))
