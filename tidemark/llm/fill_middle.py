"""Fill-in-middle transformation by overlapping chunks.

A text's bytes are cut into chunks. Whether a unit (code point, word or line) starts at a byte depends on that byte
and the one before it, so each chunk also looks at its left neighbour's last byte and counts its unit starts alone.
Prefix sums of the counts tell which chunk owns the unit at a cut's rank, and only owning chunks are
scanned again for the place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, text_slices

MARKERS = ("<P>", "<S>", "<M>")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
Predicate = Callable[[np.ndarray, np.ndarray], np.ndarray]

#: Does a unit start at a byte, given the byte before it (a line feed before the first)?
UNITS: dict[str, Predicate] = {
    "char": lambda before, here: (here & 0xC0) != 0x80,
    "word": lambda before, here: _SPACE[before] & ~_SPACE[here],
    "line": lambda before, here: before == 10,
}


class Chunks:
    """The unit starts of a run of texts, counted by chunk: `before` has those of a text before each of its chunks."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str = "char", size: int = 4096):
        self.data, self.offsets, self.starts_unit, self.size = data, offsets, UNITS[unit], size
        sizes = np.diff(offsets)
        per_text = -(-sizes // size)
        self.first = np.concatenate([[0], np.cumsum(per_text)])  # chunks of text i: first[i] to first[i + 1]
        place = np.arange(self.first[-1]) - np.repeat(self.first[:-1], per_text)
        self.leads = place == 0
        self.begin = np.repeat(offsets[:-1], per_text) + place * size
        self.end = np.minimum(self.begin + size, np.repeat(offsets[1:], per_text))
        counts = np.array([np.count_nonzero(self.scan(k)) for k in range(len(self.begin))], np.int64)
        summed = np.concatenate([[0], np.cumsum(counts)])
        self.before = summed[:-1] - np.repeat(summed[self.first[:-1]], per_text)
        self.counts = summed[self.first[1:]] - summed[self.first[:-1]]  # of each text

    def scan(self, chunk: int) -> np.ndarray:
        """Of each byte of a chunk, whether a unit starts there: a look at pairs of neighbours, the first of them in the chunk before."""
        a, b = int(self.begin[chunk]), int(self.end[chunk])
        here, before = self.data[a:b], np.empty(b - a, np.uint8)
        before[1:] = here[:-1]
        before[0] = 10 if self.leads[chunk] else self.data[a - 1]
        return self.starts_unit(before, here)

    def place(self, text: int, rank: int) -> int:
        """The byte, from the text's start, before which `rank` units have begun; the text's end for as many as it has."""
        if rank >= self.counts[text]:
            return int(self.offsets[text + 1] - self.offsets[text])
        lo, hi = int(self.first[text]), int(self.first[text + 1])
        owner = lo + int(np.searchsorted(self.before[lo:hi], rank, "right")) - 1
        inside = np.flatnonzero(self.scan(owner))[rank - int(self.before[owner])]
        return int(self.begin[owner] + inside - self.offsets[text])


def draws(seed: str, doc_id: int | None) -> tuple[int, ...]:
    """Four 32-bit numbers of a document: the first groups of the sha256 of the seed, a colon and the id (nothing for null)."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(found[k : k + 4]) for k in (0, 4, 8, 12))


def fill_in_middle(docs: DataFrame, seed: str = "1", unit: str = "char", plain_percent: int = 10, spm_percent: int = 20, chunk: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n (units), form, prefix_chars, middle_chars (in units; null if plain), output.

    Two cuts at seeded ranks of 0 to n units part a text into prefix, middle and suffix. form is psm (markers and
    parts in the order prefix, suffix, middle), spm (suffix, prefix, middle) or plain, the text itself: that of an empty text, of
    one that holds a marker, and of plain_percent in a hundred others. Null texts are empty. A null doc_id has draws of
    its own, the same for all such rows; rows that repeat a doc_id have the same draws. Units are code points, words (with
    the white space after them) or lines; what stands before the first unit goes with the first cut. Other
    columns of docs, whatever their names, are left behind; an empty table gives no rows. Nothing is shuffled, and
    besides a batch a task holds the counts of its chunks.
    """
    marks = [m.encode() for m in MARKERS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, data, offsets in text_slices(batch.column(1)):
                chunks, raw, rows = Chunks(data, offsets, unit, chunk), data.tobytes(), []
                edges, counts = offsets.tolist(), chunks.counts.tolist()
                for k, own in enumerate(ids[i:j]):
                    whole, n = raw[edges[k] : edges[k + 1]], counts[k]
                    h = draws(seed, own)
                    if not whole or any(m in whole for m in marks) or h[2] % 100 >= 100 - plain_percent:
                        rows.append((own, n, "plain", None, None, whole))
                        continue
                    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                    a, b = chunks.place(k, lo), chunks.place(k, hi)
                    prefix, middle, suffix = whole[:a], whole[a:b], whole[b:]
                    spm = h[3] % 100 < spm_percent
                    p, s, m = marks
                    out = (s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle)
                    rows.append((own, n, "spm" if spm else "psm", lo, hi - lo, b"".join(out)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.record_batch([*columns[:5], columns[5].cast(pa.string())], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text of an output: its parts, told apart by the first marker of each kind, in the order prefix, middle, suffix."""

    def between(x: Column, start: str, end: str | None) -> Column:
        begin = F.locate(start, x) + len(start)
        return F.substring(x, begin, F.length(x) if end is None else F.locate(end, x) - begin)

    p, s, m = MARKERS
    psm = F.concat(between(output, p, s), between(output, m, None), between(output, s, m))
    spm = F.concat(between(output, p, m), between(output, m, None), between(output, s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
