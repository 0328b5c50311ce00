"""Suffix automata of bounded reference shards: matching statistics of streamed documents against what they hold.

A shard's automaton is broadcast, and every document runs through it once: after each word the state stands for the longest
run of words that ends there and occurs in the shard. This suits a reference of few shards, such as
benchmark passages. A corpus that is its own reference has as many shards as blocks, and the work is their product.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, written


class SuffixAutomaton:
    """Of several word sequences, each with an owner; every state knows the least owner of the places where its runs end."""

    def __init__(self):
        self.following: list[dict[str, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [float("inf")]

    def _state(self, following: dict[str, int], length: int, link: int, owner: float) -> int:
        self.following.append(following)
        self.length.append(length)
        self.link.append(link)
        self.least.append(owner)
        return len(self.length) - 1

    def _split(self, p: int, word: str, q: int) -> int:
        """A copy of q for the runs that reach it by p and shorter ones."""
        copy = self._state(dict(self.following[q]), self.length[p] + 1, self.link[q], float("inf"))
        while p >= 0 and self.following[p].get(word) == q:
            self.following[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: Iterable[str], owner: float) -> None:
        last = 0
        for word in words:
            if (q := self.following[last].get(word)) is not None:
                now = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                self.least[now] = min(self.least[now], owner)
            else:
                now, p = self._state({}, self.length[last] + 1, 0, owner), last
                while p >= 0 and word not in self.following[p]:
                    self.following[p][word] = now
                    p = self.link[p]
                if p >= 0:
                    q = self.following[p][word]
                    self.link[now] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = now

    def finish(self) -> SuffixAutomaton:
        """Hands the least owners down to the shorter runs."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.least[self.link[s]] = min(self.least[self.link[s]], self.least[s])
        return self

    def spans(self, words: list[str], width: int, owner: float) -> list[tuple[int, int]]:
        """Maximal runs (from, to) of words under windows of `width` that an owner less than this one has."""
        found: list[tuple[int, int]] = []
        state = n = 0
        for i, word in enumerate(words):
            while state and word not in self.following[state]:
                state = self.link[state]
                n = self.length[state]
            if word in self.following[state]:
                state, n = self.following[state][word], n + 1
            while self.length[self.link[state]] >= width > 0 and state:
                state = self.link[state]
                n = self.length[state]
            if n >= width and self.least[state] < owner:
                start = i + 1 - width
                if found and found[-1][1] >= start:
                    found[-1] = found[-1][0], i + 1
                else:
                    found.append((start, i + 1))
        return found


def matched_spans(docs: DataFrame, reference: DataFrame, width: int = 13, shard_words: int = 50_000, text: str = "text", doc_id: str = "doc_id", owner: str | None = None) -> DataFrame:
    """(row, from, to): runs of words of docs (row, doc_id, text) under windows of `width` words that also stand in the reference.

    With `owner`, a column of the reference, only windows of an owner less than the doc_id count; a null doc_id is greater than
    all. Runs of different shards may overlap. A shard holds shard_words words or one text, so the broadcast is bounded by that.
    Null texts have no words; an empty reference gives no rows.
    """
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({WORD})"), 1)
    rows = reference.select(words.alias("words"), (F.col(owner) if owner else F.lit(None)).cast("double").alias("owner")).where(F.size("words") >= width)
    total = rows.agg(F.sum(F.size("words"))).first()[0] or 0
    n = max(1, -(-total // shard_words))
    dealt = written(rows.withColumn("shard", F.pmod(F.xxhash64("words", "owner"), F.lit(n))).repartition("shard"), "reference_shards")
    documents = docs.select("row", F.col(doc_id).cast("double").alias("doc_id"), words.alias("words"))
    out = None
    for shard in range(n):
        automaton = SuffixAutomaton()
        for row in dealt.where(F.col("shard") == shard).toLocalIterator():
            automaton.add(row["words"], float("-inf") if row["owner"] is None else row["owner"])
        sent = docs.sparkSession.sparkContext.broadcast(automaton.finish())

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for k, own, text_words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found += [(k, a, b) for a, b in sent.value.spans(text_words, width, float("inf") if own is None else own)]
                if found:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["row", "from", "to"])

        part = written(documents.mapInArrow(run, "row long, from long, to long"), "spans")
        out = part if out is None else out.unionByName(part)
    return out
