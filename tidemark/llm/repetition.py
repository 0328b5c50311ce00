"""Quality rules on repetition: suffix arrays over words, intervals of common prefixes, maximal repeats and what they cover.

The suffixes of each text (its words as symbols) are sorted by prefix doubling: a round orders those
that still share a prefix by the ranks of what follows it, so only repeats take further rounds. Neighbours'
common prefixes come from the rounds' ranks, longest power of two first. Where they are at least `width`
words long, neighbours lie in one interval, a substring found as often as the interval has suffixes. A suffix's
longest repeat that no repeat from the word before reaches beyond is a maximal repeat; the union of their spans is
what repeats cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, Words, mix, text_slices

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "covered_chars", "longest_chars")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def ranks(keys: np.ndarray) -> np.ndarray:
    """The place of each key's first equal in sorted order, so equal keys share a rank."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    return out


class SuffixArray:
    """Suffixes of symbols in order, of many texts at once: `owner` keeps texts apart, and no suffix reaches beyond its own.

    lcp[r] is the length of the prefix that the suffixes at order[r - 1] and order[r] share. levels[k] holds, after the
    round that tells prefixes of 2**k symbols apart, the suffixes (ascending) that still share one, and their ranks; a suffix
    that shares none any more isn't kept. So memory is some tens of bytes a symbol and as much again for each round
    that repeats take.
    """

    def __init__(self, symbols: np.ndarray, owner: np.ndarray):
        n = len(symbols)
        own = mix(symbols ^ mix(owner.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
        rank = ranks(own)
        ends = np.concatenate([np.flatnonzero(owner[1:] != owner[:-1]) + 1, [n]]) if n else np.zeros(0, np.int64)
        end = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) if n else ends
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        width = 1
        while n:
            shared = np.bincount(rank, minlength=n) > 1
            at = np.flatnonzero(shared[rank])  # suffixes that share their first `width` symbols with another
            if not len(at):
                break
            self.levels.append((at, rank[at]))
            after = at + width
            inside = after < end[at]
            follows = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)  # nothing comes before anything
            # among suffixes of one rank, those of equal followers share the next one; one that ends is equal to none
            key = np.where(inside, follows, 0)
            order = np.lexsort((at, key, rank[at]))
            first, second = rank[at][order], key[order]
            new = np.ones(len(at), bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (second[1:] == 0)
            group = np.ones(len(at), bool)
            group[1:] = first[1:] != first[:-1]
            place = np.arange(len(at))
            start = np.maximum.accumulate(np.where(group, place, 0))
            next_rank = first + np.maximum.accumulate(np.where(new, place, 0)) - start
            rank = rank.copy()
            rank[at[order]] = next_rank
            width *= 2
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)
        self.lcp = self._common(n)

    def _common(self, n: int) -> np.ndarray:
        left, right = self.order[:-1], self.order[1:]
        out = np.zeros(n, np.int64)
        if n < 2 or not self.levels:
            return out
        at0, rank0 = self.levels[0]
        first = np.full(n, -1, np.int64)
        first[at0] = rank0
        pairs = np.flatnonzero((first[left] >= 0) & (first[left] == first[right]))  # neighbours that share a symbol at least
        a, b, length = left[pairs].copy(), right[pairs].copy(), np.zeros(len(pairs), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            at, rank = self.levels[k]
            seen = np.full(n + 1, -1, np.int64)
            seen[at] = rank
            same = (seen[np.minimum(a, n)] >= 0) & (seen[np.minimum(a, n)] == seen[np.minimum(b, n)])
            step = same.astype(np.int64) << k
            a, b, length = a + step, b + step, length + step
        out[pairs + 1] = length
        return out

    def longest_repeats(self) -> np.ndarray:
        """At each place the length of the longest substring that starts there and somewhere else too."""
        best = np.zeros(len(self.order), np.int64)
        after = np.append(self.lcp[1:], 0) if len(self.lcp) else self.lcp
        best[self.order] = np.maximum(self.lcp, after)
        return best

    def intervals(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, length): the places in sorted order of the suffixes that share `width` symbols at least, and how many all of them share."""
        deep = self.lcp >= width
        starts = np.flatnonzero(deep & ~np.concatenate([[False], deep[:-1]])) if len(deep) else np.zeros(0, np.int64)
        if not len(starts):
            return starts, starts, starts
        lasts = np.flatnonzero(deep & ~np.concatenate([deep[1:], [False]]))
        edges = np.ravel(np.column_stack([starts, lasts + 1]))
        held = np.append(self.lcp, np.iinfo(np.int64).max)
        return starts - 1, lasts, np.minimum.reduceat(held, edges)[::2]


def maximal_spans(best: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the longest repeats of `width` symbols or more that no repeat from the place before reaches beyond or up to."""
    ends = np.arange(len(best)) + best
    ends[best < width] = 0
    before = np.concatenate([[0], ends[:-1]])
    before[np.concatenate([[True], owner[1:] != owner[:-1]])[: len(best)]] = 0
    at = np.flatnonzero((best >= width) & (ends > before))
    return at, ends[at]


def union(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Of each of n places whether a span covers it."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def _measured(data: np.ndarray, offsets: np.ndarray, width: int, base_width: int) -> list[np.ndarray]:
    words = Words(data, offsets)
    n, texts = len(words.starts), len(words.counts)
    owner = np.repeat(np.arange(texts), words.counts)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = leads[words.ends] - leads[words.starts]
    total = lambda x, at: (y := np.concatenate([[0], np.cumsum(x)]))[at[1:]] - y[at[:-1]]
    suffixes = SuffixArray(words.hashes(0), owner)
    best = suffixes.longest_repeats()
    small = union(*maximal_spans(best, owner, base_width), n)
    starts, ends = maximal_spans(best, owner, width)
    covered = union(starts, ends, n)
    upto = np.concatenate([[0], np.cumsum(chars)])
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, owner[starts], upto[ends] - upto[starts])
    groups = suffixes.order[suffixes.intervals(width)[0]]  # a suffix of each interval
    n_repeats = np.bincount(owner[groups], minlength=texts)
    return [words.counts, total(chars, words.first), total(_SYMBOL[data], offsets), total(small, words.first), n_repeats, total(chars * covered, words.first), longest]


def repeated_lines(text: bytes) -> int:
    """Lines (parted at line feeds) with a word in them that are equal to an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip(WS_CHARS.encode())]
    return len(lines) - len(set(lines))


def repetition(docs: DataFrame, width: int = 5, base_width: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_repeats, covered_chars, longest_chars.

    n_repeat_words counts the words in runs of base_width found twice or more in the text, n_repeats the different runs of `width` words
    that are found again, a longer repeat of them counting once, covered_chars the code points of words under any of them, longest_chars those
    of the longest. Words are told apart by 64-bit hashes. Null and empty texts have no words and zeros everywhere. Repeated rows are
    measured alike, a null doc_id stays null. Other columns are left behind, whatever their names; an empty table gives no rows. Texts are whole, half a megabyte of them
    at a time, a longer one on its own; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(1)):
                words, chars, symbols, small, n_repeats, covered, longest = _measured(data, offsets, width, base_width)
                raw, edges = data.tobytes(), offsets.tolist()
                lines = [repeated_lines(raw[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
                columns = (words, chars, symbols, lines, small, n_repeats, covered, longest)
                yield pa.record_batch([batch.column(0).slice(i, j - i), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *COUNTS])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def quality_rules(
    docs: DataFrame, least_words: int = 50, most_repeated: int = 50, most_covered: int = 30, most_longest: int = 20, **how
) -> DataFrame:
    """The rows of repetition() with base_failed and kept.

    base_failed: fewer than least_words words, or more than most_repeated percent of them in repeated runs. Kept are texts that
    don't fail there and of whose word characters maximal repeats cover most_covered percent at most, and the longest
    most_longest percent at most. So texts without words are never kept, and none is judged by others.
    """
    found = repetition(docs, **how)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    fine = (100 * F.col("covered_chars") <= most_covered * F.col("word_chars")) & (100 * F.col("longest_chars") <= most_longest * F.col("word_chars"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)
