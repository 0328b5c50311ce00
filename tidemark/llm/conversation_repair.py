"""Repair of conversation structure by weighted finite-state composition.

A conversation's rows are an input acceptor, its edits a transducer (keep, rerole, delete, insert), and the order
of roles, (s?(ua)+)?, a grammar acceptor; their product is composed lazily, a row at a time, with at most two
inserts in a row, as more than two never help. It has no cycles, so shortest paths follow its topological order. Weights are pairs
(cost, label string), smaller cost first, then the ASCII-least string. In this product a state and a label have one
successor, so the least string is found by taking, at each state, the least label that lies on a cheapest
path, and only costs need to be known ahead.

Costs ahead go backwards through a conversation. Rows are dealt to ranges of (conversation, turn); each range's part of a conversation
is one 4 x 4 matrix of costs in the (min, +) semiring, and only these matrices meet, a part after another. Then every
part knows the costs behind it and gives each of its rows the costs after it. Texts move once, to where they
are read in order, hashed and forgotten; a conversation of any length holds only its audit string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_CHARS, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR = 1 << 40
#: Grammar: state to {initial: next state}. Nothing yet, after s, after u, after a; the first and the last accept.
GRAMMAR: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTS = (0, 3)
STATES = range(len(GRAMMAR))
#: The role that an insert or a rerole gives in a state, of those that it may give.
WANTED = tuple(next(r for r in "ua" if r in g) for g in GRAMMAR)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
MARK = "has_turn", "turn", "role", "h1", "h2"


def inserted(costs: Sequence[int]) -> list[int]:
    """The least costs where none, one or two inserts may come first."""
    out = list(costs)
    for _ in range(2):
        out = [min(out[g], INSERT + out[GRAMMAR[g][WANTED[g]]]) for g in STATES]
    return out


END = inserted([0 if g in ACCEPTS else FAR for g in STATES])


def edits(g: int, initial: str, must_go: bool, truncated: bool) -> Iterator[tuple[str, int, int]]:
    """(label, cost, next state) of the edges that take a row, in ASCII order."""
    yield "D", DELETE, g
    if not must_go:
        if initial in GRAMMAR[g]:
            yield "K", KEEP + TRUNCATED * truncated, GRAMMAR[g][initial]
        yield "R", REROLE + TRUNCATED * truncated, GRAMMAR[g][WANTED[g]]


def before(row: tuple[str, bool, bool], after: Sequence[int]) -> list[int]:
    """The least costs from each state before a row (initial, must_go, truncated), inserts included, given those after it."""
    return inserted([min(cost + after[to] for _, cost, to in edits(g, *row)) for g in STATES])


def labels(g: int, row: tuple[str, bool, bool], after: Sequence[int]) -> Iterator[tuple[str, int, int]]:
    """The edges (label, cost, next state) of the least string among cheapest paths, up to and with the one that takes the row."""
    costs = before(row, after)
    while True:
        found = next((e for e in edits(g, *row) if e[0] == "D" and e[1] + after[e[2]] == costs[g]), None)
        step = GRAMMAR[g][WANTED[g]]
        if found is None and INSERT + costs[step] == costs[g]:
            yield "I", INSERT, step
            g = step
            continue
        yield found or next(e for e in edits(g, *row) if e[1] + after[e[2]] == costs[g])
        return


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text as the crc32 of `conv_id:turn` has it, modulo 20: 0 drops a row, 1 empties its text, 2 takes out .!?, 3 repeats it, 4 makes it the user's. Nulls read as one blank; conv_id and turn themselves stay null."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with the sort key (has_turn, turn, role, h1, h2) of which h1 and h2 are hashes of the text."""
    hashes = {"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(11), "text")}
    return rows.withColumns({"has_turn": F.col("turn").isNotNull(), **hashes})


def _faults(marked: DataFrame) -> DataFrame:
    """A row per different row of `marked`: how often it stands there, its faults, and whether an earlier turn has its role and text."""
    bare = F.rtrim("text", F.lit(WS_CHARS))
    blank = ~F.col("text").rlike(f"[^{WS}]")
    rows = marked.select("conv_id", *MARK, blank.alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    each = rows.groupBy("conv_id", *MARK).agg(F.count(F.lit(1)).alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    at = F.struct("has_turn", "turn")
    first = each.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("h1").alias("_1"), F.col("h2").alias("_2")).agg(F.min(at).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2"))
    return each.join(first, same).withColumn("again", ~at.eqNullSafe(F.col("_first"))).drop("_c", "_r", "_1", "_2", "_first")


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _entries(initial: str, n: int, blank: bool, truncated: bool, again: bool) -> Iterator[tuple[str, bool, bool]]:
    """A row for each time that it stands there: the first with its own fault, others duplicates."""
    for k in range(n):
        gone = blank or again or k > 0
        yield initial, gone, truncated and not gone


def _batches(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


ENTRY = ("initial", "n", "blank", "truncated", "again")
_COSTS = pa.list_(pa.int64())


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of parts of conversations, rows (conv_id, part, *ENTRY) in descending order: the costs from each state before a part to each after it."""

    def parts() -> Iterator[tuple]:
        for key, rows in groupby(_rows_of(batches), key=lambda r: r[:2]):
            ahead = [[0 if g == h else FAR for g in STATES] for h in STATES]  # by the state after
            for row in rows:
                for entry in reversed(list(_entries(*row[2:]))):
                    ahead = [before(entry, c) for c in ahead]
            yield (*key, [c for h in ahead for c in h])

    return _batches(parts(), pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("matrix", _COSTS)]))


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of matrices in descending order of parts, the costs from the end of each part to the end of its conversation."""

    def parts() -> Iterator[tuple]:
        now, costs, fresh = None, END, True
        for conv, part, matrix in _rows_of(batches):
            if fresh or conv != now:
                now, costs, fresh = conv, END, False
            yield conv, part, costs
            costs = [min(matrix[4 * h + g] + costs[h] for h in STATES) for g in STATES]

    return _batches(parts(), pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("behind", _COSTS)]))


def _ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (conv_id, part, *ENTRY, *MARK, behind) in descending order, the costs after each row."""
    kinds = (pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    schema = pa.schema([("conv_id", pa.int64()), *zip(MARK, kinds, strict=True), ("n", pa.int64()), ("blank", pa.bool_()), ("truncated", pa.bool_()), ("again", pa.bool_()), ("after", _COSTS)])

    def rows() -> Iterator[tuple]:
        now, costs = None, END
        for conv, part, initial, n, blank, truncated, again, *rest in _rows_of(batches):
            if (conv, part) != now:
                now, costs = (conv, part), rest[-1]
            after = costs
            for entry in reversed(list(_entries(initial, n, blank, truncated, again))):
                costs = before(entry, costs)
            yield conv, *rest[:-1], n, blank, truncated, again, after

    return _batches(rows(), schema)


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Repair:
    """One conversation, fed row by row in order."""

    def __init__(self):
        self.counts = dict.fromkeys(RESULT, 0)
        self.state, self.audit, self.last, self.first_turn, self.last_turn, self.turns = 0, [], None, None, None, 0
        self.digest, self.lines = hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.lines += 1

    def row(self, turn: int | None, role: str, n: int, blank: bool, truncated: bool, again: bool, after: Sequence[int], text: str) -> None:
        if turn is not None and (self.turns == 0 or turn != self.last_turn):
            self.first_turn = turn if self.turns == 0 else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1
        initial, entries = role[:1], list(_entries(role[:1], n, blank, truncated, again))
        costs = [after]
        for entry in reversed(entries[1:]):
            costs.append(before(entry, costs[-1]))
        for k, (entry, ahead) in enumerate(zip(entries, reversed(costs), strict=True)):
            fault = "blank" if blank else "duplicate" if again or k else "truncated" if truncated else None
            if fault:
                self.counts[fault] += 1
            self.counts["illegal"] += self.last is not None and self.last + initial not in LEGAL
            self.last = initial
            for label, cost, to in labels(self.state, entry, ahead):
                self.audit.append(label)
                self.counts["cost"] += cost
                if label != "D":
                    given = NAMES.get(WANTED[self.state], "")
                    self.line(role if label == "K" else given, "" if label == "I" else text)
                self.state = to

    def result(self) -> tuple:
        while self.state not in ACCEPTS:
            self.line(NAMES[WANTED[self.state]], "")
            self.audit.append("I")
            self.counts["cost"] += INSERT
            self.state = GRAMMAR[self.state][WANTED[self.state]]
        if self.turns:
            self.counts["gaps"] = self.last_turn - self.first_turn + 1 - self.turns
        return *self.counts.values(), "".join(self.audit), self.digest.hexdigest()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (conv_id, side, *MARK, n, blank, truncated, again, after, text) in order: side 0 is a conversation, 1 what is known of a row, 2 its text, which may be repeated."""
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in RESULT), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def conversations() -> Iterator[tuple]:
        for conv, rows in groupby(_rows_of(batches), key=lambda r: r[0]):
            found, known = Repair(), None
            for _, side, _, turn, role, _, _, n, blank, truncated, again, after, text in rows:
                if side == 1:
                    known = turn, role, n, blank, truncated, again, after
                elif side == 2 and known:
                    found.row(*known, text)
                    known = None
            yield conv, *found.result()

    return _batches(conversations(), schema, 200)


def repair(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of `ids` (conv_id; by default those of turns): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    turns has conv_id, turn, role, text (neither of the last two null); a conversation's rows count in order of turn, null first,
    then role and a hash of the text, so equal rows stand together. A null conv_id is a conversation of its own. A role is
    known by its first character, and one that isn't s, u or a can only be reroled or deleted. Texts and roles are the same where
    128 bits of hashes are. Other columns are left behind; empty tables give no rows. A conversation without rows has
    zeros, an empty audit and the hash of nothing. The hash of a repaired conversation needs all of its text in
    order, so one task reads that, batch by batch.
    """
    marked = _marked(turns.select("conv_id", "turn", "role", "text"))
    faults = _faults(marked)
    order = [F.col("conv_id"), *map(F.col, MARK)]
    dealt = written(faults.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).withColumn("initial", F.left("role", F.lit(1))), "turns")
    backwards = [F.desc(c) for c in ("conv_id", "part", *MARK)]
    parts = dealt.select("conv_id", "part", *ENTRY, *MARK).repartition("conv_id", "part").sortWithinPartitions(*backwards).drop(*MARK)
    matrices = written(parts.mapInArrow(_matrices, "conv_id long, part int, matrix array<long>"), "matrices")
    behind = matrices.repartition("conv_id").sortWithinPartitions(F.desc("conv_id"), F.desc("part")).mapInArrow(_behind, "conv_id long, part int, behind array<long>")
    behind = written(behind, "behind").select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "behind")
    told = dealt.join(behind, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")))
    told = told.select("conv_id", "part", *ENTRY, *MARK, "behind").repartition("conv_id", "part").sortWithinPartitions(*backwards)
    shape = "conv_id long, has_turn boolean, turn long, role string, h1 long, h2 long, n long, blank boolean, truncated boolean, again boolean, after array<long>"
    known = told.mapInArrow(_ahead, shape).withColumn("side", F.lit(1))
    every = (turns if ids is None else ids).select("conv_id").distinct().withColumn("side", F.lit(0))
    texts = marked.select("conv_id", F.lit(2).alias("side"), *MARK, "text")
    rows = known.unionByName(texts, allowMissingColumns=True).unionByName(every, allowMissingColumns=True)
    rows = rows.select("conv_id", "side", *MARK, "n", "blank", "truncated", "again", "after", "text")
    forwards = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("side") > 0, *MARK, "side")
    return forwards.mapInArrow(_repaired, "conv_id long, " + ", ".join(f"{c} long" for c in RESULT) + ", audit string, repaired_sha256 string")
