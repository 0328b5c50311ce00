"""Repetition, conversation repair and fill-in-middle against plain versions."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.conversation_repair import damaged, repair
from tidemark.llm.fill_middle import Chunks, fill_in_middle, restored
from tidemark.llm.queries import op11_quality_rules, op12_conversation_repair, op13_fill_in_middle
from tidemark.llm.repetition import SuffixArray, maximal_spans, quality_rules, union

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def longest(symbols):
    """At each place the longest substring that starts there and elsewhere, by trying all pairs."""
    n, out = len(symbols), [0] * len(symbols)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and symbols[i + k] == symbols[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(200):
        texts = [[rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(0, 25))] for _ in range(rng.randint(1, 4))]
        owner = np.array([k for k, s in enumerate(texts) for _ in s], np.int64)
        found = SuffixArray(np.array([x for s in texts for x in s], np.uint64), owner)
        want = np.array([b for s in texts for b in longest(s)], np.int64)
        assert found.longest_repeats().tolist() == want.tolist()
        for width in (1, 2, 4):
            starts, ends = maximal_spans(want, owner, width)
            covered = np.zeros(len(want), bool)
            for i, n in enumerate(want):
                covered[i : i + n] |= n >= width
            assert union(starts, ends, len(want)).tolist() == covered.tolist()
            runs = Counter((k, tuple(s[i : i + width])) for k, s in enumerate(texts) for i in range(len(s) - width + 1))
            first, last, length = found.intervals(width)
            assert len(first) == sum(n > 1 for n in runs.values()) and (length >= width).all()
            assert sorted((last - first + 1).tolist()) == sorted(n for n in runs.values() if n > 1)


def plain_quality(text, width=5):
    text = text or ""
    words = WORD.findall(text)

    def spans(k):
        seen = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        under, n = [False] * len(words), 0
        for i in range(len(words) - k + 1):
            if seen[tuple(words[i : i + k])] > 1:
                under[i : i + k] = [True] * k
        return under, sum(c > 1 for c in seen.values())

    lines = [x for x in text.split("\n") if WORD.search(x)]
    under, n_repeats = spans(width)
    chars = [len(w) for w in words]
    most, repeats = 0, sum(spans(3)[0])
    for k in range(width, len(words)):
        places = defaultdict(list)
        for i in range(len(words) - k + 1):
            places[tuple(words[i : i + k])].append(i)
        again = [i for p in places.values() if len(p) > 1 for i in p]
        if not again:
            break
        most = max(most, *(sum(chars[i : i + k]) for i in again))
    covered = sum(c for c, u in zip(chars, under) if u)
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    kept = not failed and 100 * covered <= 30 * sum(chars) and 100 * most <= 20 * sum(chars)
    return len(words), sum(chars), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats, failed, kept, n_repeats, covered, most


def test_quality_rules(spark, rows, docs, empty):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(40)] + ["é|<", "#a&&b", "日本"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    part, line = text(30), text(6)
    extra = [text(60) + " " + part + "\n" + part, "\n".join([line] * 40), text(400), part + " " + text(200) + "\t" + part + text(80), "a " * 300, " \n \n", "\n".join(text(4) for _ in range(60))]
    assert sorted(map(tuple, quality_rules(docs).drop("doc_id").collect())) == sorted(map(tuple, quality_rules(docs.repartition(5)).drop("doc_id").collect()))
    got = quality_rules(spark.createDataFrame(list(enumerate(extra)), "doc_id long, text string"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_repeats", "covered_chars", "longest_chars")
    for r in got.collect():
        assert tuple(r[c] for c in names) == plain_quality(extra[r.doc_id]), r.doc_id
    short = [(d, t, s) for d, t, s in rows if len(t or "") < 3000]
    want = Counter((d, *plain_quality(t)) for d, t, _ in short)
    have = quality_rules(docs.where("length(coalesce(text, '')) < 3000")).select("doc_id", *names)
    assert Counter(map(tuple, have.collect())) == want
    assert quality_rules(empty).count() == 0


def test_quality_rules_keep_what_is_labelled_good(spark, sf):
    found = op11_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed and quality = 1")
    assert found.count() > 50 and found.where("not kept").count() == 0


GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, repaired lines) of rows (role, text, must go, truncated): a search over edit strings by (cost, string)."""
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, roles, lines = heapq.heappop(queue)
        if i == len(rows) and GRAMMAR.fullmatch(roles):
            return cost, audit, list(lines)
        if (i, roles) in seen or not any(GRAMMAR.fullmatch(roles + x) for x in ("", "a", "ua")):
            continue
        seen.add((i, roles))
        if len(roles) < len(rows) + 4:
            for r, name in (("u", "user"), ("a", "assistant")):
                heapq.heappush(queue, (cost + 2, audit + "I", i, roles + r, (*lines, name + ":")))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, roles, lines))
            if not gone:
                heapq.heappush(queue, (cost + cut, audit + "K", i + 1, roles + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    heapq.heappush(queue, (cost + 2 + cut, audit + "R", i + 1, roles + r, (*lines, f"{name}:{text}")))


def plain_damage(rows):
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def plain_repair(rows, ids):
    """rows of (conv, turn, role, text) whose order within a turn doesn't matter, but for equal ones."""
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for conv in ids:
        mine = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0))
        faults, seen = [], set()
        for _, _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[1] for r in mine} - {None}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        cost, audit, lines = cheapest([(r[2], r[3], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(mine, faults)])
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        yield conv, gaps, *map(faults.count, ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines))


TURNS = "conv_id long, turn long, role string, text string, side int, part string"


def test_repair_is_the_cheapest_and_least(spark):
    rng, rows = random.Random(2), []
    for conv in range(60):
        for turn in rng.sample(range(-3, 12), rng.randint(1, 8)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, "", "User", "admin"])
            rows.append((conv, turn, role, rng.choice(["Yes.", "Well! ", "cut off", "  ", None, "", "Why?\n", f"no {turn}", "é."])))
    rows += [(None, 0, "user", "Hello."), (None, 1, "assistant", "Bye."), (70, None, "user", "a."), (71, None, None, None)]
    rows += [(72, 1, "user", "Same."), (72, 1, "user", "Same."), (72, 1, "user", "Same."), (72, 2, "assistant", "Other")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)
    ids = sorted({r[0] for r in rows}, key=str)
    assert sorted(map(tuple, repair(damaged(df), df).collect()), key=str) == sorted(plain_repair(list(plain_damage(rows)), ids), key=str)
    plain = [(c, t, r or " ", x or " ") for c, t, r, x in rows]
    assert sorted(map(tuple, repair(spark.createDataFrame(plain, "conv_id long, turn long, role string, text string")).collect()), key=str) == sorted(plain_repair(plain, ids), key=str)
    assert repair(damaged(df.where("false")), df.where("false")).count() == 0


def test_a_conversation_over_many_parts(spark):
    """One conversation in all ranges gives what its rows in one part give, nearly all of it one repeated row too."""
    rng, rows = random.Random(4), []
    for turn in range(3000):
        rows.append((5, turn, rng.choice(["user", "assistant", "tool"]), rng.choice(["Again.", f"text {turn}.", f"open {turn}"])))
    rows += [(5, 3000, "user", "the same row.")] * 2000 + [(6, k, "user" if k % 2 == 0 else "assistant", f"{k}.") for k in range(10)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one = {r.conv_id: tuple(r) for r in repair(df.coalesce(1)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = {r.conv_id: tuple(r) for r in repair(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert one == many
    assert many[6][1:8] == (0, 0, 0, 0, 0, 0, "K" * 10) and len(many[5][7]) >= 5000 and "D" * 1999 in many[5][7]


def test_op12_gives_every_conversation(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    assert sorted(map(tuple, op12_conversation_repair(spark, sf).collect())) == sorted(plain_repair(list(plain_damage(rows)), {r[0] for r in rows}))


def plain_middle(doc_id, text):
    text, n = text or "", len(text or "")
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fill_in_middle(spark, rows, docs, empty):
    more = [(5000 + k, t) for k, t in enumerate(["<P>", "a <S", "<<S>>", "é" * 3000 + "日本語😀" * 500, "x", "<", "<P", "a<M>b", "\n"] + ["<S<P<M" * k for k in range(1, 30)])]
    for df, want in ((docs, [(d, t) for d, t, _ in rows]), (spark.createDataFrame(more, "doc_id long, text string"), more)):
        for chunk in (7, 4096):
            out = fill_in_middle(df, chunk=chunk)
            got = out.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
            assert Counter(tuple(r)[:6] for r in got) == Counter(plain_middle(d, t) for d, t in want)
            assert Counter((r.doc_id, r.back) for r in got) == Counter((d, t or "") for d, t in want)
    assert fill_in_middle(empty).count() == 0


def test_cuts_between_words_and_lines():
    text = "  two  words\n\nthird é日 😀\n end"
    data = np.frombuffer(("x" + text + "y").encode(), np.uint8)
    offsets = np.array([0, 1, len(data) - 1, len(data)])
    for size in (1, 3, 4096):
        words, lines = Chunks(data, offsets, "word", size), Chunks(data, offsets, "line", size)
        places = [m.start() for m in WORD.finditer(text)]
        encoded = [len(text[:p].encode()) for p in places]
        assert words.counts.tolist() == [1, len(places), 1]
        assert [words.place(1, k) for k in range(len(places) + 1)] == [*encoded, len(text.encode())]
        heads = [0, *(m.end() for m in re.finditer("\n", text))]
        assert [lines.place(1, k) for k in range(len(heads))] == [len(text[:p].encode()) for p in heads]


def test_op13_covers_all_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = Counter((d, n, f, a, b, sha(out), sha(t or "")) for (d, t), (_, n, f, a, b, out) in ((x, plain_middle(*x)) for x in docs))
    assert Counter(map(tuple, op13_fill_in_middle(spark, sf).collect())) == want
