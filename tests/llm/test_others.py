"""Mixing, fingerprints, WARC and toxicity."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import toxicity
from tidemark.llm.common import _BYTE, dealt_by_id, row_hash
from tidemark.llm.fingerprints import fingerprint_neighbours, fingerprints
from tidemark.llm.mixing import _mixed, mix_sources, mixed_documents, sainte_lague, source_targets
from tidemark.llm.queries import op4_toxicity
from tidemark.llm.token_files import opened
from tidemark.llm.warc import chunk_table, read_archives, roles, write_archives


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = [s for s in names if s not in full]
        level = left / sum(w[s] for s in rest) if rest else 0
        over = {s for s in rest if level * w[s] > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in full else level * w[s] for s in names}
        full |= over


def test_source_targets(spark):
    rng = random.Random(3)
    for _ in range(6):
        sizes = {s: rng.choice([0, 5, 100, 4000, 70000]) for s in ["b", "a", "Z", "é", None, "c"][: rng.randint(2, 6)]}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_targets(df, (3, 1, 2), 1.5, 2.0).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def test_sainte_lague(spark):
    rng = random.Random(4)
    for _ in range(5):
        votes, seats = {p: rng.choice([0, 1, 3, 50, 777]) for p in range(12)}, rng.randint(1, 60)
        if not any(votes.values()):
            continue
        best = sorted((-v / (2 * k + 1), p, k) for p, v in votes.items() if v for k in range(seats))[:seats]
        want = Counter(p for _, p, _ in best)
        df = spark.createDataFrame([(0, p, v) for p, v in votes.items()], "g int, p int, v long")
        got = {r.p: r.quota for r in sainte_lague(df, "v", F.lit(seats).cast("long"), ["g"], "p").collect()}
        assert got == {p: want[p] for p in votes}


def test_mix_sources(rows, docs, empty):
    got = mix_sources(docs, shard_words=2000, block=16).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    targets = plain_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 * (1 + r.target)
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - targets[s]) <= 64 + 0.01 * targets[s] for s in sizes)
    again = mix_sources(docs.repartition(3), shard_words=2000, block=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    whole = mixed_documents(docs, shard_words=2000, block=16)
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in whole.collect())
    assert whole.columns == docs.columns and words == sum(r.taken for r in got)
    assert mix_sources(empty).count() == 0


def test_mixing_agrees_on_reruns_of_repeated_and_unknown_ids(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 3]), " ".join(["w"] * rng.randint(0, 60)) + f" {k % 40}", rng.choice(["a", "b", None])) for k in range(2000)]
    results = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(seed + 2)
        results.append(Counter(map(str, mix_sources(df, shard_words=2000, block=16).collect())))
    assert results[0] == results[1] == results[2]


def test_unknown_ids_are_dealt_to_all_shards(spark):
    df = spark.range(20_000).selectExpr("cast(null as long) doc_id", "concat('some words of row ', id) text", "'s' source")
    found = _mixed(df, (3, 1, 2), 1.5, 2.0, 64, 17, 1 << 12, None, "text", "doc_id", "source")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "shard" in plan and found.count() == 20_000
    shards = df.select(F.pmod(F.xxhash64(F.lit(17), "doc_id", row_hash(df)), F.lit(32)).alias("s")).groupBy("s").count().collect()
    assert len(shards) == 32 and max(r["count"] for r in shards) < 2 * 20_000 / 32


def test_rows_of_one_id_are_dealt_to_many_ranges(spark):
    rows = spark.range(100_000).selectExpr("case when id % 3 = 0 then id end doc_id", "case when id % 2 = 0 then 'the same' else concat('text ', id) end text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in dealt_by_id(rows).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 2 * 100_000 / 8


def test_fingerprints_of_equal_rows(spark):
    rows = [(None, "same text here")] * 300 + [(1, "x" * 50)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = fingerprint_neighbours(df).collect()
    assert len(got) == 303 and sum(r.near_next == 1 for r in got) >= 299


def test_fingerprints(rows, docs, empty):
    got = fingerprint_neighbours(docs)
    assert fingerprint_neighbours(empty).count() == 0
    found = got.collect()
    assert len(found) == len(rows)
    by_id = {}
    for d, t, _ in rows:
        by_id.setdefault(d, []).append(t or "")
    order = sorted((d is not None, d or 0, t or "") for d, t, _ in rows)
    texts = {}
    for r in found:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and r.n_chars in {len(t) for t in by_id[r.doc_id]}
        if len(by_id[r.doc_id]) == 1:
            texts.setdefault(by_id[r.doc_id][0], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in texts.values()) and len(order) == len(rows)


def test_fingerprint_edits(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcdefgh é\n") for _ in range(rng.choice([0, 1, 3, 40, 3000, 9000])))) for i in range(40)]
    found = {r.doc_id: r for r in fingerprint_neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    for i, (_, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and found[i].n_chars == len(t)
        if len(t) >= 3000:
            assert found[i].near_edited > 0.5 > found[i].near_next
        if edited == t:
            assert found[i].near_edited == 1
    assert fingerprints([b"x" * 100, b"", b"x" * 100])[::2] == [fingerprints([b"x" * 100])[0]] * 2


def test_warc(spark):
    big = "z" * 300_000
    rows = [(1, "http://a/1", "<p>é</p>" * 30), (2, "http://a/2", "<p>é</p>" * 30), (3, None, None), (4, "u\r\nX: y", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", big), (8, "v", big), (9, "v", "WARC/1.1\r\n\r\n" * 40), (9, "v", "WARC/1.1\r\n\r\n" * 40), (None, "w", big)]
    pages = spark.createDataFrame([(*r, 1, b"x") for r in rows], "page_id long, url string, html string, digest int, payload binary")
    chunks = chunk_table(pages, 1000)
    assert chunks.agg(F.max(F.length("chunk"))).first()[0] == 1000
    manifest = write_archives(chunks, roles(chunks), archive_bytes=2000)
    body = lambda h: (h or "").encode()
    first = {}
    for d, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(body(h), d)
    want, seen = Counter(), Counter()
    for d, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        seen[body(h)] += 1
        again = len(body(h)) >= 100 and seen[body(h)] > 1
        want[(d, len(body(h)), hashlib.sha256(body(h)).hexdigest(), "revisit" if again else "response", first[body(h)] if again else None)] += 1
    got = read_archives(manifest)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == want
    chunks = defaultdict(list)
    for r in read_archives(manifest, with_chunks=True, chunk_bytes=777).where("page_id = 7").collect():
        chunks[r.page_id].append((r.chunk_no, bytes(r.chunk)))
    assert b"".join(c for _, c in sorted(chunks[7])) == big.encode()
    system, name = opened(manifest.first().path)
    with system.open_input_stream(name, compression=None) as raw:
        assert gzip.decompress(raw.read()).startswith(b"WARC/1.1\r\nWARC-Type: ")
    none = spark.createDataFrame([], pages.schema)
    chunks = chunk_table(none)
    assert read_archives(write_archives(chunks, roles(chunks))).count() == 0


def weigh(text, lexicon=None):
    scorer = toxicity.Scorer(lexicon or toxicity.Lexicon())
    *insults, threats = scorer.run([scorer.symbols(toxicity.LETTERS.findall(text.lower()))])
    insults = sum(insults)
    return insults[0], threats[0]


def test_clause_grammar():
    insult, aimed, denied, told = (weigh(t)[0] for t in ("such an idiot", "you idiot", "you are not an idiot", "he said you idiot"))
    assert aimed > insult > denied > 0 and aimed > told > 0
    kinds = lambda t: [x[0] > 0 for x in toxicity.Scorer(toxicity.Lexicon()).run([toxicity.Scorer(toxicity.Lexicon()).symbols(t.split())])]
    assert [kinds(t).index(True) for t in ("you idiot", "such an idiot", "you are not an idiot", "he said you idiot", "kill them")] == [0, 1, 2, 2, 3]
    assert weigh("i will kill you")[1] > weigh("i will not kill you")[1] > 0 == weigh("to kill time")[1]


def test_learned_words_keep_their_roles():
    lexicon = toxicity.Lexicon({"not": 9.0, "you": 9.0, "kill": 9.0}, {"no": 9.0})
    assert weigh("not you kill", lexicon) == (0, 0) and weigh("nobody", lexicon) == (9, 0)


def plain_weigh(kinds, weights):
    """The grammar said plainly, each word looking back over the clause."""
    insults = threats = 0.0
    for i, (kind, weight) in enumerate(zip(kinds, weights)):
        def marks(j):
            return 0.3 ** ("N" in kinds[max(0, j - 3) : j]) * 0.5 ** ("R" in kinds[:j])

        if kind == "I":
            insults += weight * marks(i) * 1.5 ** ("G" in kinds[max(0, i - 6) : i])
        if kind == "G":
            held = [j for j in range(max(0, i - 4), i) if kinds[j] == "T"]
            if held and "G" not in kinds[held[-1] : i]:
                threats += 4.0 * marks(held[-1])
    return insults, threats


def test_composition_against_a_plain_reading():
    rng, scorer = random.Random(8), toxicity.Scorer(toxicity.Lexicon())
    clauses = [[rng.choice("----ITGNR") for _ in range(rng.choice([0, 1, 5, 30]))] for _ in range(400)]
    weights = [[rng.choice([1.0, 3.0]) for _ in c] for c in clauses]
    *a, b = scorer.run([([toxicity.KINDS.index(k) for k in c], w) for c, w in zip(clauses, weights)])
    a = sum(a)
    for x, y, c, w in zip(a, b, clauses, weights):
        assert abs(x - plain_weigh(c, w)[0]) < 1e-9 and abs(y - plain_weigh(c, w)[1]) < 1e-9
    words = {"I": "idiot", "T": "kill", "G": "you", "N": "not", "R": "said", "-": "word"}
    for c in clauses + [["G", *"-" * 50, "I"], ["R", *"-" * 50, "I"]]:
        want = plain_weigh(c, [3.0] * len(c))
        assert all(abs(x - y) < 1e-9 for x, y in zip(weigh(" ".join(words[k] for k in c)), want))


def test_toxicity_held_out(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op4_toxicity(spark, sf).join(labels, "doc_id").where("held_out and toxic is not null").select("toxic", "predicted", "score").collect()
    right = sum(r.toxic == r.predicted for r in rows)
    assert len(rows) > 40 and right >= 0.9 * len(rows)
    caught = [r.predicted for r in rows if r.toxic == 1]
    assert sum(caught) >= 0.5 * len(caught)
    model = toxicity.Model(toxicity.Lexicon(), toxicity.np.array([1.0, 1, 0, 1, 0, 0, 1, -2.5]))
    scored = toxicity.toxicity(docs, model)
    assert scored.where("score between 0 and 1").count() == docs.count() and toxicity.toxicity(empty, model).count() == 0
    bare = toxicity.train(docs, labels.where("false"))
    assert len(bare.weights) == len(toxicity.FEATURES) + 1
    clashing = docs.selectExpr("*", "'x' toxic", "1 _id", "2 id", "3 w")
    told = spark.createDataFrame([(r.doc_id, k, "y") for r in docs.where("doc_id < 200").collect() for k in (0, None, int(r.doc_id % 2))], "doc_id long, toxic int, text string")
    twice = [toxicity.train(clashing.repartition(n), told.repartition(n)) for n in (2, 5)]
    assert np.allclose(twice[0].weights, twice[1].weights) and twice[0].lexicon == twice[1].lexicon
    assert set(toxicity.toxicity(clashing, twice[0]).columns) == {*clashing.columns, "score"}
    assert len(toxicity.train(empty, told).weights) == len(bare.weights)


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def plain_fingerprint(data):
    """Byte by byte: the rolling hash of the last eight bytes, the block size by chunk counts, a letter a chunk."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    level = []
    for i in range(len(data)):
        x = plain_mix(int.from_bytes(data[i - 7 : i + 1], "little")) if i >= 7 else None
        level.append(-1 if x is None else 64 if x == 0 else (x & -x).bit_length() - 1)
    if not data:
        return 0, "", ""
    counts = [sum(v >= k for v in level) for k in range(66)]
    best = min(range(66), key=lambda k: (round(abs(math.log((counts[k] + 1) / 49)), 12), k))
    out = [best]
    for k in (best, best + 1):
        text, total, factor = "", 0, 1
        for i, byte in enumerate(data):
            total = (total + int(_BYTE[0][byte]) * factor) % 2**64
            factor = factor * 0x9E3779B97F4A7C15 % 2**64
            if level[i] >= k or i == len(data) - 1:
                text += letters[plain_mix(total) & 63]
                total, factor = 0, 1
        out.append(text)
    return tuple(out)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_likeness(a, b):
    near = lambda x, y: 1 - plain_distance(x, y) / max(len(x), len(y), 1)
    if a[0] == b[0]:
        return max(near(a[1], b[1]), near(a[2], b[2]))
    return near(a[1], b[2]) if a[0] == b[0] + 1 else near(a[2], b[1]) if b[0] == a[0] + 1 else 0.0


def test_fingerprints_against_a_plain_loop(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdefgh é\n") for _ in range(rng.choice([0, 1, 7, 8, 9, 40, 700, 4000]))) for _ in range(30)]
    texts += [texts[-1][:600] + texts[3], "x" * 3000, "x" * 3000, None]
    df = spark.createDataFrame([(i, t, 5, "y") for i, t in enumerate(texts)], "doc_id long, text string, k int, fingerprint string").repartition(4)
    plain = [plain_fingerprint((t or "").encode()) for t in texts]
    shown = lambda f: f"{2 ** f[0]}:{f[1]}:{f[2]}"
    for r in fingerprint_neighbours(df).collect():
        t, after = texts[r.doc_id] or "", texts[(r.doc_id + 1) % len(texts)] or ""
        edited = plain_fingerprint((t[: len(t) - len(t) // 4] + after[: len(t) // 4]).encode())
        own, following = plain[r.doc_id], plain[(r.doc_id + 1) % len(texts)]
        assert r.fingerprint == shown(own) and r.edited_fingerprint == shown(edited)
        assert abs(r.near_edited - plain_likeness(own, edited)) < 1e-12 and abs(r.near_next - plain_likeness(own, following)) < 1e-12
