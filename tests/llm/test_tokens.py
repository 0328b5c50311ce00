"""Token files and packing against the tokenizers library itself."""

import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm.packing import CUT, SumOfSquares, pack
from tidemark.llm.queries import tokenizer_file
from tidemark.llm.token_files import read_token_files, sequence, write_token_files
from tidemark.llm.tokens import Encoder

ODD = ["a  b", " lead", "tail ", "x\n\n y", "tab\tand nbsp  em", "don't we'll it's", "x <|endoftext|> y", "\x00 nul", "naïve Straße ÉCOLE", "1234 5,6", "\r\n mixed \n", "emoji 😀 😀", "<|startoftext|>x.<|endoftext|>", "x.. y,, z. 's. A.", "İstanbul. ΣΑΣ, ét́e क़. Å ﬁ ẞ! Ǆ? ŉa;", ". , ;"]


def whole(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name, rows, spark, sf):
    texts = [t or "" for _, t, _ in rows] + ODD + [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    ids = whole(name)
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(tokenizer_file(name)).ids(texts)] == [ids(t) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts_whatever_the_letters(name):
    """Each letter of Unicode begins, ends and is a word before each mark; and 100,000 texts of odd characters."""
    rng, ids, encoder = random.Random(9), whole(name), Encoder(tokenizer_file(name))
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    odd = [c for c in letters if not unicodedata.normalize("NFD", c.lower()).isalpha() or len(c.lower()) + len(c.upper()) > 2]
    texts = [" ".join(f"{c}{m} a{c}{m} {c}b" for c, m in zip(letters[i : i + 40], ".,;:!?" * 7)) for i in range(0, len(letters), 40)]
    texts += [" ".join(f"{c}{m} a{c}{m} {c}b{m}" for m in ".,;:!?") for c in odd]
    some = [*odd, *"aZéßİıΣςŉǰﬁﬃẞ0٣́̇ͅ'’-.,;:!?", " ", " ", " ", "\n"]
    texts += ["".join(rng.choices(some, k=rng.randint(1, 14))) for _ in range(100_000)]
    for i in range(0, len(texts), 2000):
        part = texts[i : i + 2000]
        for text, found in zip(part, encoder.ids(part), strict=True):
            assert np.frombuffer(found, "<u4").tolist() == ids(text), text


def test_token_files(rows, docs, empty):
    manifest = write_token_files(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, length=128, per_batch=4)
    got = sorted(read_token_files(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids) and len(got) == len(rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    encode = whole("byte_bpe_50k.json")
    crc = lambda t: (len(x := [*encode(t), 0]), zlib.crc32(np.array(x, "<u4").tobytes()))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((d or -1, *crc(t)) for d, t, _ in rows)
    path = manifest.first().path
    ids, mask = sequence(path, 0)
    assert ids.dtype == np.uint16 and len(ids) == len(mask) == 128
    assert read_token_files(write_token_files(empty, tokenizer_file("byte_bpe_50k.json"))).count() == 0


def test_pack(rows, docs, empty):
    got = pack(docs, tokenizer_file("word_bpe_49k.json"), with_ids=True, length=256).collect()
    encode = whole("word_bpe_49k.json")
    assert sum(r.length for r in got) == sum(len(encode(t)) + 1 for _, t, _ in rows)
    texts = defaultdict(list)
    for d, t, _ in rows:
        texts[d].append([*encode(t), 1])
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        assert any(len(x) == r.doc_tokens and x[r.start : r.start + r.length] == ids for x in texts[r.doc_id])
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    padded = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
        padded += end if end & (end - 1) == 0 else 256
    assert padded <= 1.02 * sum(r.length for r in got)
    assert pack(empty, tokenizer_file("word_bpe_49k.json")).count() == 0


def test_sum_of_squares_rule():
    """Each placement is the one that a full search over the level array finds."""
    rng, packer = np.random.default_rng(1), SumOfSquares(256, 8)
    for k in range(2000):
        size = int(rng.integers(1, 256))

        def after(level):
            n = np.array(packer.counts)
            fill = packer.windows[level][-1][0] + size if level >= 0 else size
            if level >= 0:
                n[level] -= 1
            price = CUT * (fill > 256)
            fill -= 256 * (fill > 256)
            if 0 < fill <= 248:
                n[fill // 8] += 1
            return int((n**2).sum()) + price

        fits = [-1, *[v for v, n in enumerate(packer.counts) if n]]
        at = packer.level(size)
        assert at in fits and after(at) == min(map(after, fits))
        list(packer.add(k, np.zeros(size, "<u4")))


@pytest.mark.parametrize("sizes", [[1500], [1025], [1100, 1300, 1900, 700], list(range(1, 2048, 7)), [1], [5000, 3]])
def test_open_windows_stay_few_whatever_the_sizes(sizes):
    """All closed windows are full, no id is lost, and no sequence of sizes makes the open windows grow with the documents."""
    rng, packer = np.random.default_rng(2), SumOfSquares()
    most, into, out = [], 0, 0
    for k in range(6000):
        n = int(rng.choice(sizes))
        into += n
        for window in packer.add(k, np.zeros(n, "<u4")):
            out += sum(len(p[2]) for p in window)
            assert out % 2048 == 0
        most.append(packer.n_open)
    assert max(most[3000:]) <= max(700, 1.1 * max(most[:3000]))
    rest = [sum(len(p[2]) for p in w) for w in packer.rest()]
    assert out + sum(rest) == into and all(n == 2048 or n & (n - 1) == 0 for n in rest)
