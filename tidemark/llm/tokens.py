"""Token ids of whole texts by the tokenizers library, with the ids of recurring pieces remembered.

Both kinds of tokenizer cut a text into pre-tokens that never reach over the start of a blank-led word,
so the ids of a text are those of its pieces in a row. A distinct piece is encoded by the library
once and looked up afterwards; a text that is not simply words parted by single blanks and line feeds
is cut only where that rule certainly holds, and one that holds an added token of the tokenizer
isn't cut at all.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: White space other than blank and line feed.
ODD_SPACES = (
    "\u0009\u000d\u000b\u000c\u001c\u001d\u001e\u001f\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_ODD_ASCII = tuple(c for c in ODD_SPACES if c < "\x80")
_PAIRS = ("  ", " \n", "\n ", "\n\n")
_BEFORE_WORD = re.compile(r"(?= \S)")
#: Marks that are a pre-token of their own when they end a piece after a letter.
TAILS = frozenset(".,;:!?")


def byte_pieces(text: str) -> list[str]:
    """For byte-level pre-tokens, where a word takes the blank before it along."""
    odd = any(c in text for c in (_ODD_ASCII if text.isascii() else ODD_SPACES))
    if odd or "\0" in text or any(p in text for p in _PAIRS) or text[-1:] in (" ", "\n"):
        return _BEFORE_WORD.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def word_pieces(text: str) -> list[str]:
    """For tokenizers that drop white space."""
    return text.replace("\n", " ").split(" ")


class Encoder:
    """ids(texts) gives each text's ids as little-endian unsigned 32-bit integers (of a little-endian machine).

    They are the ids of `encode(text, add_special_tokens=False)`, the strings of added tokens included.
    Pieces are remembered in two generations of about `keep`: a full one becomes the older, whose
    pieces come back as they are met again, so frequent pieces are never encoded twice. Of a piece that
    is a run of letters and a mark, the letters are what is remembered and encoded; runs of letters go to the
    library many in one string, parted again at the tokens that begin or end a word.
    """

    def __init__(self, path: str, keep: int = 300_000, at_once: int = 500):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.keep, self.at_once = keep, at_once
        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        normalizer = self.tokenizer.normalizer
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.leads = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and normalizer is None
        self.cuts = self.leads or bool(suffix)
        self.lowers = normalizer is not None and normalizer.normalize_str("A") == "a"
        self.normal = normalizer.normalize_str if normalizer is not None else None
        self.pieces = byte_pieces if self.leads else word_pieces
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        if self.cuts:
            self.edge[[i for t, i in vocabulary.items() if (t.startswith("Ġ") if self.leads else t.endswith(suffix))]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> Iterator[bytes]:
        for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield array("I", found.ids).tobytes()

    def _letters(self, pieces: list[str]) -> Iterator[bytes]:
        """Ids of pieces that are runs of letters (blank-led ones, where a blank leads words)."""
        parts = [pieces[i : i + self.at_once] for i in range(0, len(pieces), self.at_once)]
        joined = ["".join(p) if self.leads else " ".join(p) for p in parts]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            at = np.flatnonzero(self.edge[ids])
            if len(at) != len(part):  # normalising made one of them something else than letters
                yield from self._whole(part)
                continue
            raw, at = ids.tobytes(), (at * 4).tolist() if self.leads else (at * 4 + 4).tolist()
            cuts = [*at, len(raw)] if self.leads else [0, *at]
            yield from (raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    def _is_letters(self, run: str) -> bool:
        """Letters before and after normalising: a letter whose normal form ends in a mark (İ) would draw in what follows."""
        return run.isalpha() and (run.isascii() or self.normal is None or self.normal(run).isalpha())

    def _learn(self, missing: Iterable[str]) -> None:
        """Puts the ids of pieces into self.known."""
        known, older, leads = self.known, self.older, self.leads
        letters: dict[str, None] = {}
        others: list[str] = []
        made: list[tuple[str, str, str]] = []
        for piece in missing:
            if (found := older.get(piece)) is not None:
                known[piece] = found
                continue
            mark = piece[-1:] if piece[-1:] in TAILS else ""
            run = piece[:-1] if mark else piece
            if not self._is_letters(run[1:] if leads and run[:1] == " " else "" if leads else run):
                others.append(piece)
                continue
            if self.lowers and run.isascii():
                run = run.lower()
            if run not in known:
                if (found := older.get(run)) is not None:
                    known[run] = found
                else:
                    letters[run] = None
            if run != piece:
                made.append((piece, run, mark))
        marks = {mark for *_, mark in made if mark and mark not in known}
        known.update(zip(letters, self._letters(list(letters)), strict=True))
        known.update(zip(marks, self._whole(list(marks)), strict=True))
        for i in range(0, len(others), 20_000):
            part = others[i : i + 20_000]
            known.update(zip(part, self._whole(part), strict=True))
        for piece, run, mark in made:
            known[piece] = known[run] + known[mark] if mark else known[run]

    def ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        cut: list[list[str] | str] = [t if not self.cuts or any(x in t for x in self.added) else self.pieces(t) for t in texts]
        used = set().union(*(c for c in cut if type(c) is list))
        missing = used.difference(self.known)
        if len(self.known) + len(missing) > self.keep:
            self.older, self.known, missing = self.known, {}, used
        self._learn(missing)
        get = self.known.__getitem__
        for pieces in cut:
            yield b"".join(map(get, pieces)) if type(pieces) is list else next(self._whole([pieces]))


@lru_cache(maxsize=2)
def encoder_of(path: str, keep: int = 300_000) -> Encoder:
    """One encoder a Python worker, whose tasks after the first find its pieces known."""
    return Encoder(path, keep)


def encoded(encoder: Encoder, texts: pa.Array, at_once: int = 128) -> Iterator[bytes]:
    """Ids of each text in order, null as empty, a bounded number of texts at a time."""
    for i in range(0, len(texts), at_once):
        yield from encoder.ids(t or "" for t in texts.slice(i, at_once).to_pylist())
