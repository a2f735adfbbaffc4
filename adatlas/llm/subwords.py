"""Ids of a public word-level tokenizer for whole columns of text, each distinct word being tokenized once in a task.

Words are runs of non-space bytes. The tokenizer drops white space and never joins across it, so that the ids of a text
are those of its words in order; tests hold this against the tokenizer's own result on whole texts.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import regex

from adatlas.llm.common import word_hashes, word_spans

#: How the tokenizer cuts a normalised word into pieces (fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Characters for which lower-casing and composing need no tables beyond Python's own.
PLAIN = regex.compile(r"[\x21-\x7e¡-ɏ]+")
#: Signs that are a piece of their own after letters.
ENDS = frozenset(".,;:!?)]}\"")


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class WordIds:
    """A tokenizer with a table of the words seen; when it passes `most` words, the half that was seen last stays."""

    def __init__(self, path: str, most: int = 1_000_000, pieces: int = 200_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.most, self.most_pieces = self.whole.model, most, pieces
        self.letters = "".join(byte_characters())
        self.pieces: dict[str, list[int]] = {}
        self.known, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.seen, self.now = np.zeros(0, np.uint32), 0
        self.pool = np.zeros(0, np.uint32)

    def word(self, word: str) -> list[int]:
        if not (word.isascii() and word.isprintable() or PLAIN.fullmatch(word)):
            return self.whole.encode(word, add_special_tokens=False).ids
        word = word.lower()
        if word.isalpha():
            return self.piece(word)
        if word[:-1].isalpha() and word[-1] in ENDS:
            return self.piece(word[:-1]) + self.piece(word[-1])
        out: list[int] = []
        for piece in PIECES.findall(word):
            out += self.piece(piece)
        return out

    def piece(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= self.most_pieces:
                self.pieces.clear()
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = self.pieces[piece] = [t.id for t in self.model.tokenize(shown)]
        return ids

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        ids = [self.word(w.decode()) for w in words]
        size = np.fromiter(map(len, ids), np.uint32, len(ids))
        begin = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))))
        at = np.searchsorted(self.known, hashes)
        new = ((self.known, hashes), (self.begin, begin.astype(np.uint32)), (self.size, size), (self.seen, np.full(len(ids), self.now, np.uint32)))
        self.known, self.begin, self.size, self.seen = (np.insert(a, at, b) for a, b in new)

    def _forget(self) -> None:
        """Keeps the half of the words that was seen last."""
        keep = np.zeros(len(self.known), bool)
        keep[np.argsort(-self.seen.astype(np.int64), kind="stable")[: self.most // 2]] = True
        begin, size = self.begin[keep].astype(np.int64), self.size[keep]
        upto = np.cumsum(size, dtype=np.int64) - size
        self.pool = self.pool[np.repeat(begin - upto, size) + np.arange(int(size.sum()))]
        self.known, self.begin, self.size, self.seen = self.known[keep], upto.astype(np.uint32), size, self.seen[keep]

    def encode(self, data: np.ndarray, offsets: np.ndarray, seen=None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text begins and ends in them.

        seen: is given the distinct word hashes, the place of each word in them, and the first word of each text.
        """
        begins, ends, first = word_spans(data, offsets)
        hashes = word_hashes(data, begins, ends)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if seen is not None:
            seen(distinct, back, first)
        if len(self.known) > self.most:
            self._forget()
        self.now += 1
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != distinct
        if new.any():
            raw = data.tobytes()
            self._learn(distinct[new], [raw[begins[i] : ends[i]] for i in where[new].tolist()])
            at = np.searchsorted(self.known, distinct)
        self.seen[at] = self.now
        begin, size = self.begin[at].astype(np.int64)[back], self.size[at].astype(np.int64)[back]
        upto = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[first]


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The tokenizer of this process for a file: a Python worker keeps its table of words from task to task."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = WordIds(path)
    return _LOADED[path]
