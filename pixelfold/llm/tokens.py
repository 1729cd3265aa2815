"""Token ids of whole texts from a tokenizers file, by the batch.

A word-level byte-pair tokenizer drops white space and never merges across it, so a text's ids are
those of its words in turn. Each distinct word is encoded once by the library and kept in a bounded
cache. Words of letters alone skip the library's normaliser and splitting: their normal form is
known, and the library's model gets them as its own byte-level step would spell them.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Entries of the word cache of one worker; it is emptied when full.
CACHE = 500_000
#: Letters of Latin-1 in lower case: each is its own normal form and its own lower case.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_TAIL = re.compile("([a-zß-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]+)")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level tokenizers write for a byte, by rule: printable bytes
    stand for themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


class WordEncoder(dict):
    """Maps a word without spaces to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.whole = Tokenizer.from_file(path)
        self.bare = self.whole.model
        self.letters = str.maketrans(_byte_letters())

    def _by_library(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
            self[""] = b""
        if _LETTERS.fullmatch(word):
            spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.bare.tokenize(spelled)], dtype="<u4").tobytes()
        elif m := _TAIL.fullmatch(word):  # a run of letters ends where punctuation begins
            ids = self[m[1]] + self[m[2]]
        else:
            ids = self._by_library(word)
        self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; none for a null."""
        if not text:
            return b""
        try:  # Latin-1 lower-cases letter by letter, so it may be done first
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_open: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a file; opened once."""
    if path not in _open:
        _open[path] = WordEncoder(path)
    return _open[path]
