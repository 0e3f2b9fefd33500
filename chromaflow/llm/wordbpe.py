"""Exact, memoised encoding for the word-level BPE vocabulary.

The tokenizer splits a text into words that are encoded independently, so a
table from word to ids gives the same ids as encoding the text whole.  The
table is bounded and refilled from the tokenizer itself; texts with characters
whose normalisation is not one to one go to the tokenizer as they are.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: The table is emptied when it holds more words than this: about 160 MB, and the words of one text.
CACHE_WORDS = 800_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


def _chars(kind: str, last: int) -> str:
    return "".join(re.escape(chr(c)) for c in range(last + 1) if unicodedata.category(chr(c)).startswith(kind))


class WordBpe:
    #: The fast way holds for characters up to U+017F but U+0130, whose lower case has two.
    LAST = 0x17F

    def __init__(self, path: str | None = None, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path or default_path())
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        ends = np.zeros(self.tok.get_vocab_size(), dtype=bool)
        for token, i in self.tok.get_vocab().items():
            ends[i] = token.endswith("</w>")
        self.ends = ends
        letters, numbers = _chars("L", self.LAST), _chars("N", self.LAST)
        blank = r"\t\n\x0b\x0c\r \x85\xa0"
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{blank}{letters}{numbers}]+").findall
        self.beyond = re.compile("[^\\x00-\\u012f\\u0131-\\u017f]").search
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words

    def _direct(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _fill(self, missing: list[str]) -> None:
        ids = np.array(self.tok.encode(" ".join(missing), add_special_tokens=False).ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(missing):  # a word that ends otherwise: one by one
            for w in missing:
                self.cache[w] = self._direct(w)
            return
        raw, at = ids.tobytes(), 0
        for w, end in zip(missing, (ends * 4).tolist(), strict=True):
            self.cache[w] = raw[at:end]
            at = end

    def encode(self, text: str | None) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if (not text.isascii() and self.beyond(text)) or any(s in text for s in self.specials):
            return self._direct(text)
        words = self.words(text.lower())
        cache = self.cache
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            if len(cache) > self.cache_words:
                cache.clear()
            self._fill(list({w for w in words if w not in cache}))
            return b"".join([cache[w] for w in words])


@lru_cache(maxsize=2)
def shared(path: str) -> WordBpe:
    """One encoder a Python worker: its table serves the tasks that follow."""
    return WordBpe(path)
