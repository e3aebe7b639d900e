"""Token ids of a byte-level BPE vocabulary, word by word.

The vocabulary's splitting pattern cuts a text into words that are encoded apart from
each other, so a worker encodes each word it meets once and remembers the ids.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex

#: Words remembered by one worker; it starts anew when they are this many.
MEMO_WORDS = 400_000
#: Characters up to which a word is remembered, so that many words bound the bytes as well.
MEMO_CHARS = 200

#: Texts of these characters only can be split by the faster of the two engines: there
#: its classes for letters, digits and spaces are the same as the Unicode categories.
_OTHER = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_BIG = sys.byteorder == "big" or array("I").itemsize != 4
_FULL = regex.compile(public_tokenizers.PATTERN)


def split_words(text: str) -> list[str]:
    """The matches of the vocabulary's pattern, which cover the text."""
    return _FULL.findall(text) if _OTHER.search(text) else _FAST.findall(text)


class WordMemo(dict):
    """Words and their ids, as little-endian unsigned 32-bit integers.

    A word that isn't there yet is encoded and, unless it is very long, remembered.
    """

    def __init__(self, encode_word: Callable[[str], list[int]], limit: int = MEMO_WORDS):
        super().__init__()
        self._encode, self._limit = encode_word, limit

    def __missing__(self, word: str) -> bytes:
        ids = self._encode(word)
        made = np.array(ids, "<u4").tobytes() if _BIG else array("I", ids).tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= self._limit:
                self.clear()
            self[word] = made
        return made

    def ids(self, text: str) -> bytes:
        """The ids of a whole text."""
        return b"".join(map(self.__getitem__, split_words(text)))


def _byte_alphabet() -> dict[int, str]:
    """The visible character that stands for each byte in the vocabulary file.

    Bytes that Latin-1 shows as a visible character stand for themselves; the others
    take the characters from U+0100 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def library_memo(path: str) -> WordMemo:
    """A memo over the BPE model of the ``tokenizers`` library.

    Strings of special tokens are ordinary text.
    """
    from tokenizers import Tokenizer

    tokenize, alphabet = Tokenizer.from_file(path).model.tokenize, _byte_alphabet()
    return WordMemo(lambda word: [t.id for t in tokenize(word.encode().decode("latin-1").translate(alphabet))])
