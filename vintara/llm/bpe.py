"""Byte-level BPE by prefix dynamic programming.

For each prefix of a word's bytes there is exactly one token that the encoding of this
prefix ends with. The encoder stores that token for every prefix: ``last[i]`` is found
from the tokens that end at byte ``i`` as the one that may follow ``last`` of what
precedes it. A word's ids are read off backwards. Because ``last`` of a prefix doesn't
depend on what follows, a word can be appended to, or encoded again from an edit on,
without touching what stands before.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from vintara.llm.common import text_of
from vintara.llm.tokens import WordMemo


#: Lengths of beginnings whose tables are kept, longest first, and how many are.
BEGINNINGS = (9, 7, 5, 3)
MOST_BEGINNINGS = 200_000


class Vocabulary:
    """Ranks of byte strings; a lower rank merges first."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.rank.values()) + 1)
        for piece, rank in self.rank.items():
            self.bytes_of[rank] = piece
        self.longest = max(map(len, self.rank))
        self._parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        #: Pairs of tokens whose order was looked into, and the answer.
        self.known: dict[tuple[bytes, bytes], bool] = {}

    def parts(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes ``token``; None for a byte.

        They are what repeated merging leaves just before the last merge. A token that
        merging never makes is its own single part, paired with an empty one.
        """
        if token not in self._parts:
            pieces = [token[i : i + 1] for i in range(len(token))]
            while len(pieces) > 2:
                at = self._next_merge(pieces)
                if at is None:
                    break
                pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
            made = None if len(token) == 1 else tuple(pieces) if len(pieces) == 2 else (token, b"")
            self._parts[token] = made
        return self._parts[token]

    def _next_merge(self, pieces: list[bytes]) -> int | None:
        best = min(((self.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:]))), default=None)
        return None if best is None or best[0] == 1 << 60 else best[1]

    def may_follow(self, left: bytes, right: bytes) -> bool:
        """Whether merging leaves ``left + right`` as exactly these two tokens.

        It does if no merge crosses the border. Going back from the latest merge to the
        earliest, the border's neighbours are the last part of ``left`` and the first
        part of ``right``; a pair of neighbours that is itself a token would have been
        merged if its rank is below the rank that made either neighbour grow further.
        """
        if len(self.known) > 1_000_000:
            self.known.clear()
        holds = self._border_holds(left, right) if left else len(right) == 1 or bool(self.parts(right)[1])
        self.known[left, right] = holds
        return holds

    def _border_holds(self, left: bytes, right: bytes) -> bool:
        limit, rank = 1 << 60, self.rank
        while True:
            crossing = rank.get(left + right)
            if crossing is not None and crossing < limit:
                return False
            # Undo the later of the two merges that made the neighbours.
            a, b = rank[left], rank[right]
            if a > b:
                limit, parts = a, self.parts(left)
                if parts is None:
                    if (parts := self.parts(right)) is None:
                        return True
                    limit, right = b + 1, parts[0]
                else:
                    left = parts[1]
            else:
                limit, parts = b + 1, self.parts(right)
                if parts is None:
                    if (parts := self.parts(left)) is None:
                        return True
                    limit, left = a, parts[1]
                else:
                    right = parts[0]
            if not left or not right:
                return True


class PrefixTable:
    """The last token of every prefix of some bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self._vocabulary, self._data, self._last = vocabulary, b"", [b""]
        self.append(data)

    @classmethod
    def resumed(cls, vocabulary: Vocabulary, data: bytes, last: list[bytes]) -> PrefixTable:
        """The table of ``data`` from what :meth:`prefix` gave for it."""
        table = cls.__new__(cls)
        table._vocabulary, table._data, table._last = vocabulary, data, last.copy()
        return table

    def prefix(self, n: int) -> list[bytes]:
        """The last tokens of all prefixes up to ``n`` bytes."""
        return self._last[: n + 1]

    def append(self, more: bytes) -> None:
        """Add bytes at the end; nothing before is computed again."""
        v, last, start = self._vocabulary, self._last, len(self._data)
        data = self._data = self._data + more
        rank, known, longest = v.rank, v.known, v.longest
        for end in range(start + 1, len(data) + 1):
            for begin in range(max(0, end - longest), end):
                token = data[begin:end]
                if token in rank:
                    # Nothing stands before the first token: it must only make itself.
                    before = last[begin]
                    holds = known.get((before, token))
                    if v.may_follow(before, token) if holds is None else holds:
                        last.append(token)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte of the text")

    def edit(self, begin: int, end: int, new: bytes) -> None:
        """Replace ``[begin, end)``; prefixes up to ``begin`` stay as they are."""
        tail = new + self._data[end:]
        self._data = self._data[:begin]
        del self._last[begin + 1 :]
        self.append(tail)

    def ids(self) -> list[int]:
        found, at = [], len(self._data)
        while at:
            token = self._last[at]
            found.append(self._vocabulary.rank[token])
            at -= len(token)
        return found[::-1]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def table_memo(path: str) -> WordMemo:
    """A memo whose words are encoded by a :class:`PrefixTable`."""
    v = vocabulary(path)

    begun: dict[bytes, list[bytes]] = {}

    def encode(word: str) -> list[int]:
        # Words that begin alike share the tables of their beginnings.
        data = word.encode()
        for n in BEGINNINGS:
            if len(data) >= n and (last := begun.get(data[:n])) is not None:
                table = PrefixTable.resumed(v, data[:n], last)
                table.append(data[n:])
                break
        else:
            table = PrefixTable(v, data)
        if len(begun) > MOST_BEGINNINGS:
            begun.clear()
        for n in BEGINNINGS:
            if len(data) >= n and data[:n] not in begun:
                begun[data[:n]] = table.prefix(n)
        return table.ids()

    return WordMemo(encode)


def decode(ids: np.ndarray, path: str) -> bytes:
    """The bytes that ids stand for."""
    return b"".join(map(vocabulary(path).bytes_of.__getitem__, ids.tolist()))


def _encode_batches(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = table_memo(path)
    for batch in batches:
        n, ids_hash, bytes_hash = [], [], []
        for text in batch.column(1):
            ids = memo.ids(text.as_py())
            n.append(len(ids) // 4)
            ids_hash.append(hashlib.sha256(ids).hexdigest())
            bytes_hash.append(hashlib.sha256(decode(np.frombuffer(ids, "<u4"), path)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(bytes_hash, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def encode_round_trip(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, decode the ids: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    One row per input row, in no shuffle. Null is the empty text, which has no tokens.
    Repeated rows give repeated results; other columns are ignored.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    return rows.mapInArrow(
        lambda batches: _encode_batches(path, batches),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
