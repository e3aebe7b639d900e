"""Sorted-string-table shards of token ids.

A shard file holds documents in ascending order of their key, in this layout (all
integers little-endian, ``varint`` with seven bits a byte, low bits first):

* data blocks of about ``block_bytes``, each compressed by zstd. A block holds entries:
  varint length of the prefix shared with the key before (0 for a block's first), varint
  length of the rest of the key, varint number of ids, the rest of the key, the ids as
  unsigned 32-bit integers;
* the Bloom filter over the keys;
* the sparse index: for each block its first key (with a length byte), its offset and
  its length (two unsigned 64-bit integers);
* a footer of fixed size: offset and length of the filter, offset and length of the
  index, number of entries, number of ids, hash count of the filter, ``MAGIC``.

A key is ordered as the identifiers are: a byte that is 0 for null, the identifier as a
big-endian integer with its sign bit turned over, and a 32-bit number that tells apart
rows with the same identifier.
"""

from __future__ import annotations

import math
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.llm.common import text_of
from vintara.llm.tokens import library_memo

MAGIC = b"VSSTABL1"
FOOTER = struct.Struct("<QQQQQQI8s")
BLOCK_BYTES = 256 * 1024
BITS_PER_KEY = 10
END_ID = 0
#: Documents in a shard, about.
SHARD_DOCS = 10_000


def key_of(doc_id: int | None, repeat: int) -> bytes:
    """The key of the ``repeat``-th row with this identifier."""
    if doc_id is None:
        return b"\0" + bytes(8) + struct.pack(">I", repeat)
    return b"\1" + struct.pack(">QI", doc_id + (1 << 63), repeat)


def identifier_of(key: bytes) -> int | None:
    return struct.unpack_from(">Q", key, 1)[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


class Bloom:
    """A Bloom filter by double hashing."""

    def __init__(self, bits: np.ndarray, hashes: int):
        self.bits, self.hashes = bits, hashes

    @classmethod
    def of(cls, keys: list[bytes]) -> Bloom:
        size = max(64, len(keys) * BITS_PER_KEY + 7 & ~7)
        made = cls(np.zeros(size // 8, np.uint8), max(1, round(BITS_PER_KEY * math.log(2))))
        for key in keys:
            for bit in made._places(key):
                made.bits[bit >> 3] |= 1 << (bit & 7)
        return made

    def _places(self, key: bytes) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key)
        a, b, n = h & (1 << 64) - 1, h >> 64 | 1, len(self.bits) * 8
        return [(a + i * b) % n for i in range(self.hashes)]

    def may_hold(self, key: bytes) -> bool:
        return all(self.bits[bit >> 3] >> (bit & 7) & 1 for bit in self._places(key))


class ShardWriter:
    """Writes entries given in ascending order of their keys.

    It holds one block, the index and the keys for the filter: a few dozen bytes for
    each document besides the block.
    """

    def __init__(self, out, block_bytes: int = BLOCK_BYTES):
        self._out, self._limit, self._at = out, block_bytes, 0
        self._block, self._size, self._before, self._first = [], 0, b"", b""
        self._index, self._keys, self._ids = [], [], 0
        self._zstd = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes) -> None:
        if self._keys and key <= self._keys[-1]:
            raise ValueError("keys must ascend")
        if not self._block:
            self._first, self._before = key, b""
        shared = 0
        while shared < min(len(key), len(self._before)) and key[shared] == self._before[shared]:
            shared += 1
        head = _varint(shared) + _varint(len(key) - shared) + _varint(len(ids) // 4) + key[shared:]
        self._block += [head, ids]
        self._size += len(head) + len(ids)
        self._before = key
        self._keys.append(key)
        self._ids += len(ids) // 4
        if self._size >= self._limit:
            self._flush()

    def _put(self, data: bytes) -> int:
        self._out.write(data)
        self._at += len(data)
        return len(data)

    def _flush(self) -> None:
        if self._block:
            at = self._at
            self._index.append((self._first, at, self._put(self._zstd.compress(b"".join(self._block)))))
            self._block, self._size = [], 0

    def finish(self) -> tuple[int, int]:
        """Write the filter, the index and the footer; the numbers of entries and ids."""
        self._flush()
        bloom, filter_at = Bloom.of(self._keys), self._at
        filter_size = self._put(bloom.bits.tobytes())
        index_at = self._at
        index_size = self._put(b"".join(bytes([len(k)]) + k + struct.pack("<QQ", at, n) for k, at, n in self._index))
        self._put(FOOTER.pack(filter_at, filter_size, index_at, index_size, len(self._keys), self._ids, bloom.hashes, MAGIC))
        return len(self._keys), self._ids


class ShardReader:
    """Reads a shard from an open seekable file."""

    def __init__(self, file, size: int):
        self._file = file
        file.seek(size - FOOTER.size)
        at, n, index_at, index_n, self.entries, self.ids, hashes, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        file.seek(at)
        self.bloom = Bloom(np.frombuffer(file.read(n), np.uint8), hashes)
        file.seek(index_at)
        data, i, self._index = file.read(index_n), 0, []
        while i < len(data):
            key = data[i + 1 : i + 1 + data[i]]
            self._index.append((key, *struct.unpack_from("<QQ", data, i + 1 + len(key))))
            i += 17 + len(key)

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, n = self._index[i]
        self._file.seek(at)
        data, at, key = zstandard.ZstdDecompressor().decompress(self._file.read(n)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n_ids, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + 4 * n_ids]
            at += 4 * n_ids

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self._index)):
            yield from self._block(i)

    def get(self, doc_id: int | None, repeat: int = 0) -> np.ndarray | None:
        """The ids of one document, or None: filter, then binary search, then one block."""
        key = key_of(doc_id, repeat)
        if not self.bloom.may_hold(key):
            return None
        i = bisect_right(self._index, key, key=lambda entry: entry[0]) - 1
        return next((np.frombuffer(ids, "<u4") for k, ids in self._block(i) if k == key), None) if i >= 0 else None


def open_shard(uri: str) -> ShardReader:
    where, path = fs.FileSystem.from_uri(uri)
    return ShardReader(where.open_input_file(path), where.get_file_info(path).size)


def _write(folder: str, path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo, end = library_memo(path), np.array([END_ID], "<u4").tobytes()
    context = TaskContext.get()
    where, base = fs.FileSystem.from_uri(folder)
    shard = context.partitionId()
    # Each attempt writes a file of its own; a whole one takes the shard's name.
    name, part = f"{base}/shard-{shard:06d}.sst", f"{base}/attempt-{shard:06d}-{context.taskAttemptId()}"
    where.create_dir(base, recursive=True)
    writer = before = None
    repeat = 0
    with where.open_output_stream(part) as out:
        writer = ShardWriter(out)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                repeat = repeat + 1 if (doc_id,) == before else 0
                before = (doc_id,)
                writer.add(key_of(doc_id, repeat), memo.ids(text.as_py()) + end)
        entries, ids = writer.finish()
    if where.get_file_info(name).type != fs.FileType.NotFound:
        where.delete_file(name)
    where.move(part, name)
    yield pa.RecordBatch.from_pydict({"shard": [shard], "entries": [entries], "ids": [ids]})


def write_shards(docs: DataFrame, folder: str, n_shards: int | None = None, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of every text, and an end id, to shards below ``folder``.

    ``folder`` is a URI that driver and executors share. Shards hold ranges of ``doc_id``
    in ascending order (null first), so shard after shard all identifiers ascend. Rows
    that share an identifier stay apart, in any order. Returns
    ``shard, entries, ids, first_id``, one row per shard file, where ``first_id`` is
    the number of ids in all shards before. An empty table makes one empty shard or none.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    n_shards = n_shards or 1 + docs.count() // SHARD_DOCS
    # The hash only splits an identifier that very many rows share.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    written = (
        rows.repartitionByRange(n_shards, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(lambda batches: _write(folder, path, batches), "shard long, entries long, ids long")
        .collect()  # one row per shard
    )
    table, total = [], 0
    for shard, entries, ids in sorted(map(tuple, written)):
        table.append((shard, entries, ids, total))
        total += ids
    return docs.sparkSession.createDataFrame(table, "shard long, entries long, ids long, first_id long")


def _read(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, start in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            rows: list[list] = [[], [], [], []]
            for key, ids in open_shard(f"{folder}/shard-{shard:06d}.sst"):
                n = len(ids) // 4
                for column, value in zip(rows, (identifier_of(key), start, n, zlib.crc32(ids))):
                    column.append(value)
                start += n
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the shard files."""
    n = max(1, shards.count())
    return (
        shards.select("shard", "first_id")
        .repartition(n, "shard")
        .mapInArrow(lambda batches: _read(folder, batches), "doc_id long, start long, n_tokens long, ids_crc32 long")
    )
