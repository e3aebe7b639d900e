"""Best-fit packing of token sequences after dominance reduction.

The number of sequences depends only on how many pieces of each length there are, and
lengths are at most ``capacity``. So the plan is made on the driver from a histogram of
at most ``capacity`` counts, whatever the size of the corpus, and is a short list of
*patterns*: these lengths share a sequence, so many times. The pieces themselves stay
distributed: each finds its rank among the pieces of its length, and the rank says which
sequence of which pattern it belongs to.

The plan first fixes sets that dominate every other choice (Martello and Toth): a piece
that nothing fits beside, a pair that fills a sequence exactly, a largest partner where
only one more piece fits, and the corresponding cases of two more pieces. Best-fit
decreasing packs what is left.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintara.llm.common import saved, text_of
from vintara.llm.tokens import library_memo

CAPACITY = 2048
END_ID = 0
#: Pieces ranked together within a length; a bound on what one task sorts.
BUCKET_ROWS = 20_000

#: A set of lengths and how often it is used.
Pattern = tuple[tuple[int, ...], int]


class _Lengths:
    """Counts of lengths, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: n for k, n in counts.items() if n > 0}
        self.order = sorted(self.count)

    def at_most(self, limit: int, taken: tuple[int, ...] = ()) -> int | None:
        """The largest length up to ``limit`` that is there besides ``taken``."""
        i = bisect_right(self.order, limit) - 1
        while i >= 0 and self.count[self.order[i]] <= taken.count(self.order[i]):
            i -= 1
        return self.order[i] if i >= 0 else None

    def smallest(self, k: int, taken: tuple[int, ...]) -> list[int]:
        """The ``k`` smallest pieces besides ``taken``; fewer if there aren't so many."""
        found: list[int] = []
        for length in self.order:
            found += [length] * min(k - len(found), self.count[length] - taken.count(length))
            if len(found) == k:
                break
        return found

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for length in lengths:
            self.count[length] -= times
            if not self.count[length]:
                del self.count[length], self.order[bisect_left(self.order, length)]

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(self.count[x] // lengths.count(x) for x in set(lengths))


def _best_pair(have: _Lengths, largest: int, room: int) -> tuple[int, int] | None:
    """Of two pieces besides one of ``largest``, those with the largest sum within ``room``."""
    best = None
    for x in reversed(have.order[: bisect_right(have.order, room)]):
        if best and 2 * x <= sum(best):
            break
        if have.count[x] > (x == largest):
            y = have.at_most(min(x, room - x), (largest, x))
            if y is not None and (best is None or x + y > sum(best)):
                best = (x, y)
    return best


def dominating_set(have: _Lengths, largest: int, capacity: int) -> tuple[int, ...] | None:
    """A set with the largest length that some optimal packing holds, if one is certain."""
    own, room = (largest,), capacity - largest
    partner = have.at_most(room, own)
    if partner is None:
        return own
    least = have.smallest(3, own)
    if partner == room or len(least) < 2 or least[0] + least[1] > room:
        # Whatever else stands beside the largest fits in the partner's place.
        return own + (partner,)
    if len(least) == 3 and sum(least) <= room:
        return None
    # At most two pieces fit beside the largest one.
    pair = _best_pair(have, largest, room)
    if pair is None or sum(pair) <= partner:
        return own + (partner,)
    second = have.at_most(room - partner, own + (partner,))
    if second is not None:
        # {partner, second} replaces {x, y} if neither x nor y is larger than its match.
        rival = max(
            (
                y
                for x in have.order[: bisect_right(have.order, partner)]
                if have.count[x] > (x == largest)
                and (y := have.at_most(min(x, room - x), (largest, x))) is not None
            ),
            default=0,
        )
        if rival <= second:
            return own + (partner, second)
    return None


def reduce_by_dominance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], dict[int, int]]:
    """The patterns that dominance fixes, and the counts that are left."""
    have, fixed = _Lengths(counts), []
    some = True
    while some:
        # Every length in falling order; what is fixed narrows what fits beside those passed over before.
        some = False
        for length in have.order[::-1]:
            while have.count.get(length):
                chosen = dominating_set(have, length, capacity)
                if chosen is None:
                    break
                # Taking pieces only narrows what else fits, so the set dominates each time anew.
                times = have.times(chosen)
                have.take(chosen, times)
                fixed.append((chosen, times))
                some = True
    return fixed, have.count


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best-fit decreasing over counts of lengths.

    Open sequences with the same content are one group. Each length, from the largest,
    fills the groups with the least room that it fits in, then opens new sequences.
    """
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def add(content: tuple[int, ...], times: int) -> None:
        room = capacity - sum(content)
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((content, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                if left >= each:
                    add((length,) * each, left // each)
                if left % each:
                    add((length,) * (left % each), 1)
                break
            room = rooms[i]
            content, times = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[i]
            each = room // length
            full = min(times, left // each)
            if full:
                add(content + (length,) * each, full)
                left -= full * each
            if times > full:
                if left and left < each:
                    add(content + (length,) * left, 1)
                    left, full = 0, full + 1
                if times > full:
                    add(content, times - full)
    return [p for listed in groups.values() for p in listed]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that place every counted piece in sequences of ``capacity``."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit_decreasing(rest, capacity)


def _cut(path: str, capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo, end = library_memo(path), np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        rows: list[list[int]] = [[], [], [], [], []]
        for at, text in enumerate(batch.column(1)):
            data = memoryview(memo.ids(text.as_py()) + end)
            n, start = len(data) // 4, 0
            first = n % capacity or capacity
            for piece in range(-(-n // capacity)):
                length = first if piece == 0 else capacity
                crc = zlib.crc32(data[4 * start : 4 * (start + length)])
                for column, value in zip(rows, (at, piece, start, length, crc)):
                    column.append(value)
                start += length
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32())]
            + [pa.array(x, pa.int64()) for x in rows[2:]],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every text.

    A text's ids are those of the vocabulary, then the end id; so the null or empty
    text is one piece of length 1. Only longer texts are cut; their first piece is the
    shorter one.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    return rows.mapInArrow(
        lambda batches: _cut(path, capacity, batches),
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Which of several pieces of one length goes where is decided by ``doc_id``, ``piece``
    and then any order; ties and repeated rows get places of their own. An empty table
    gives no rows. Sequences have no gaps and start at offset 0.
    """
    spark = pieces.sparkSession
    pieces = saved(pieces)
    by_length = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = {r["length"]: r["count"] for r in by_length}
    slots, first_sequence, ranked = [], 0, dict.fromkeys(counts, 0)
    for content, times in plan(counts, capacity):
        offset = 0
        for length, same in groupby(content):
            each = len(list(same))
            slots.append((length, ranked[length], ranked[length] + times * each, each, first_sequence, offset))
            ranked[length] += times * each
            offset += length * each
        first_sequence += times
    table = spark.createDataFrame(
        slots, "_length long, _low long, _high long, _each long, _first long, _offset long"
    )
    # Ranks within a length, without one task for a common length: ranks within small
    # buckets, moved by what the buckets before hold.
    n_buckets = 1 + sum(counts.values()) // BUCKET_ROWS
    bucketed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)))
    keys = ["length", "_bucket"]
    before = (
        bucketed.groupBy(keys)
        .count()
        .withColumn(
            "_before",
            F.sum("count").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("count"),
        )
        .drop("count")
    )
    ranks = bucketed.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "piece", "ids_crc32")) - 1
    )
    placed = ranks.join(before, keys).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # A length has a slot in each pattern that holds it; the patterns depend on the
    # capacity and not on how many pieces there are.
    within = F.col("_rank") - F.col("_low")
    return placed.join(
        F.broadcast(table),
        (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")),
    ).select(
        *pieces.columns,
        (F.col("_first") + F.floor(within / F.col("_each"))).alias("sequence_id"),
        (F.col("_offset") + within % F.col("_each") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut the texts of ``docs`` and pack the pieces."""
    return pack(cut_pieces(docs, capacity, path, doc_id, text), capacity)
