"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter.

One edit leaves the first or the last half of a word as it is. So words are first listed by their
halves, in lists of their own for each length ``l``, to which words of ``l + 1`` come as those that may have
a letter more: four rows a word, which Spark groups. A list of more than ``LIST`` words is cut
again by the halves of the part that its words don't share, until that part is one letter; a task
holds one list at a time.

Within a list the part not shared is indexed by its q-grams and their positions. An edit spoils
at most ``q`` grams; all others of a word stand in a near word too, in the same place or, in the
longer word, one further. So near words share at least ``e - 2 * q + 1`` grams, ``e`` being the longer one's
letters there. For each word the postings of its ``q + 1`` rarest grams (any ``q + 1`` hold one that isn't spoiled)
are merged by a heap under these limits of position and length; words that come less often than the bound
allows, the grams left out taken as shared, are passed over, and the others are compared.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from heapq import merge

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.llm.common import saved, text_of

#: Length of a gram, where the part not shared is long enough.
Q = 3
MIN_LENGTH = 7
MIN_COUNT = 2
#: How often a word's form stands as often as the word, at least.
FORM_RATIO = 10
#: Words of a list beyond which it is cut by halves again.
LIST = 1024

#: Letters by their code in Latin-1, A-Z as a-z; all else ends a run.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def spoiled(doc_id: str, run: bytes) -> bytes:
    """``run`` (in Latin-1) without one letter wherever 31 divides the hash of id and run."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(f"{doc_id}:".encode()))
    return run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, misspell: bool = False, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of all words of ``min_length`` code points or more that stand ``min_count`` times or more.

    Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case. ``misspell`` takes a
    letter from some first (:func:`spoiled`; a null id counts as empty), as errors whose right form is known. Null
    texts have no words; every row counts, repeated ones too; counts are summed before they are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[bytes] = Counter()
            for name, body in zip(batch.column("id").to_pylist(), batch.column("text")):
                runs = body.as_py().encode("latin-1", "replace").translate(_LETTERS).split()
                # A run that is too short stays so without a letter.
                runs = [run for run in runs if len(run) >= min_length]
                if misspell:
                    runs = [run for run in (spoiled(name, run) for run in runs) if len(run) >= min_length]
                found.update(runs)
            words = [word.decode("latin-1") for word in found]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(F.coalesce(docs[doc_id].cast("string"), F.lit("")).alias("id"), text_of(docs, text).alias("text"))
    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def one_edit(a: str, b: str) -> bool:
    """Whether ``a`` and ``b``, as long or one longer, differ by exactly one edit."""
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) == len(b):
        return i < len(a) and a[i + 1 :] == b[i + 1 :]
    return a[i:] == b[i + 1 :]


def near_in_list(short: list[str], long: list[str], before: int, after: int) -> Iterator[tuple[str, str]]:
    """Near words of a list, each pair once.

    ``short`` are its words of one length, in order and each once, ``long`` those with a letter more; all have the first ``before``
    and the last ``after`` letters in common. Pairs within ``long`` are those of another list.
    """
    if not short:
        return
    length, words = len(short[0]), short + long
    middle = length - before - after
    q = max(1, min(Q, middle - 1))
    # Letters next to the part not shared belong to its grams.
    first, last = max(0, before - q + 1), length - after + min(after, q - 1)
    size = last - first
    postings: dict[tuple[str, int], list[int]] = {}
    for i, word in enumerate(words):
        for at in range(first, last - q + 1 + (i >= len(short))):
            postings.setdefault((word[at : at + q], at), []).append(i)
    n_grams = size - q + 1
    taken = min(n_grams, q + 1)
    # What must come up among the taken grams if all others are shared.
    bound_short, bound_long = (size + more - 2 * q + 1 - (n_grams - taken) for more in (0, 1))
    for i, word in enumerate(short):
        if bound_short < 1:  # one letter, which any other may stand for
            for j in range(i + 1, len(short)):
                yield word, short[j]
        ranked = []
        for at in range(first, last - q + 1):
            gram = word[at : at + q]
            same, further = postings[gram, at], postings.get((gram, at + 1))
            ranked.append((len(same) + (len(further) if further else 0), same, further))
        ranked.sort(key=_rarity)
        lists = []
        for _, same, further in ranked[:taken]:
            if same[-1] > i:
                lists.append(same[bisect_right(same, i) :])
            # A gram one place further is that of a longer word.
            if further and further[-1] >= len(short):
                lists.append(further[bisect_right(further, len(short) - 1) :])
        seen, times = -1, 0
        for j in merge(*lists, (len(words),)):
            if j == seen:
                times += 1
                continue
            if seen >= 0:
                if seen < len(short):
                    if times >= bound_short > 0 and one_edit(word[first:last], words[seen][first:last]):
                        yield word, words[seen]
                elif times >= bound_long and one_edit(word[first:last], words[seen][first : last + 1]):
                    yield word, words[seen]
            seen, times = j, 1


def _rarity(ranked: tuple) -> int:
    return ranked[0]


def _first_found(short: str, other: str, path: str) -> bool:
    """Whether no other list has the pair: where both halves are shared the first one's list has it.

    ``path`` has a letter for each cut that led to the list: ``a`` kept the first half of the part not shared, ``b`` the last.
    """
    before, after = 0, 0
    for cut in path:
        half = (len(short) - before - after) // 2
        if cut == "a":
            before += half
        elif short[: before + half] == other[: before + half]:
            return False
        else:
            after = len(short) - before - half
    return True


def _cut(rows: DataFrame) -> DataFrame:
    """``rows`` (``path, before, after, length, word, n``) in the two lists that theirs is cut into, with their ``key``."""
    kept_first = F.col("before") + F.floor((F.col("length") - F.col("before") - F.col("after")) / 2).cast("int")
    kept_last = F.col("length") - kept_first
    lists = [
        F.struct(F.concat("path", F.lit("a")).alias("path"), kept_first.alias("before"), F.col("after").alias("after")),
        F.struct(F.concat("path", F.lit("b")).alias("path"), F.col("before").alias("before"), kept_last.alias("after")),
    ]
    rows = rows.withColumn("list", F.explode(F.array(*lists))).select("list.*", "length", "word", "n")
    shared = F.expr("left(word, before)"), F.expr("right(word, after)")
    return rows.select(F.concat_ws(" ", "length", "path", *shared).alias("key"), *rows.columns)


def _compare(limit: int):
    """Near pairs of a partition's lists, which come one after the other.

    A list of more than ``limit`` words comes back as it is, one word a row, ``b`` being null; but not one
    whose words differ in one letter, as it has as many as there are letters, or pairs of letters.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole, bound = None, True, 0.0
        held: list[tuple[str, int]] = []
        out: list[tuple] = []

        def block() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[] for _ in _PAIR]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PAIR.values())], names=list(_PAIR))

        def give_back() -> None:
            out.extend((word, n, None, None, *now[1:]) for word, n in held)
            held.clear()

        def close() -> None:
            if not whole:
                give_back()
            elif len(held) > 1:
                _, path, before, after, length = now
                times = dict(held)
                words = sorted(times)
                short, long = [w for w in words if len(w) == length], [w for w in words if len(w) > length]
                for a, b in near_in_list(short, long, before, after):
                    if _first_found(a, b, path):
                        out.append((a, times[a], b, times[b], None, None, None, None))
            held.clear()

        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("key", "path", "before", "after", "length", "word", "n")}
            for key, path, before, after, length, word, n in zip(*columns.values()):
                if now is None or key != now[0]:
                    close()
                    now, whole = (key, path, before, after, length), True
                    bound = limit if length - before - after > 1 else float("inf")
                held.append((word, n))
                if len(held) > bound:
                    whole = False
                    give_back()
            yield block()
        close()
        yield block()

    return compare


_PAIR = {
    "a": pa.string(), "n_a": pa.int64(), "b": pa.string(), "n_b": pa.int64(),
    "path": pa.string(), "before": pa.int32(), "after": pa.int32(), "length": pa.int32(),
}
_PAIR_SQL = "a string, n_a long, b string, n_b long, path string, before int, after int, length int"


def near_words(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: all pairs of ``words`` (``word, n``; each word once) one edit apart, each pair once.

    Words of one code point or none have no halves and take no part.
    """
    none = F.lit(0).alias
    lengths = F.array(F.length("word"), F.length("word") - 1)
    rows = words.select(F.lit("").alias("path"), none("before"), none("after"), F.explode(lengths).alias("length"), "word", "n")
    rows = rows.where("length(word) > 1")
    found = None
    while True:
        dealt = _cut(rows).repartition("key").sortWithinPartitions("key")
        made = saved(dealt.mapInArrow(_compare(LIST), _PAIR_SQL))
        pairs = made.where("b IS NOT NULL").select("a", "n_a", "b", "n_b")
        found = pairs if found is None else found.unionByName(pairs)
        back = made.where("b IS NULL")
        if back.isEmpty():
            return found
        rows = back.select("path", "before", "after", "length", F.col("a").alias("word"), F.col("n_a").alias("n"))


def spelling_forms(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each of ``words`` (``word, n``; each word once).

    A word's form is its near word of largest ``n``, of several the first in code-point order, if that stands
    at least ``ratio`` times as often; else null. The root is where forms lead in the end,
    the word itself if it has none. An empty table gives no rows.
    """
    words = saved(words.select("word", "n"))
    pairs = near_words(words)
    near = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m"))
    )
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    often = -F.col("best.m") >= ratio * F.col("n")
    forms = saved(
        words.join(best, "word", "left").select(
            "word",
            F.when(often, F.col("best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(often, -F.col("best.m")).alias("form_n"),
        )
    )
    # Each step multiplies n, so a chain is as long as n has digits; every round doubles what is followed.
    roots = saved(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        onwards = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = saved(roots.join(onwards, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
