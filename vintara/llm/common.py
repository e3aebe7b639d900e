"""Shared pieces of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintara.storage import saved, shared_dir, shared_path

__all__ = ["bound", "running_fold", "saved", "shared_dir", "shared_path", "slices_of", "text_of"]


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The text column with null read as empty."""
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Entries of one chunk of a running fold.
CHUNK = 128


def running_fold(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The folds of an array up to each entry, that included; ``combine`` is associative.

    A list that grows entry by entry is copied for each. Here only lists of a chunk's length grow, and one
    with an entry a chunk.
    """

    def folds(some: Column, start: Column) -> Column:
        state = F.struct(start.alias("now"), F.slice(F.array(zero), 1, 0).alias("found"))

        def step(acc: Column, x: Column) -> Column:
            now = combine(acc["now"], x)
            return F.struct(now.alias("now"), F.concat(acc["found"], F.array(now)).alias("found"))

        return F.aggregate(some, state, step, lambda acc: acc["found"])

    def chunked(all_of: Column) -> Column:
        last = F.floor((F.size(all_of) - 1) / CHUNK).cast("int")
        return F.when(F.size(all_of) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(all_of, i * CHUNK + 1, CHUNK))).otherwise(
            F.slice(F.array(all_of), 1, 0)
        )

    def joined(chunks: Column) -> Column:
        upto = folds(F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, b: combine(a, b))), zero)
        each = lambda u: F.transform(chunks, lambda c, i: folds(c, F.coalesce(F.get(u, i - 1), zero)))
        return F.flatten(bound(upto, each))

    return bound(values, lambda v: bound(chunked(v), joined))


#: Characters of one block of a text that is cut at many places.
TEXT_BLOCK = 4096


def slices_of(text: Column, body: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """``body`` with a function that cuts ``text`` from one place to another, in code points from 0.

    Places in a text are found by counting its characters. They are counted once a block, and a cut counts in its own block.
    """
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.length(text) / TEXT_BLOCK).cast("int")), lambda i: F.substring(text, i * TEXT_BLOCK + 1, F.lit(TEXT_BLOCK))
    )

    def cutter(cut: Column) -> Column:
        def piece(begin: Column, end: Column) -> Column:
            first = F.floor(begin / TEXT_BLOCK).cast("int")
            last = F.floor(F.greatest(end - 1, begin) / TEXT_BLOCK).cast("int")
            some = F.array_join(F.slice(cut, first + 1, last - first + 1), "")
            return F.substring(some, begin - first * TEXT_BLOCK + 1, end - begin)

        return body(piece)

    return bound(blocks, cutter)
