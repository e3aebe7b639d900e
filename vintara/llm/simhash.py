"""Near-duplicates by SimHash fingerprints and deletion-variant signatures.

Fingerprints of 64 bits link at ``DISTANCE`` (4) or fewer differing bits. Cut into three
segments, two linked fingerprints differ by at most one bit in some segment. So each
segment is indexed once for each of its bits, with this bit left out: a segment that
differs by at most one bit agrees in one of these variants. An equality join on
variants finds all pairs, which are then verified.

Work is on distinct fingerprints, so copies cost nothing. Where a variant holds many
fingerprints, its pairs aren't listed: all are first compared with one of them, which
joins most into components, and only members of different components are compared
after that. No link between components is missed. Groups of a variant are handled by
windows over one sort, whose rows are 64 for each fingerprint at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.llm.common import saved, text_of
from vintara.llm.components import connected_components
from vintara.llm.exact import frequent_values

WORDS = 4
SEED = 42
DISTANCE = 4
#: Fingerprints of a variant up to which all its pairs are compared at once.
SMALL = 8
#: First bit and width of each segment: ``DISTANCE // 3`` is 1.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit integer; 0 for a text without words.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, as the contract wants.
    """
    found = text.encode().lower().split()
    if not found:
        return 0
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    ends = list(accumulate(map(len, found), lambda end, size: end + 1 + size))
    starts = [0] + [end + 1 for end in ends]
    digest = xxhash.xxh64_digest
    data = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[:n], ends[min(words, len(found)) - 1 :])])
    bits = np.unpackbits(np.frombuffer(data, np.uint8)).reshape(n, 64)
    over_half = np.add.reduce(bits, axis=0, dtype=np.int32) * 2 > n
    return int(np.packbits(over_half).view(">i8")[0])


def _fingerprints(words: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_py(), words, seed) for t in batch.column(1)]
        columns = [batch.column(0), batch.column(2), pa.array(prints, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp`` for each row; null is the empty text."""
    whole = text_of(docs, text)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("text_hash"))
    return rows.mapInArrow(lambda b: _fingerprints(words, seed, b), "doc_id long, text_hash long, fp long")


def variant_keys(fp: Column) -> Column:
    """The 64 keys of a fingerprint: which bit is left out, and the rest of its segment."""
    keys = []
    for low, width in SEGMENTS:
        segment = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        keys += [
            segment.bitwiseAND(F.lit(~(1 << bit))).bitwiseOR(F.lit((low + bit) << 22)) for bit in range(width)
        ]
    return F.array(*keys)


def _close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def _variants(prints: DataFrame) -> DataFrame:
    return prints.withColumn("key", F.explode(variant_keys(F.col("fp"))))


def _whole_variant(*order: str):
    """All rows of a variant; with an order that a window beside it may sort by."""
    return Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _random_member(*fields: str) -> Column:
    """Fields of some member, another one in each variant.

    The same hub everywhere would link a dense group no better than a single variant.
    """
    return F.min(F.struct(F.xxhash64("fp", "key").alias("hash"), *fields)).over(_whole_variant("fp"))


def _first_links(prints: DataFrame) -> DataFrame:
    """Verified links ``a, b``: all of small variants, and those to a hub of large ones."""
    ordered = Window.partitionBy("key").orderBy("fp")
    rows = (
        _variants(prints)
        .withColumn("n", F.count(F.lit(1)).over(_whole_variant("fp")))
        .withColumn("hub", _random_member("fp")["fp"])
        .withColumns({f"b{k}": F.lag("fp", k).over(ordered) for k in range(1, SMALL)})
        .where("n > 1")
    )
    small = F.col("n") <= SMALL
    links = {f"b{k}": F.when(small & _close(F.col("fp"), F.col(f"b{k}")), F.col(f"b{k}")) for k in range(1, SMALL)}
    links["hub"] = F.when(~small & (F.col("fp") != F.col("hub")) & _close(F.col("fp"), F.col("hub")), F.col("hub"))
    found = saved(rows.select(F.col("fp").alias("a"), *(c.alias(n) for n, c in links.items())).where(F.coalesce(*links).isNotNull()))
    return reduce(
        DataFrame.unionByName, (found.select("a", F.col(n).alias("b")).where("b IS NOT NULL") for n in links)
    )


def linked_components(prints: DataFrame) -> DataFrame:
    """``fp, root`` of all fingerprints that link to another; ``prints`` has distinct ``fp``."""
    roots = saved(connected_components(_first_links(prints)))

    # What is left: links within large variants between fingerprints of different components.
    labelled = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("label"))
    whole = _whole_variant("fp")
    left = saved(
        _variants(labelled)
        .withColumn("n", F.count(F.lit(1)).over(whole))
        .withColumn("mixed", F.min("label").over(whole) != F.max("label").over(whole))
        .withColumn("main", _random_member("label")["label"])
        .where((F.col("n") > SMALL) & F.col("mixed"))
        .select("key", "fp", "label", "main")
    )
    x, y = left.where("label <> main").alias("x"), left.alias("y")
    # Each pair once: with the main component, which most often is the largest, or from
    # the smaller label. The join gives verified pairs only.
    more = x.join(
        y,
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.label") != F.col("y.label"))
        & ((F.col("y.label") == F.col("y.main")) | (F.col("x.label") < F.col("y.label")))
        & _close(F.col("x.fp"), F.col("y.fp")),
    ).select(F.col("x.label").alias("a"), F.col("y.label").alias("b"))
    names = saved(connected_components(more.distinct()).select(F.col("node").alias("label"), F.col("root").alias("top")))
    # Of all fingerprints, those that either step linked.
    return (
        labelled.join(names, "label", "left")
        .join(roots.select(F.col("node").alias("fp"), F.lit(True).alias("_linked")), "fp", "left")
        .where("top IS NOT NULL OR _linked")
        .select("fp", F.coalesce("top", "label").alias("root"))
    )


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp, component_id`` for each row.

    ``component_id`` is the smallest id reachable over links, the row's own included;
    null ids are passed over (a component of only such has null). Null texts are empty;
    all texts without words share fingerprint zero. Repeated rows come out as often as
    they are there. Columns besides the two are ignored; an empty table gives no rows.
    """
    rows = saved(fingerprints(docs, words, seed, doc_id, text))
    prints = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = saved(linked_components(prints.select("fp")))
    ids = (
        roots.join(prints, "fp")
        .groupBy("root")
        .agg(F.min("first_id").alias("component_id"))
        .join(roots, "root")
        .select("fp", "component_id")
    )
    of_print = prints.join(ids, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    # A fingerprint of very many rows is looked up by broadcast, the others by shuffle.
    frequent = saved(frequent_values(rows, "fp"))
    hot = rows.join(F.broadcast(of_print.join(F.broadcast(frequent), "fp")), "fp")
    cold = rows.join(F.broadcast(frequent), "fp", "left_anti").join(of_print, "fp")
    return hot.unionByName(cold).select("doc_id", "text_hash", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, whole.

    If rows repeat with that id and text, one stays. A row with a null id stays if it is
    alone in its component or all its component's ids are null (one for each text).
    """
    found = near_duplicates(docs, words, seed, doc_id, text)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("_vintara_id"), F.col("text_hash").alias("_vintara_hash")
    )
    marked = docs.withColumn("_vintara_hash2", F.xxhash64(text_of(docs, text)))
    same = (F.col("_vintara_hash2") == F.col("_vintara_hash")) & F.col(doc_id).cast("long").eqNullSafe(F.col("_vintara_id"))
    one = Window.partitionBy("_vintara_hash2", doc_id).orderBy(F.lit(1))
    return (
        marked.join(kept, same, "left_semi")
        .withColumn("_vintara_rank", F.row_number().over(one))
        .where("_vintara_rank = 1")
        .select(*docs.columns)
    )


def fingerprint_text(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
