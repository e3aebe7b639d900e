"""Near-duplicates by SimHash deletion variants, verified by the similarity of their shingles.

Texts link if the Jaccard similarity of their sets of five-word shingles is ``SIMILARITY``
(0.8) or more. At that similarity 64-bit fingerprints differ by about ten bits, so they
are cut into sixteen segments, most of which differ by at most one bit. Each
segment is indexed once for each of its bits, with this bit left out, as in
:mod:`vintara.llm.simhash`; but variants of so few bits would gather texts that have nothing
in common, so each segment is joined with three minimum hashes over the shingles, all of which equal
texts share and texts of similarity ``s`` share with probability ``s ** 3``; texts that share a passage, a third of
both, agree in one key of some thousand. An equality join on these keys gives candidates; whatever the number of texts, few are random.

A link is missed only if all sixteen keys fail: at similarity 0.8 with a probability of about
0.02 %, if bits differ as often as they should. All candidates are verified on their shingles
(as 32-bit hashes). In a key of many texts all are first compared with the one that lies between them: at most one candidate
for each key of a text. Texts of keys that this leaves in different components are then compared where their rarest shingles, an exact
filter, share one: not with all others of a key, whose number is the square of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.llm.common import saved, text_of
from vintara.llm.components import connected_components
from vintara.llm.exact import drop_unkept

WORDS = 5
SIMILARITY = 0.8
SEED = 42
SEGMENTS = 16
#: Minimum hashes that go with each segment.
MINS = 3
#: Odd numbers that turn one hash into one for each of them.
_TURNS = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 | 1 for i in range(SEGMENTS * MINS)], np.uint64)


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """The hash of each shingle, repeats included; of a shorter text, that of all its words; of none, nothing."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    digest, n = xxhash.xxh64_digest, max(1, len(found) - words + 1)
    return np.frombuffer(b"".join([digest(b" ".join(found[i : i + words]), SEED) for i in range(n)]), ">u8").astype(np.uint64)


def sketch(hashes: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The fingerprint, a hash of the minimum hashes of each segment, and the set of shingles as 32-bit hashes."""
    if not len(hashes):
        return 0, np.zeros(SEGMENTS, np.int32), np.empty(0, np.int32)
    # Each shingle once, as the similarity counts them.
    hashes = np.unique(hashes)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
    over_half = np.add.reduce(bits, axis=0, dtype=np.int32) * 2 > len(hashes)
    mins = np.array([(hashes * t).min() for t in _TURNS]).reshape(SEGMENTS, MINS)
    together = mins[:, 0]
    for i in range(1, MINS):
        together = (together ^ (together >> np.uint64(31))) * _TURNS[1] + mins[:, i]
    mins = (together * _TURNS[2] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    # Other bits than the fingerprint's upper ones decide nothing here; any 32 will do.
    return int(np.packbits(over_half).view(">i8")[0]), mins, np.unique((hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)).view(np.int32)


def _sketched(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [sketch(shingle_hashes(t.as_py(), words)) for t in batch.column("_text")]
        lists = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), *(pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int64(), lists, lists)))],
            names=["doc_id", "digest", "fp", "mins", "shingles"],
        )


def _keys() -> Column:
    """The keys of a text: each segment without each of its bits, with the segment's minimum hashes."""
    width, found = 64 // SEGMENTS, []
    for s in range(SEGMENTS):
        segment = F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            rest = segment.bitwiseAND(F.lit(~(1 << bit))).bitwiseOR(F.lit((s * width + bit) << width))
            found.append(F.xxhash64(F.col("mins")[s], rest))
    return F.array(*found)


def _verified(pairs: DataFrame, sizes: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` of nodes whose shingles are as similar as asked; texts without words equal each other.

    Sets of too different sizes can't be similar; only the others' shingles are brought together.
    """
    sized = pairs.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(
        sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b"
    )
    near = F.least("na", "nb") >= similarity * F.greatest("na", "nb")
    pairs = saved(sized.where(near).select("a", "b"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # Written, as only joins of what is plainly shuffled are dealt anew where a hub has many pairs.
    held = saved(shingles.join(nodes, "node", "left_semi"))
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(
        held.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b"
    )
    shared = F.size(F.array_intersect("x", "y"))
    every = F.size("x") + F.size("y") - shared
    return both.where((shared >= similarity * every) | (every == 0)).select("a", "b")


def _sharing_rare(nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of different labels that may be as similar as asked; none that is is missed.

    Of two sets so similar, the rarest shingles of each (a fifth and one, at 0.8) share one, in any order that all sets keep. So
    what many texts have in common brings together only those that have little else. The first shared shingle's places and the sizes bound
    how many more can be shared. ``nodes`` has ``node, label, shingles``.
    """
    each = saved(nodes.select("node", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("s")))
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("_often"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("_often", "s"))
    # A little less than the product, which may be rounded up.
    least = F.ceil(F.col("n") * similarity - 1e-6)
    rare = saved(each.join(often, "s").withColumn("i", place).where(F.col("i") <= F.col("n") - least + 1).select("s", "node", "label", "n", "i"))
    x, y = (rare.select("s", *(F.col(c).alias(f"{c}{k}") for c in ("node", "label", "n", "i"))) for k in (1, 2))
    most = 1 + F.least(F.col("n1") - F.col("i1"), F.col("n2") - F.col("i2"))
    enough = most >= (F.col("n1") + F.col("n2")) * (similarity / (1 + similarity)) - 1e-6
    # A shingle of one component only brings nothing together.
    mixed = rare.groupBy("s").agg((F.min("label") != F.max("label")).alias("_mixed")).where("_mixed").select("s")
    pairs = x.join(mixed, "s", "left_semi").join(y, (x["s"] == y["s"]) & (F.col("label1") < F.col("label2")) & enough)
    return pairs.select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct()


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, digest, component_id, kept`` for each row.

    Components are joined by links; ``component_id`` is the smallest id in it (null ids are
    passed over; of only such it is null), and one of its rows is kept: of those with that id
    the one of the smallest digest, or if rows repeat with id and text, one of them. Null texts are empty, and all
    texts without words are similar. Columns besides the two are ignored; an empty table gives no rows.
    """
    whole = text_of(docs, text)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.sha2(whole, 256).alias("digest"), whole.alias("_text"))
    rows = rows.mapInArrow(lambda b: _sketched(words, b), "doc_id long, digest string, fp long, mins array<int>, shingles array<int>")
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()))
    # Equal texts are one node, named by one of their rows.
    names = saved(rows.groupBy("digest").agg(F.min("row").alias("node")))
    nodes = saved(rows.join(names, F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), "fp", "mins", F.size("shingles").alias("n")))
    sizes = nodes.select("node", "n")
    shingles = rows.select(F.col("row").alias("node"), "shingles")

    # Only keys of two texts or more matter from here on.
    whole_key = Window.partitionBy("key")
    shared = saved(nodes.select("node", F.explode(_keys()).alias("key")).withColumn("n", F.count(F.lit(1)).over(whole_key)).where("n > 1"))
    # One member of each key is its hub: the one whose own keys hold the most texts. Of a dense group it lies
    # amid the others and is the same in most keys, so there are few pairs to verify, and few texts are left apart.
    middle = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    order = F.struct((-F.col("weight")).alias("weight"), F.col("node").alias("node"))
    first = (
        shared.join(middle, "node")
        .withColumn("_hub", F.min(order).over(whole_key))
        .select(F.col("node").alias("a"), F.col("_hub.node").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )
    first = saved(first)
    roots = saved(connected_components(_verified(first, sizes, shingles, similarity)))
    labelled = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("label"))
    # What is left: texts of keys of three or more that are still in different components.
    left = saved(
        shared.where("n > 2")
        .join(labelled, "node")
        .withColumn("mixed", F.min("label").over(whole_key) != F.max("label").over(whole_key))
        .where("mixed")
        .select("node", "label")
        .distinct()
    )
    more = _sharing_rare(left.join(shingles, "node"), similarity)
    more = saved(more.join(first, ["a", "b"], "left_anti").join(first.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti"))
    across = _verified(more, sizes, shingles, similarity)
    of = labelled.select("node", "label")
    joined = across.join(of.withColumnsRenamed({"node": "a", "label": "la"}), "a").join(of.withColumnsRenamed({"node": "b", "label": "lb"}), "b")
    tops = saved(connected_components(joined.select("la", "lb").distinct()))
    component = of.join(tops.withColumnsRenamed({"node": "label", "root": "top"}), "label", "left").select(
        "node", F.coalesce("top", "label").alias("component")
    )
    named = saved(rows.select("doc_id", "digest", "row").join(names.join(component, "node").select("digest", "component"), "digest"))
    best = saved(
        named.groupBy("component").agg(
            F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "digest", "row")).alias("_best")
        )
    )
    return named.join(best, "component").select(
        "doc_id", "digest", "component_id", (F.col("row") == F.col("_best.row")).alias("kept")
    )


def drop_similar_documents(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`similar_documents` keeps, with all their columns.

    Same treatment of nulls, ties and repeats; an empty table gives no rows.
    """
    found = similar_documents(docs, similarity, words, doc_id, text).select("doc_id", "digest", "kept")
    return drop_unkept(docs, found, doc_id, text)
