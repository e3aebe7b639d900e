"""A Merkle manifest of a dataset: one digest that vouches for every row, with proofs.

Each row is a leaf. In each group (a language) the leaves are in the order of their id, and
every ``FANOUT`` consecutive nodes, or at the end fewer, make the node above; no padding is
added. The groups' roots, in order, are the leaves of the tree over all.

Leaves are dealt by ranges of group and id, and get their position in the group from the
numbers of rows of the partitions before. Each partition then builds all that it can alone,
as a mountain range: a stack with one open run a level, in which a full run is hashed and
carried to the level above as in counting to base ``FANOUT``. Completed nodes are
emitted; what is left in the stack at an edge of the partition, or where a run began before it,
are its peaks. They are brought together level by level, keyed by the run they belong to; there
are some dozens a partition, whatever its rows, and none of them passes the driver.

Proofs are followed from the root down, ``STEP`` levels at a time, in blocks of
``FANOUT ** STEP`` nodes: a task sees a block's nodes and the siblings above it. No key has more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintara.llm.common import saved
from vintara.storage import small

FANOUT = 8
#: Levels that one task follows down.
STEP = 4
#: What a leaf of ``documents`` holds.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_NODE = "grp string, size long, level int, place long, digest string"
_RECORD = f"{_NODE}, peak boolean"


def digest_of(*parts: str) -> str:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def nodes_at(size: int, level: int) -> int:
    """How many nodes a tree over ``size`` leaves has at a level."""
    return -(-size // FANOUT**level)


def field(column: Column) -> Column:
    """What a leaf holds of a value: its length in bytes and the value, or ``-`` if null."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(*columns: str) -> Column:
    """The digest of a row's values in some columns."""
    return F.sha2(F.concat(*(field(F.col(c)) for c in columns)), 256)


def leaves(docs: DataFrame, columns: tuple = COLUMNS, group: str = "lang", doc_id: str = "doc_id", **more: Column) -> DataFrame:
    """``grp, id, leaf`` and what ``more`` names: each row's leaf over ``columns``; a null group comes before all others."""
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"),
        F.col(doc_id).alias("id"),
        leaf_of(*columns).alias("leaf"),
        *(c.alias(name) for name, c in more.items()),
    )


@dataclass(frozen=True)
class Tree:
    """Trees over the leaves of each group.

    ``leaves``: the columns given, with ``place`` (from 0) and ``size`` (of the group).
    ``nodes``: ``grp, size, level, place, digest`` of all nodes above the leaves.
    ``roots``: ``grp, size, digest`` of each group. ``depth``: levels of the tallest tree.
    """

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    depth: int


def in_place(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` (``grp, id, leaf, turn, ...``) with their ``place`` in the group and its ``size``; and the largest size.

    Rows are ordered by id, null first, then by leaf. Rows in which these repeat are interchangeable;
    ``turn``, a number with no meaning, deals them to several partitions if they are many.
    """
    keys = ["grp", "id", "leaf", "turn"]
    # The number counts the rows of a partition from 0, below 33 bits of its own.
    dealt = saved(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("number", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("part", F.shiftright("number", 33)).drop("turn")
    spans = dealt.groupBy("grp", "part").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"))
    # One row for each partition that has rows of the group.
    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = saved(
        spans.select(
            "grp",
            "part",
            (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("n").over(Window.partitionBy("grp")).alias("size"),
        )
    )
    placed = dealt.join(small(spans), ["grp", "part"])
    largest = spans.agg(F.max("size")).first()[0] or 0
    return placed.withColumn("place", F.col("number") + F.col("shift")).drop("number", "part", "shift"), largest


def _mountains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that a partition's leaves complete, and its peaks."""
    found: list[tuple] = []
    open_runs: list[list] = []  # one a level: [the place after the last node, the digests of its run]

    def leave() -> None:
        for level, (after, digests) in enumerate(open_runs):
            first = after - len(digests)
            found.extend((grp, size, level, first + i, d, True) for i, d in enumerate(digests))
        open_runs.clear()

    def carry(place: int, digest: str) -> None:
        level, count = 0, size
        while count > 1:
            if level == len(open_runs):
                open_runs.append([place, []])
            run = open_runs[level]
            run[0] = place + 1
            run[1].append(digest)
            if (place + 1) % FANOUT and place + 1 < count:
                return
            whole = len(run[1]) == place % FANOUT + 1
            if not whole:  # its first nodes are in partitions before
                first = place + 1 - len(run[1])
                found.extend((grp, size, level, first + i, d, True) for i, d in enumerate(run[1]))
                run[1] = []
                return
            digest = digest_of(*run[1])
            run[1] = []
            level, place, count = level + 1, place // FANOUT, nodes_at(count, 1)
            found.append((grp, size, level, place, digest, False))

    def block() -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [[] for _ in _TYPES]
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES.values())], names=list(_TYPES))

    grp, size, after = None, 0, -1
    for batch in batches:
        for g, n, place, leaf in zip(*(batch.column(c).to_pylist() for c in ("grp", "size", "place", "leaf"))):
            if g != grp or place != after:
                leave()
                grp, size = g, n
            after = place + 1
            carry(place, leaf)
        yield block()
    leave()
    yield block()


_TYPES = {"grp": pa.string(), "size": pa.int64(), "level": pa.int32(), "place": pa.int64(), "digest": pa.string(), "peak": pa.bool_()}


def block_number(low: int) -> Column:
    """Which block of ``STEP`` levels from ``low`` on a node of one of these levels is in."""
    return F.expr(f"place div cast(pow({FANOUT}, {low + STEP} - level) AS long)")


def _climb(low: int):
    """What merges the peaks of a block of ``STEP`` levels."""

    def climb(block: pa.Table) -> pa.Table:
        grp, size = block.column("grp")[0].as_py(), block.column("size")[0].as_py()
        levels: dict[int, dict[int, str]] = {}
        for level, place, digest in zip(*(block.column(c).to_pylist() for c in ("level", "place", "digest"))):
            levels.setdefault(level, {})[place] = digest
        out = []
        for level in range(low, low + STEP):
            here = levels.get(level, {})
            for run in sorted({place // FANOUT for place in here}) if nodes_at(size, level) > 1 else ():
                digest = digest_of(*(here[p] for p in range(run * FANOUT, min(nodes_at(size, level), (run + 1) * FANOUT))))
                levels.setdefault(level + 1, {})[run] = digest
                out.append((grp, size, level + 1, run, digest))
        columns = list(zip(*out)) if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, list(_TYPES.values())[:5])], names=list(_TYPES)[:5])

    return climb


def _merged(peaks: DataFrame, depth: int) -> list[DataFrame]:
    """The nodes over peaks of different partitions, ``STEP`` levels at a time."""
    found: list[DataFrame] = []
    carried = peaks
    for low in range(0, depth, STEP):
        here = peaks.where(F.col("level").between(low, low + STEP - 1)).drop("peak")
        if low:
            here = here.unionByName(carried.where(F.col("level") == low))
        made = here.withColumn("block", block_number(low)).groupBy("grp", "block").applyInArrow(_climb(low), _NODE)
        carried = saved(made)
        found.append(carried)
    return found


def tree(rows: DataFrame) -> Tree:
    """The trees over ``rows`` (``grp, id, leaf, turn, ...``); without rows there are none."""
    placed, largest = in_place(rows)
    depth = 0
    while nodes_at(largest, depth) > 1:
        depth += 1
    records = saved(placed.select("grp", "size", "place", "leaf").sortWithinPartitions("grp", "place").mapInArrow(_mountains, _RECORD))
    nodes = records.where("NOT peak").drop("peak")
    for more in _merged(records.where("peak"), depth):
        nodes = nodes.unionByName(more)
    alone = placed.where("size = 1").select("grp", "size", F.col("leaf").alias("digest"))
    tops = nodes.where("place = 0").groupBy("grp", "size").agg(F.max_by("digest", "level").alias("digest"))
    return Tree(placed, nodes, saved(tops.unionByName(alone)), depth)


def _follow(block: pa.Table, low: int):
    """Row numbers of a block's nodes at level ``low``, each with the digests left and right of it a level, upwards.

    The block has nodes of up to ``STEP`` levels and one row with the siblings above it, whose level is null.
    """
    level, place, digest = (block.column(c).to_pylist() for c in ("level", "place", "digest"))
    top = level.index(None)
    size = block.column("size")[top].as_py()
    above = (block.column("left")[top].as_py(), block.column("right")[top].as_py())
    rows: dict[int, list[int]] = {}
    for i, at in enumerate(level):
        if at is not None:
            rows.setdefault(at, []).append(i)
    paths: dict[int, tuple[list, list]] = {}
    for at in range(low + STEP - 1, low - 1, -1):
        alone = nodes_at(size, at) == 1
        runs: dict[int, list[int]] = {}
        for i in sorted(rows.get(at, ()), key=place.__getitem__):
            runs.setdefault(place[i] // FANOUT, []).append(i)
        here = {}
        for run, members in runs.items():
            left, right = paths.get(run, above)
            digests = [digest[i] for i in members]
            for k, i in enumerate(members):
                if alone:
                    here[place[i]] = (left, right)
                else:
                    here[place[i]] = (["".join(digests[:k]), *left], ["".join(digests[k + 1 :]), *right])
        paths = here
    for i in rows.get(low, ()):
        yield i, *paths[place[i]]


def proofs(built: Tree, above: DataFrame, finish, schema: T.StructType | str) -> DataFrame:
    """What ``finish`` makes of each leaf and the siblings on its way to the root.

    ``above`` has for each group ``grp, left, right``, the siblings of its root in a tree over it,
    and columns that are handed on. ``finish(block, found)`` takes a table of rows and, for each
    leaf, its row number there and the digests left and right of it, level by level; the
    row without a level has the columns handed on.
    """
    handed = [c for c in above.columns if c not in ("grp", "left", "right")]
    sizes = built.roots.select("grp", "size")
    steps = max(1, -(-built.depth // STEP))
    above = above.join(sizes, "grp").withColumn("place", F.lit(0).cast("long"))
    waiting, found = above, None
    for step in range(steps - 1, -1, -1):
        low = step * STEP
        # A group starts at the step in which its root is: the lowest that spans it.
        starts = F.col("size") <= FANOUT ** (low + STEP)
        if step:
            starts = starts & (F.col("size") > FANOUT**low)
        tops = waiting.where(starts)
        tops = tops if found is None else tops.unionByName(found)
        nodes = built.nodes.where(F.col("level").between(low, low + STEP - 1) & (F.col("size") > (FANOUT**low if step else 0)))
        nodes = nodes.withColumn("block", block_number(low))
        parts = [tops.withColumnRenamed("place", "block"), nodes]
        if not step:
            leaf_rows = built.leaves.withColumnRenamed("leaf", "digest").withColumn("level", F.lit(0)).withColumn("block", block_number(0))
            parts.append(leaf_rows)
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more, allowMissingColumns=True)
        grouped = rows.groupBy("grp", "block")
        if not step:
            break
        types = {f.name: f.dataType for f in tops.schema.fields}
        names = ["grp", "place", "left", "right", "size", *handed]
        out = T.StructType([T.StructField(c, types[c]) for c in names])
        found = saved(grouped.applyInArrow(_descend(low, names), out)).select(*tops.columns)
    return grouped.applyInArrow(lambda block: finish(block, _follow(block, 0)), schema)


def _descend(low: int, names: list[str]):
    def paths(block: pa.Table) -> pa.Table:
        top = block.column("level").to_pylist().index(None)
        one = block.select([c for c in names if c not in ("place", "left", "right")]).slice(top, 1).to_pylist()[0]
        place = block.column("place").to_pylist()
        found = [one | {"place": place[i], "left": left, "right": right} for i, left, right in _follow(block, low)]
        return pa.Table.from_pylist(found, schema=pa.schema([block.schema.field(c) for c in names]))

    return paths


@dataclass(frozen=True)
class Manifest:
    """The trees of the groups, and the tree over their roots."""

    groups: Tree
    over: Tree

    def root(self) -> str | None:
        """The digest of the whole dataset; none if it is empty."""
        found = self.over.roots.first()
        return found and found["digest"]


def manifest(rows: DataFrame) -> Manifest:
    """The manifest of leaves (:func:`leaves`; further columns stay with them)."""
    # Leaves are saved before they are dealt, which reads them twice; texts are read once.
    groups = tree(saved(rows.withColumn("turn", F.xxhash64(F.monotonically_increasing_id()))))
    roots = groups.roots.select(F.lit("").alias("grp"), F.col("grp").alias("id"), F.col("digest").alias("leaf"), F.lit(0).alias("turn"))
    return Manifest(groups, tree(roots))


def _above(made: Manifest) -> DataFrame:
    """For each group the siblings of its root, the root and the root of all."""
    empty = F.array().cast("array<string>")
    whole = made.over.roots.select("grp", empty.alias("left"), empty.alias("right"), F.col("digest").alias("root"))

    def finish(block: pa.Table, found) -> pa.Table:
        name, subroot = block.column("id").to_pylist(), block.column("digest").to_pylist()
        root = next(filter(None, block.column("root").to_pylist()))
        rows = [{"grp": name[i], "left": left, "right": right, "subroot": subroot[i], "root": root} for i, left, right in found]
        return pa.Table.from_pylist(rows, schema=_ABOVE)

    return proofs(made.over, whole, finish, "grp string, left array<string>, right array<string>, subroot string, root string")


_ABOVE = pa.schema([("grp", pa.string()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])


def fold(leaf: str, left: list[str], right: list[str]) -> str:
    """The root that a leaf leads to with the siblings of a proof."""
    for before, after in zip(left, right):
        leaf = digest_of(before, leaf, after)
    return leaf


def verify_copies(docs: DataFrame, copies: Column, columns: tuple = COLUMNS, text: str = "text", group: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Checks a copy of each row's text against the manifest of ``docs``: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``copies`` is the text as a copy has it. A null value of any column is a leaf's ``-`` and differs from an empty one; a
    null group comes first, a null id before others in its group. Ids may repeat: such rows are ordered by
    their leaves, and rows that repeat whole have proofs of their own. Other columns play no part
    whatever their names; an empty table gives no rows.
    """
    kept = docs.select(*dict.fromkeys([*columns, text, group, doc_id]))
    other = kept.withColumn("_vintara_copy", copies)
    of_copy = leaf_of(*("_vintara_copy" if c == text else c for c in columns))
    changed = ~F.col("_vintara_copy").eqNullSafe(F.col(text))
    made = manifest(leaves(other, columns, group, doc_id, copy=F.when(changed, of_copy)))
    id_type = kept.schema[doc_id].dataType

    def finish(block: pa.Table, found) -> pa.Table:
        ids, leaf, copy = (block.column(c).to_pylist() for c in ("id", "digest", "copy"))
        top = block.column("level").to_pylist().index(None)
        subroot, root = block.column("subroot")[top].as_py(), block.column("root")[top].as_py()
        out = []
        for i, left, right in found:
            folded = fold(copy[i] or leaf[i], left, right)
            proof = digest_of(*(d for pair in zip(left, right) for d in pair))
            out.append((ids[i], leaf[i], subroot, root, proof, folded, folded == root))
        types = [block.schema.field("id").type, *[pa.string()] * 5, pa.bool_()]
        columns = list(zip(*out)) if out else [[] for _ in types]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=_RESULT)

    fields = [T.StructField("doc_id", id_type), *(T.StructField(c, T.StringType()) for c in _RESULT[1:6]), T.StructField("verified", T.BooleanType())]
    return proofs(made.groups, _above(made), finish, T.StructType(fields))


_RESULT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def lowered(text: str = "text") -> Column:
    """A text with A-Z in lower case."""
    return F.translate(F.col(text), UPPER, LOWER)
