"""Nearest neighbours by inner product over stable projections in kd-trees.

Inner product search becomes Euclidean search when each candidate gets one more
component, ``sqrt(M**2 - |x|**2)`` with ``M`` the largest norm of its cell, and the query
a zero. Gaussian projections to a few dimensions are 2-stable: projected over true
squared distance is chi-square distributed with as many degrees of freedom as there are
projections. A kd-tree over the projected candidates gives them one after another in the
order of their own projected distance; they are verified with their true product until,
at the projected distance reached, a candidate as near as the k-th best so far would have
been seen already with probability ``confidence`` or more by the chi-square distribution.

The projected space is cut into cells by a coarse kd-tree, fitted on a bounded sample
(:data:`SAMPLE_ROWS`); every candidate is dealt to its cell and indexed there once, and
the index is kept in the shared folder. A query first searches the cell that it lies in.
Its k-th best product so far goes with it to the other cells, but only to those whose box
the stopping test does not exclude and whose largest norm can still reach that product.
Cells of too many rows, and queries of a cell, are split by hash into blocks, so no task
holds more than a block of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintara.llm.common import saved

PROJECTIONS = 24
CONFIDENCE = 0.92
LEAF_ROWS = 512
#: Candidates of a block, which have a tree of their own, and queries that meet it in a task.
BLOCK_ROWS = 16_384
QUERY_ROWS = 2_048
#: Cells at most; beyond, cells are split by hash. It bounds the table that queries are routed by.
MAX_CELLS = 4_096
#: Tasks of a search at most; beyond, a task has several meetings one after another.
MAX_TASKS = 20_000
#: Expected rows of the sample that the cells are fitted on.
SAMPLE_ROWS = 20_000
SEED = 7


def chi_square_cdf(x: np.ndarray | float, freedom: int) -> np.ndarray:
    """The chi-square distribution for an even number of degrees of freedom."""
    half = np.asarray(x, float) / 2
    term = total = np.ones_like(half)
    for i in range(1, freedom // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, freedom) < p else (low, middle)
    return high


@lru_cache(maxsize=16)
def axes_of(dim: int, projections: int) -> np.ndarray:
    """The directions for vectors of ``dim`` components and the one added; the same in every task."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim + 1, projections))


def projected(vectors: np.ndarray, top: float, projections: int) -> np.ndarray:
    """Projections of candidates raised to the squared norm ``top``."""
    axes = axes_of(vectors.shape[1], projections)
    rest = np.sqrt(np.maximum(top - np.einsum("ij,ij->i", vectors, vectors), 0))
    return vectors @ axes[:-1] + rest[:, None] * axes[-1]


def box_distances(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances from a point to boxes."""
    away = np.maximum(np.maximum(low - point, point - high), 0)
    return np.einsum("ij,ij->i", away, away)


def kd_order(points: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in the order of a kd-tree's leaves, and where each leaf starts.

    Leaves have at most ``leaf`` points; nodes split at the median of their widest side.
    """
    order, starts, stack = np.arange(len(points)), [], [(0, len(points))]
    while stack:
        a, b = stack.pop()
        if b - a <= leaf:
            starts.append(a)
            continue
        part = points[order[a:b]]
        side = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, side], middle)]
        stack += [(a, a + middle), (a + middle, b)]
    return order, np.array(sorted(starts), np.int64)


@dataclass
class Block:
    """Candidates in the order of a kd-tree over their projections."""

    ids: np.ndarray
    vectors: np.ndarray
    points: np.ndarray
    starts: np.ndarray
    top: float

    @staticmethod
    def build(ids: np.ndarray, vectors: np.ndarray, top: float, projections: int = PROJECTIONS) -> Block:
        points = projected(vectors, top, projections)
        order, starts = kd_order(points)
        return Block(ids[order], vectors[order], points[order], starts, top)

    def __post_init__(self):
        self._ends = np.append(self.starts[1:], len(self.ids))
        self.low = np.minimum.reduceat(self.points, self.starts)
        self.high = np.maximum.reduceat(self.points, self.starts)
        self._squares = np.einsum("ij,ij->i", self.points, self.points)
        self._numbers = np.arange(len(self.ids))
        self._step = max(64, len(self.ids) // 32)

    def nearest(
        self, own: int, query: np.ndarray, k: int, limit: float, floor: float = -np.inf
    ) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and products of the ``k`` best besides the query's own row, and how many were verified.

        ``limit`` is the chi-square quantile at which the search stops; ``floor`` a product
        that ``k`` candidates of other blocks reach.
        """
        base = float(query @ query) + self.top
        point = query @ axes_of(len(query), self.points.shape[1])[:-1]
        shift = float(point @ point)
        boxes = box_distances(self.low, self.high, point)
        leaves = np.argsort(boxes, kind="stable")
        boxes = boxes[leaves]
        same = np.flatnonzero(self.ids == own)
        same = same[(self.vectors[same] == query).all(axis=1)]
        # Rows of opened leaves by their own projected distance, those from ``at`` on not verified yet.
        rows, away, at, opened = np.empty(0, np.int64), np.empty(0), 0, 0
        kth, tops = floor, np.empty(0)
        seen_rows, seen = [], []
        while True:
            reach = limit * max(base - 2 * kth, 0.0)
            frontier = boxes[opened] if opened < len(leaves) else np.inf
            # A row is next only if no leaf that isn't open yet can hold a nearer one.
            ready = int(np.searchsorted(away, min(frontier, reach), "right"))
            if ready - at < self._step and frontier <= reach and opened < len(leaves):
                some = leaves[opened : opened + max(2, 3 * opened)]
                opened += len(some)
                # Leaves are slices, which costs less than picking their rows one by one.
                slices = [slice(self.starts[i], self._ends[i]) for i in some]
                rows = np.concatenate([rows[at:], *(self._numbers[s] for s in slices)])
                away = np.concatenate([away[at:], *(self._squares[s] + shift - 2 * (self.points[s] @ point) for s in slices)])
                order = np.argsort(away)
                rows, away, at = rows[order], away[order], 0
                continue
            if ready <= at:
                break
            now = rows[at : min(ready, at + self._step)]
            at += len(now)
            products = self.vectors[now] @ query
            for row in same:
                products[now == row] = -np.inf
            seen_rows.append(now)
            seen.append(products)
            tops = np.concatenate([tops, products[products > kth]])
            if len(tops) >= k:
                tops = np.partition(tops, len(tops) - k)[len(tops) - k :]
                kth = max(floor, float(tops.min()))
        verified = sum(map(len, seen))
        if not verified:
            return np.empty(0, np.int64), np.empty(0), 0
        rows, products = np.concatenate(seen_rows), np.concatenate(seen)
        rows = rows[(products > -np.inf) & (products >= kth - 1e-9 * max(1.0, abs(kth)))]
        # Once more in one fixed order of summation, so that equal vectors tie.
        exact = (self.vectors[rows] * query).sum(axis=1)
        first = np.lexsort((self.ids[rows], -exact))[:k]
        return self.ids[rows][first], exact[first], verified


class Cells:
    """A coarse kd-tree whose leaves, the cells, are numbered from 0."""

    def __init__(self, points: np.ndarray, n_cells: int):
        self.nodes: list[tuple[int, float, int, int]] = []
        self.n = 0
        self._grow(points, n_cells)

    def _grow(self, points: np.ndarray, n_cells: int) -> int:
        """The number of a new node, or ``-1 - cell``."""
        values = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(1)
        side = int(np.argmax(values))
        if n_cells > 1 and values[side] > 0:
            value = float(np.median(points[:, side]))
            left = points[:, side] < value
            if left.any():
                number = len(self.nodes)
                self.nodes.append((side, value, 0, 0))
                below = self._grow(points[left], n_cells // 2)
                above = self._grow(points[~left], n_cells - n_cells // 2)
                self.nodes[number] = (side, value, below, above)
                return number
        self.n += 1
        return -self.n

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        at = np.full(len(points), 0 if self.nodes else -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            side, value, below, above = (np.array(c) for c in zip(*(self.nodes[i] for i in at[inner])))
            at[inner] = np.where(points[inner, side] < value, below, above)
        return -1 - at


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``dim, row numbers, vectors`` of the rows of each number of components."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        yield dim, rows, _matrix(batch.column("vector").take(pa.array(rows)))


def valid_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, vector`` of rows that can be searched, repeats once.

    Left out: null ids; vectors null, empty, zero, or with null or non-finite components.
    """
    v = F.col(vector).cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(vec_id).isNotNull() & F.coalesce(usable, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector")
    )


def fit_cells(rows: DataFrame, tops: dict[int, float], n_rows: int, projections: int, block_rows: int) -> dict[int, Cells]:
    """Cells for the vectors of each number of components, from a sample of ``rows``.

    The sample is drawn by a hash and has :data:`SAMPLE_ROWS` rows on average, or all if
    there are fewer; only projections of it reach the driver.
    """
    bits = 1 << 24
    keep = F.pmod(F.xxhash64("vector", "vec_id"), F.lit(bits)) < int(min(1.0, SAMPLE_ROWS / max(1, n_rows)) * bits)

    def project(batches):
        for batch in batches:
            for dim, _, vectors in _by_dim(batch):
                points = projected(vectors, tops[dim], projections)
                flat = pa.ListArray.from_arrays(np.arange(0, points.size + 1, projections), pa.array(points.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(points), dim)), flat], names=["dim", "point"])

    sample = rows.where(keep).mapInArrow(project, "dim long, point array<double>").toArrow()
    found = {}
    for dim in tops:
        part = sample.filter(pa.array(sample["dim"].to_numpy() == dim, pa.bool_()))
        points = np.concatenate([_matrix(c) for c in part["point"].chunks if len(c)] or [np.zeros((0, projections))])
        points = points[np.lexsort(points.T)]
        cells = 1 + n_rows * len(points) // max(1, len(sample)) // block_rows
        found[dim] = Cells(points, min(MAX_CELLS, cells, 1 + len(points) // 8))
    return found


def _dealt(rows: DataFrame, cells: dict[int, Cells], tops: dict[int, float], projections: int) -> DataFrame:
    """``rows`` with the ``cell`` of each as a candidate and the cell that it lies in as a query, ``home``."""

    def deal(batches):
        for batch in batches:
            cell, home = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for dim, at, vectors in _by_dim(batch):
                cell[at] = cells[dim].of(projected(vectors, tops[dim], projections))
                home[at] = cells[dim].of(vectors @ axes_of(dim, projections)[:-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(home)], names=[*batch.schema.names, "cell", "home"]
            )

    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(deal, f"{kinds}, cell long, home long")


_INDEX = "dim long, cell long, block long, top double, ids binary, vectors binary, points binary, starts binary, low array<double>, high array<double>"


def _index(candidates: DataFrame, sizes: DataFrame, projections: int, block_rows: int) -> DataFrame:
    """The index: one row for each block of each cell."""

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block = Block.build(table["vec_id"].to_numpy(), _matrix(table["vector"].combine_chunks()), table["top"][0].as_py(), projections)
        return pa.table(
            {
                "dim": table["dim"][:1],
                "cell": table["cell"][:1],
                "block": table["block"][:1],
                "top": [block.top],
                "ids": [block.ids.tobytes()],
                "vectors": [block.vectors.tobytes()],
                "points": [block.points.tobytes()],
                "starts": [block.starts.tobytes()],
                "low": [block.low.min(axis=0).tolist()],
                "high": [block.high.max(axis=0).tolist()],
            },
            schema=pa.schema(
                [(n, pa.int64()) for n in ("dim", "cell", "block")]
                + [("top", pa.float64())]
                + [(n, pa.binary()) for n in ("ids", "vectors", "points", "starts")]
                + [(n, pa.list_(pa.float64())) for n in ("low", "high")]
            ),
        )

    blocks = F.ceil(F.col("n") / block_rows)
    dealt = candidates.join(F.broadcast(sizes), ["dim", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("vector", "vec_id"), blocks).cast("long")
    )
    some = dealt.select("dim", "cell", "block", "top", "vec_id", "vector")
    return some.groupBy("dim", "cell", "block").applyInArrow(build, _INDEX)


_FOUND = "query long, query_id long, ids array<long>, scores array<double>, verified long"


def _search(index: DataFrame, routed: DataFrame, k: int, limit: float, projections: int) -> DataFrame:
    """What each query finds in the blocks of the cells it is routed to, a row for each block.

    ``routed`` has ``query, vec_id, vector, dim, floor, cells``.
    """

    def search(key: tuple, queries: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if len(queries) and len(blocks):
            dim = key[0].as_py()
            # Copies are aligned, which buffers within a batch need not be.
            read = lambda name, kind: np.frombuffer(blocks[name][0].as_buffer(), kind).copy()
            block = Block(
                read("ids", np.int64), read("vectors", np.float64).reshape(-1, dim),
                read("points", np.float64).reshape(-1, projections), read("starts", np.int64), blocks["top"][0].as_py(),
            )
            rows = zip(queries["query"].to_pylist(), queries["vec_id"].to_pylist(), queries["floor"].to_pylist())
            for (query, own, floor), vector in zip(rows, _matrix(queries["vector"].combine_chunks()), strict=True):
                ids, scores, verified = block.nearest(own, vector, k, limit, -np.inf if floor is None else floor)
                for column, value in zip(out, (query, own, ids.tolist(), scores.tolist(), verified), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["query", "query_id", "ids", "scores", "verified"])

    visits = routed.withColumn("cell", F.explode("cells")).drop("cells")
    parts = visits.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("long").alias("parts"))
    blocks = index.groupBy("dim", "cell").agg((F.max("block") + 1).alias("blocks"))
    shape = saved(parts.join(blocks, ["dim", "cell"]))
    # A meeting is seconds of work on few bytes, so each has a task to itself.
    n_tasks = min(MAX_TASKS, shape.agg(F.coalesce(F.sum(F.col("parts") * F.col("blocks")), F.lit(0)).alias("n")).first()["n"] + 1)
    shape = F.broadcast(shape)
    keys = ["dim", "cell", "block", "part"]
    left = (
        visits.join(shape, ["dim", "cell"])
        .withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(*keys, "query", "vec_id", "vector", "floor")
    )
    right = index.join(shape, ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    right = right.select(*keys, "top", "ids", "vectors", "points", "starts")
    left, right = left.repartition(n_tasks, *keys), right.repartition(n_tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, _FOUND)


def _route(queries: DataFrame, found: DataFrame, index: DataFrame, k: int, limit: float, projections: int) -> DataFrame:
    """The queries with the ``floor`` that their first cell set and the other ``cells`` that may improve it."""
    boxes = index.groupBy("dim", "cell").agg(
        F.max("top").alias("top"),
        F.array(*(F.min(F.col("low")[i]) for i in range(projections))).alias("low"),
        F.array(*(F.max(F.col("high")[i]) for i in range(projections))).alias("high"),
    )
    table: dict[int, list[tuple]] = {}
    for r in boxes.collect():  # at most MAX_CELLS rows for each number of components
        table.setdefault(r["dim"], []).append((r["cell"], r["top"], r["low"], r["high"]))
    packed = {dim: tuple(map(np.array, zip(*rows, strict=True))) for dim, rows in table.items()}

    def route(batches):
        for batch in batches:
            cells: list[list[int]] = [[]] * len(batch)
            floors, homes = batch.column("floor").to_pylist(), batch.column("home").to_pylist()
            for dim, at, vectors in _by_dim(batch):
                names, top, low, high = packed[dim]
                for row, query, point in zip(at.tolist(), vectors, vectors @ axes_of(dim, projections)[:-1], strict=True):
                    floor = -np.inf if floors[row] is None else floors[row]
                    norm = float(query @ query)
                    left = names != homes[row]
                    left &= np.sqrt(norm * top) * (1 + 1e-9) >= floor
                    if floor > -np.inf:
                        left &= box_distances(low, high, point) <= limit * np.maximum(norm + top - 2 * floor, 0)
                    cells[row] = names[left].tolist()
            names = [n for n in batch.schema.names if n != "home"]
            columns = [batch.column(n) for n in names] + [pa.array(cells, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "cells"])

    # A first cell of several blocks gave k for each of them; the k-th best of all is the floor.
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc()))
    kth = (
        found.select("query", F.explode("scores").alias("score"))
        .withColumn("place", place)
        .where(F.col("place") == k)
        .select("query", F.col("score").alias("floor"))
    )
    known = queries.join(kth, "query", "left").select("query", "vec_id", "vector", "dim", "floor", "home")
    return known.mapInArrow(route, "query long, vec_id long, vector array<double>, dim long, floor double, cells array<long>")


def nearest_neighbours(
    df: DataFrame,
    is_query,
    k: int = 20,
    projections: int = PROJECTIONS,
    confidence: float = CONFIDENCE,
    block_rows: int = BLOCK_ROWS,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score, verified``: the ``k`` nearest of each query, nearest first.

    Queries are the rows for which the column ``is_query`` (over ``vec_id``) holds; each
    is searched among all other rows of as many components. Rows left out are those of
    :func:`valid_vectors`; rows that repeat id and vector count once. Rows that share an
    id but not the vector are different rows: as queries they have ranks of their own, as
    candidates a place each. Ties go to the smaller id. With fewer than ``k`` candidates
    all are returned, and none for a query alone. An empty table gives no rows; other
    columns are ignored. ``verified`` is the number of candidates whose true product was
    computed for the query. ``projections`` is even.
    """
    rows = saved(
        valid_vectors(df, vec_id, vector)
        .groupBy("vec_id", "vector")
        .agg(F.size("vector").cast("long").alias("dim"))
        .withColumn("norm", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    )
    stats = rows.groupBy("dim").agg(F.max("norm").alias("top"), F.count(F.lit(1)).alias("n")).collect()
    tops, n_rows = {r["dim"]: r["top"] for r in stats}, sum(r["n"] for r in stats)
    cells = fit_cells(rows, tops, n_rows, projections, block_rows)
    dealt = saved(_dealt(rows, cells, tops, projections))
    # Of equal vectors no more than the k + 1 smallest ids can be in any result.
    order = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    candidates = saved(dealt.withColumn("_rank", order).where(F.col("_rank") <= k + 1).drop("_rank", "home"))
    sizes = saved(candidates.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")))
    index = saved(_index(candidates, sizes, projections, block_rows))
    queries = dealt.where(is_query).withColumn("query", F.xxhash64("vec_id", "vector"))

    limit = chi_square_quantile(confidence, projections)
    first = queries.select("query", "vec_id", "vector", "dim", F.lit(None).cast("double").alias("floor"), F.array("home").alias("cells"))
    found = saved(_search(index, first, k, limit, projections))
    if any(c.n > 1 for c in cells.values()):
        routed = saved(_route(queries, found, index, k, limit, projections))
        found = found.unionByName(_search(index, routed, k, limit, projections))
        found = saved(found)
    work = found.groupBy("query").agg(F.sum("verified").alias("verified"))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.select("query", "query_id", F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .join(work, "query")
        .select("query_id", "rank", "vec_id", "score", "verified")
    )
