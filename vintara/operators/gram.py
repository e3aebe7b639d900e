"""Covariances of wide universes by blocks of assets.

A join of returns with themselves has a row for each instant and pair of assets. Here each
decision's assets are cut into blocks of ``BLOCK``, each kept as one dense matrix of instants by assets, and
pairs of blocks are multiplied: a task holds two matrices, whatever the universe, and what is shuffled
is each block once for each other block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintara.storage import saved

#: Assets of a block. A block of 500 instants has about a megabyte.
BLOCK = 256

_BLOCKS = "decision_time timestamp, block int, n_instants int, assets array<string>, returns binary"
_PAIRS = "decision_time timestamp, a string, b string, n long, covariance double"


def _numbered(windows: DataFrame, column: str, name: str) -> DataFrame:
    """Each value of ``column`` with its place in its decision, from 0."""
    order = Window.partitionBy("decision_time").orderBy(column)
    return windows.select("decision_time", column).distinct().withColumn(name, F.row_number().over(order) - 1)


def _matrix(key: tuple, table: pa.Table) -> pa.Table:
    """One block as a matrix; a return that isn't there is no number."""
    places = table["_place"].to_numpy()
    n_instants = table["_instants"][0].as_py()
    matrix = np.full((n_instants, int(places.max()) + 1), np.nan)
    matrix[table["_t"].to_numpy(), places] = table["r"].to_numpy(zero_copy_only=False)
    names = [""] * matrix.shape[1]
    for place, asset in zip(places.tolist(), table["asset"].to_pylist()):
        names[place] = asset
    columns = [
        table["decision_time"].combine_chunks()[:1],
        pa.array([key[1].as_py()], pa.int32()),
        pa.array([n_instants], pa.int32()),
        pa.array([names], pa.list_(pa.string())),
        pa.array([matrix.tobytes()], pa.binary()),
    ]
    return pa.table(columns, names=["decision_time", "block", "n_instants", "assets", "returns"])


def blocks_of(windows: DataFrame) -> DataFrame:
    """``decision_time, block, n_instants, assets, returns`` of ``windows`` (``decision_time, asset, t, r``, each asset and instant once)."""
    instants = _numbered(windows, "t", "_t")
    counts = instants.groupBy("decision_time").agg(F.count(F.lit(1)).cast("int").alias("_instants"))
    rows = (
        windows.select("decision_time", "asset", "t", F.col("r").cast("double").alias("r"))
        .join(_numbered(windows, "asset", "_place"), ["decision_time", "asset"])
        .join(instants, ["decision_time", "t"])
        .join(counts, "decision_time")
        .withColumn("block", F.floor(F.col("_place") / BLOCK).cast("int"))
        .withColumn("_place", F.col("_place") % BLOCK)
        .drop("t")
    )
    return rows.groupBy("decision_time", "block").applyInArrow(_matrix, _BLOCKS)


def _products(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many instants each pair has in common, and its covariance (ddof 1) over these; no number if fewer than two."""
    there, other = np.isfinite(x), np.isfinite(y)
    # Centred by what each column has, so that sums stay small; a pair's own means are taken off below.
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.where(there, x - np.where(there, x, 0).sum(0) / there.sum(0), 0)
        y = np.where(other, y - np.where(other, y, 0).sum(0) / other.sum(0), 0)
        a, b = there.astype(float), other.astype(float)
        n = a.T @ b
        return n, np.where(n > 1, (x.T @ y - (x.T @ b) * (a.T @ y) / n) / (n - 1), np.nan)


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in ("n_instants", "block", "assets", "returns", "block2", "assets2", "returns2")}
            x, y = (np.frombuffer(row[c]).reshape(row["n_instants"], -1) for c in ("returns", "returns2"))
            n, found = _products(x, y)
            keep = np.triu(np.ones_like(n, bool)) if row["block"] == row["block2"] else np.ones_like(n, bool)
            keep &= n > 0
            first, second = np.nonzero(keep)
            names, others = np.array(row["assets"], object), np.array(row["assets2"], object)
            at = batch.column("decision_time")[i : i + 1].take(pa.array(np.zeros(len(first), np.int64)))
            yield pa.RecordBatch.from_arrays(
                [at, pa.array(names[first], pa.string()), pa.array(others[second], pa.string()), pa.array(n[keep].astype(np.int64)), pa.array(found[keep], from_pandas=True)],
                names=["decision_time", "a", "b", "n", "covariance"],
            )


def block_covariance(windows: DataFrame) -> DataFrame:
    """``decision_time, a, b, n, covariance`` of each pair, ``a`` not after ``b``, over the ``n`` instants that both have.

    Null returns are absent. A pair with one instant has no covariance, one with none no row.
    """
    known = windows.where("r IS NOT NULL AND NOT isnan(r)")
    blocks = saved(blocks_of(known))
    second = blocks.select("decision_time", *(F.col(c).alias(f"{c}2") for c in ("block", "assets", "returns")))
    pairs = blocks.join(second, "decision_time").where("block <= block2")
    return pairs.repartition("decision_time", "block", "block2").mapInArrow(_multiply, _PAIRS)
