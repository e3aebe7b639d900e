"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.llm.common import saved


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, and but for chance for no others."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.bit_xor(F.xxhash64("u", "v")),
            F.sum(F.shiftright(F.xxhash64("v", "u"), 24)),
        ).first()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (two columns of type long).

    ``root`` is the smallest node of the component. Alternates large and small stars
    until nothing changes (Kiveris et al., 2014); each round is a few joins and
    aggregations of at most as many edges as there were, written to the shared folder.
    Loops and repeated edges are ignored; edges with a null are not edges.
    """
    a, b = edges.columns
    now = saved(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
        .distinct()
    )
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        )
        now = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
