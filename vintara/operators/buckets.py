"""Running totals over groups of any size.

A window over one group is one task. Here rows are first dealt into range buckets: each
bucket is folded by itself, the buckets' totals, of which there are few, are run up in
order, and each row adds what stands before its bucket. So a group that holds a third
of all rows takes as many tasks as its share of the buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.storage import saved

#: Rows of a bucket, about.
BUCKET_ROWS = 200_000
#: What totals are made of: each is associative, so totals of buckets make totals of groups.
_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "product": F.product}
_OF_TOTALS = {**_FOLDS, "count": F.sum}


def in_one_bucket(df: DataFrame, rows: int | None = None) -> bool:
    """Whether ``df`` has so few rows that one bucket is enough; reads no more than these."""
    limit = rows or BUCKET_ROWS
    return df.limit(limit).count() < limit


def bucketed(df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int | None = None) -> DataFrame:
    """``df`` with ``_bucket``: buckets of a group follow each other in ``order``.

    Rows that are equal in ``by`` and ``order`` share a bucket. Several buckets are read back
    from storage, so that they stay what they are; where one is enough nothing is written.
    """
    if in_one_bucket(df, rows):
        return df.withColumn("_bucket", F.lit(0))
    kept = saved(df)
    n = 1 + kept.count() // (rows or BUCKET_ROWS)
    return saved(kept.repartitionByRange(n, *by, *order).withColumn("_bucket", F.spark_partition_id()))


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, tuple[str, Column]],
    rows: int | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """``df`` with running totals, this row included, within ``by`` in ``order``.

    ``totals`` maps a new name to ``(fold, column)``, a fold being ``sum``, ``product``, ``max``, ``min`` or
    ``count``. Of rows that tie in ``order`` each has the total after all of them; if not ``inclusive``,
    totals are those before a row, and there must be no ties. Nulls are passed over; all folds but
    ``count`` are null before any value.
    """
    columns = {f"_in_{n}": c for n, (_, c) in totals.items()}
    if inclusive:
        frame = lambda w: w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        frame = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    fold = lambda n, window: _FOLDS[totals[n][0]](f"_in_{n}").over(window)
    if in_one_bucket(df, rows):
        whole = frame(Window.partitionBy(*by).orderBy(*order))
        return df.withColumns(columns).withColumns({n: fold(n, whole) for n in totals}).drop(*columns)
    dealt = bucketed(df.withColumns(columns), by, order, rows)
    inside = frame(Window.partitionBy(*by, "_bucket").orderBy(*order))
    own = {n: fold(n, inside) for n in totals}
    sums = dealt.groupBy(*by, "_bucket").agg(*(_FOLDS[f](f"_in_{n}").alias(f"_all_{n}") for n, (f, _) in totals.items()))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    prefix = sums.select(
        *(F.col(c).alias(f"_by_{c}") for c in by),
        F.col("_bucket").alias("_by_bucket"),
        *(_OF_TOTALS[f](f"_all_{n}").over(before).alias(f"_before_{n}") for n, (f, _) in totals.items()),
    )
    same = F.col("_bucket") == F.col("_by_bucket")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = dealt.withColumns(own).join(prefix, same)
    both = {}
    for n, (f, _) in totals.items():
        here, there = F.col(n), F.col(f"_before_{n}")
        if f in ("max", "min"):
            both[n] = (F.greatest if f == "max" else F.least)(here, there)
        else:
            both[n] = F.coalesce(here * there if f == "product" else here + there, here, there)
    return joined.select(*df.columns, *(c.alias(n) for n, c in both.items()))
