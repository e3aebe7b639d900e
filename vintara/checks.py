"""Violation queries: a stage is lawful if a query finds no row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_none(violations: DataFrame, error: type[Exception], message: str) -> None:
    """Raise ``error`` with a sample row if the query returns any."""
    found = violations.limit(1).collect()
    if found:
        raise error(f"{message}: {found[0].asDict()}")


def require(df: DataFrame, condition: Column, error: type[Exception], message: str) -> DataFrame:
    """``df``, if ``condition`` holds in every row; null counts as not holding."""
    require_none(df.where(~F.coalesce(condition, F.lit(False))), error, message)
    return df


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that more than one row has."""
    return df.groupBy(*keys).count().where("count > 1")


def require_unique(df: DataFrame, keys: Sequence[str], error: type[Exception], message: str) -> DataFrame:
    require_none(repeated(df, keys), error, message)
    return df


def require_same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], error: type[Exception], message: str) -> None:
    """Raise unless both frames have the same distinct keys."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    require_none(a.join(b, list(keys), "left_anti").unionByName(b.join(a, list(keys), "left_anti")), error, message)


def require_columns(df: DataFrame, names: Sequence[str], error: type[Exception]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise error(f"columns not there: {missing}; got {df.columns}")
