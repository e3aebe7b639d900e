"""Named queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from vintara.plans.views import plain_times

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "exp_backtest_inverse_vol"


def query(sql: str | None = None):
    """Register a function under its name, with SQL that gives the same rows."""

    def register(make: Callable[[SparkSession, str], DataFrame]):
        @wraps(make)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain_times(make(spark, sf_dir))

        QUERIES[make.__name__] = run
        if sql:
            ORACLES[make.__name__] = sql
        return run

    return register


def load() -> None:
    """Import the modules that register queries."""
    from vintara.plans import backtest_queries, observation_queries, path_queries  # noqa: F401


