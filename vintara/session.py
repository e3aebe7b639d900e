"""The Spark session this library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str = "local[8]", app: str = "vintara", **conf: str) -> SparkSession:
    """A session in UTC with ANSI mode and adaptive execution.

    ``conf`` keys use ``__`` for dots: ``spark__sql__shuffle__partitions="8"``.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
