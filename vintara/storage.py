"""Reliable storage for what a plan reads more than once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintara.errors import StorageError


def runs_in_one_process(master: str) -> bool:
    """Whether executors are threads of the driver: ``local`` and ``local[...]``."""
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and all runs
    in one process, as in local tests, a temporary folder is made and used; on a cluster
    an unset folder is a :class:`StorageError`, as executors couldn't read it.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.getCheckpointDir() is None and not runs_in_one_process(sc.master):
        raise StorageError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="vintara-"))
    return named or sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` as read back from reliable storage: later steps don't compute it again.

    It also cuts the plan, which would otherwise repeat what it is made of wherever it is used.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 20_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; else as it is.

    The check reads no more than ``rows + 1`` rows; beyond it Spark chooses the join.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
