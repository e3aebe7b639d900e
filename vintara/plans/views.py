"""Views that the named queries share, as DataFrames and as SQL for the reference engine.

* ``obs``: events as bitemporal observations, published up to 71 hours late; every tenth
  is revised five days after its publication.
* ``grid``: a decision instant each day, 2 to 30 January 2024.
* ``panel``: monthly growth of six assets (return flag and line status), from the ratio of
  mean prices, damped to keep wealth near 1; available 45 days after the month's end.
* ``targets``: decisions every third month.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintara.functions.calendar import month_end
from vintara.storage import saved

LATE_HOURS, REVISED_EVERY, REVISED_DAYS = 72, 10, 5
PUBLICATION_LAG = "INTERVAL 45 DAYS"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; times without a zone are read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def plain_times(df: DataFrame) -> DataFrame:
    """Instants as times without a zone, as the reference engine has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.make_dt_interval(F.lit(0), (F.col("event_id") % LATE_HOURS).cast("int"))
    first = table(spark, sf_dir, "events").select(
        F.concat(F.lit("EV/"), "event_type").alias("series_id"),
        F.col("ts").alias("observation_time"),
        (F.col("ts") + hours).alias("available_time"),
        "value",
        F.col("event_id").alias("ord"),
    )
    revised = first.where(F.col("ord") % REVISED_EVERY == 0).select(
        "series_id",
        "observation_time",
        (F.col("available_time") + F.expr(f"INTERVAL {REVISED_DAYS} DAYS")).alias("available_time"),
        (F.col("value") * 1.01).alias("value"),
        "ord",
    )
    return first.unionByName(revised)


OBS = f"""obs AS (
    SELECT 'EV/' || event_type AS series_id, ts AS observation_time,
           ts + to_hours(CAST(event_id % {LATE_HOURS} AS INTEGER)) AS available_time, value, event_id AS ord
    FROM events
    UNION ALL
    SELECT 'EV/' || event_type, ts, ts + to_hours(CAST(event_id % {LATE_HOURS} AS INTEGER)) + INTERVAL {REVISED_DAYS} DAYS,
           value * 1.01, event_id
    FROM events WHERE event_id % {REVISED_EVERY} = 0)"""


def grid(spark: SparkSession) -> DataFrame:
    return spark.range(29).select(
        (F.to_timestamp(F.lit("2024-01-02 00:00:00")) + F.make_dt_interval(F.col("id").cast("int"))).alias("decision_time"),
        F.col("id").cast("int").alias("ord"),
    )


GRID = """grid AS (
    SELECT TIMESTAMP '2024-01-02' + to_days(CAST(i AS INTEGER)) AS decision_time, CAST(i AS INTEGER) AS ord
    FROM range(29) t(i))"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``asset, month, month_end, available_time, r, g`` of months in which all assets trade."""
    monthly = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.concat("l_returnflag", "l_linestatus").alias("asset"), F.trunc("l_shipdate", "month").alias("month"))
        .agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    )
    before = F.lag("price").over(Window.partitionBy("asset").orderBy("month"))
    returns = monthly.withColumn("r", 0.1 * (F.col("price") / before - 1)).where("r IS NOT NULL")
    n = F.count(F.lit(1)).over(Window.partitionBy("month"))
    full = returns.withColumn("_n", n).where(F.col("_n") == 6)
    end = month_end(F.year("month"), F.month("month"))
    return saved(full.select(
        "asset", "month", end.alias("month_end"), (end + F.expr(PUBLICATION_LAG)).alias("available_time"), "r", (1 + F.col("r")).alias("g")
    ))


PANEL = f"""monthly AS (
    SELECT l_returnflag || l_linestatus AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
           avg(l_extendedprice / l_quantity) AS price
    FROM lineitem GROUP BY ALL),
  rets AS (
    SELECT asset, month, 0.1 * (price / lag(price) OVER (PARTITION BY asset ORDER BY month) - 1) AS r FROM monthly),
  panel AS (
    SELECT asset, month, CAST(month AS TIMESTAMP) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND AS month_end,
           CAST(month AS TIMESTAMP) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND + {PUBLICATION_LAG} AS available_time,
           r, 1 + r AS g
    FROM (SELECT *, count(*) OVER (PARTITION BY month) AS n FROM rets WHERE r IS NOT NULL) WHERE n = 6)"""


def months(panel: DataFrame) -> DataFrame:
    """``month, instant, position``: the panel's months in order, from 0.

    A month's growth is that of the segment that begins at its ``instant``.
    """
    found = panel.select("month").distinct()
    place = F.row_number().over(Window.orderBy("month")) - 1  # one row a month
    return saved(found.select("month", F.col("month").cast("timestamp").alias("instant"), place.alias("position")))


MONTHS = """months AS (
    SELECT month, CAST(month AS TIMESTAMP) AS instant, CAST(row_number() OVER (ORDER BY month) - 1 AS INTEGER) AS position
    FROM (SELECT DISTINCT month FROM panel))"""

#: Returns that a decision needs before it; months between decisions.
WINDOW, EVERY = 12, 3


def decisions(months: DataFrame) -> DataFrame:
    """Every third month's start, once enough months are published."""
    return months.where((F.col("position") >= WINDOW + 3) & (F.col("position") % EVERY == 0)).select(
        F.col("instant").alias("decision_time"), "position"
    )


class Market:
    """The panel, its months and the decisions on them, each made once for all that a query reads of it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.panel = panel(spark, sf_dir)

    @cached_property
    def months(self) -> DataFrame:
        return months(self.panel)

    @cached_property
    def decisions(self) -> DataFrame:
        return decisions(self.months)

    @property
    def factors(self) -> DataFrame:
        """``instant, asset, g``: growth of the segment that begins at an instant."""
        return self.panel.select(F.col("month").cast("timestamp").alias("instant"), "asset", "g")


DECISIONS = f"""decisions AS (
    SELECT instant AS decision_time, position FROM months WHERE position >= {WINDOW + 3} AND position % {EVERY} = 0)"""

# The windows of the decisions and inverse-volatility targets, in SQL.
WINDOWS = f"""windows AS (
    SELECT decision_time, asset, month, r FROM (
      SELECT d.decision_time, p.asset, p.month, p.r,
             row_number() OVER (PARTITION BY d.decision_time, p.asset ORDER BY p.month DESC) AS k
      FROM panel p JOIN decisions d ON p.available_time <= d.decision_time) WHERE k <= {WINDOW})"""
INVERSE_VOL = """scores AS (
    SELECT decision_time, asset, 1 / sqrt(var_pop(r) * count(r)) AS score FROM windows GROUP BY ALL),
  inverse_vol AS (
    SELECT decision_time, asset, score / sum(score) OVER (PARTITION BY decision_time) AS weight FROM scores)"""
