"""Chronologically valid features of bitemporal series.

Inputs have ``series_id, observation_time, available_time, value`` and may have ``ord``, the
order of submission. Windows run in order of availability, with ties by observation time
and ``ord``. Many series are handled at once.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.checks import require_none
from vintara.errors import AmbiguousObservationError, InsufficientWindowError, WindowDeclarationError
from vintara.operators.buckets import BUCKET_ROWS, bucketed, in_one_bucket, running
from vintara.operators.pit import as_of

_COLUMNS = ("series_id", "observation_time", "available_time", "value")


def _order(df: DataFrame) -> list[str]:
    return ["available_time", "observation_time", *(["ord"] if "ord" in df.columns else [])]


def _rolling(df: DataFrame, window: int, suffix: str, of, least: int = 1) -> DataFrame:
    if not isinstance(window, int) or isinstance(window, bool) or window < least:
        raise WindowDeclarationError(f"a window is of at least {least} rows; got {window!r}")
    order = _order(df)
    dealt = _with_halo(df, order, window)
    frame = Window.partitionBy("series_id", "_bucket").orderBy(*order).rowsBetween(1 - window, 0)
    return (
        dealt.withColumn("_n", F.count(F.lit(1)).over(frame))
        .withColumn("_v", of("value").over(frame))
        .where((F.col("_n") == window) & ~F.col("_halo"))
        .select(
            F.concat("series_id", F.lit(f"|{suffix}[{window}]")).alias("series_id"),
            F.col("available_time").alias("observation_time"),
            "available_time",
            F.col("_v").alias("value"),
        )
    )


def _with_halo(df: DataFrame, order: list[str], window: int) -> DataFrame:
    """``df`` in range buckets, each led by the last ``window - 1`` rows of the bucket before.

    A bucket that lies within a series has at least so many rows; should one not, which
    needs a window of a bucket's size, each series is one bucket.
    """
    rows = max(BUCKET_ROWS, 8 * window)
    if in_one_bucket(df, rows):
        return df.withColumns({"_bucket": F.lit(0), "_halo": F.lit(False)})
    dealt = bucketed(df, ["series_id"], order, rows)
    sizes = dealt.groupBy("series_id", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    of_series = Window.partitionBy("series_id")
    inner = sizes.withColumns({"_first": F.min("_bucket").over(of_series), "_last": F.max("_bucket").over(of_series)})
    if not inner.where(F.col("_bucket").between(F.col("_first") + 1, F.col("_last") - 1) & (F.col("_rows") < window - 1)).isEmpty():
        return df.withColumns({"_bucket": F.lit(0), "_halo": F.lit(False)})
    back = Window.partitionBy("series_id", "_bucket").orderBy(*(F.col(c).desc() for c in order))
    led = dealt.withColumn("_back", F.row_number().over(back)).where(F.col("_back") < window).drop("_back")
    return dealt.withColumn("_halo", F.lit(False)).unionByName(
        led.withColumn("_bucket", F.col("_bucket") + 1).withColumn("_halo", F.lit(True))
    )


def require_single_series(df: DataFrame) -> DataFrame:
    """``df``, if it has one series: transforms take many, and this is for those who expect one."""
    names = [r["series_id"] for r in df.select("series_id").distinct().limit(2).collect()]
    if len(names) != 1:
        raise AmbiguousObservationError(f"one series is expected; got {names or 'none'}")
    return df


def rolling_mean(df: DataFrame, window: int) -> DataFrame:
    """Means of the last ``window`` rows; full windows only."""
    return _rolling(df, window, "rolling_mean", F.avg)


def rolling_volatility(df: DataFrame, window: int) -> DataFrame:
    """Population standard deviations of the last ``window`` rows."""
    return _rolling(df, window, "rolling_volatility", F.stddev_pop, 2)


def require_rows(df: DataFrame, window: int) -> DataFrame:
    """``df`` if every series has at least ``window`` rows."""
    short = df.groupBy("series_id").count().where(F.col("count") < window)
    require_none(short, InsufficientWindowError, "fewer rows than the window")
    return df


def _interval(step: timedelta) -> Column:
    return F.make_dt_interval(F.lit(step.days), F.lit(0), F.lit(0), F.lit(step.seconds + step.microseconds / 1e6).cast("decimal(18,6)"))


def lag(df: DataFrame, periods: int, frequency: timedelta) -> DataFrame:
    """Values moved ``periods`` steps later in time; not a row offset."""
    if periods < 1 or frequency <= timedelta(0):
        raise WindowDeclarationError("a lag is of at least one positive period")
    moved = F.col("observation_time") + _interval(periods * frequency)
    return df.select(
        F.concat("series_id", F.lit(f"|lag[{periods}]")).alias("series_id"),
        moved.alias("observation_time"),
        F.greatest("available_time", moved).alias("available_time"),
        "value",
    )


def carry_forward(
    df: DataFrame, references: DataFrame, max_staleness: timedelta, real_time_surface: bool = False, few: bool | None = None
) -> DataFrame:
    """At each reference instant the latest published value, if it isn't stale.

    ``references`` has ``decision_time``. The latest publication wins, even a revision of
    an older period. The result is available at the reference instant.
    """
    if max_staleness < timedelta(0):
        raise WindowDeclarationError("staleness isn't negative")
    found = as_of(df, references, latest=("available_time", "observation_time"), few=few)
    fresh = F.col("decision_time") - F.col("available_time") <= _interval(max_staleness)
    shown = F.col("decision_time") if real_time_surface else F.col("observation_time")
    return found.where(fresh).select(
        F.concat("series_id", F.lit("|carry_forward")).alias("series_id"),
        shown.alias("observation_time"),
        F.col("decision_time").alias("available_time"),
        "value",
    )


def _scaled(df: DataFrame, fit: DataFrame, suffix: str, measures: dict[str, Column], value: Column, spread: str) -> DataFrame:
    last = F.max("available_time").alias("_fit_available")
    stats = fit.groupBy("series_id").agg(*(c.alias(n) for n, c in measures.items()), F.count("value").alias("_n"), last)
    require_none(
        stats.where((F.col("_n") < 2) | F.col(spread).isNull() | (F.col(spread) == 0)),
        InsufficientWindowError,
        "a scaler needs two rows with spread",
    )
    # One row for each series of the fit set.
    return df.join(stats, "series_id").select(
        F.concat("series_id", F.lit(f"|{suffix}")).alias("series_id"),
        "observation_time",
        F.greatest("available_time", "_fit_available").alias("available_time"),
        value.alias("value"),
    )


def standard_scale(df: DataFrame, fit: DataFrame) -> DataFrame:
    """Values less the fit set's mean, over its population standard deviation."""
    return _scaled(
        df, fit, "standard_scaled", {"_mean": F.avg("value"), "_sd": F.stddev_pop("value")},
        (F.col("value") - F.col("_mean")) / F.col("_sd"), "_sd",
    )


def minmax_scale(df: DataFrame, fit: DataFrame) -> DataFrame:
    """Values less the fit set's minimum, over its range."""
    return _scaled(
        df, fit, "minmax_scaled",
        {"_low": F.min("value"), "_range": F.max("value") - F.min("value")},
        (F.col("value") - F.col("_low")) / F.col("_range"), "_range",
    )


def latest_window(df: DataFrame, window: int, by: tuple[str, ...] = ("series_id",), time: str = "observation_time") -> DataFrame:
    """The last ``window`` rows of each group by ``time``."""
    if window < 1:
        raise WindowDeclarationError("a window is of at least one row")
    last = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(time).desc()))
    return df.withColumn("_r", last).where(F.col("_r") <= window).drop("_r")


def unbalanced(df: DataFrame, window: int, decision: str = "decision_time", series: str = "series_id", time: str = "observation_time") -> DataFrame:
    """Instants of a decision's windows that not all its series have."""
    n = df.groupBy(decision).agg(F.count_distinct(series).alias("_series"))
    have = df.groupBy(decision, time).agg(F.count_distinct(series).alias("_have"))
    return have.join(n, decision).where(F.col("_have") < F.col("_series"))


def window_start(instants: DataFrame, anchors: DataFrame, n: int, instant: str = "instant", anchor: str = "cutoff") -> DataFrame:
    """For each anchor the ``n``-th latest instant at or before it."""
    # Anchors stand among the instants and take their running number; ranks then meet ranks.
    points = instants.select(F.col(instant).alias("_t"), F.lit(1).alias("_point"), F.lit(None).cast("int").alias("_asks")).distinct()
    asked = anchors.select(F.col(anchor).alias("_t"), F.lit(None).cast("int").alias("_point"), F.lit(1).alias("_asks")).distinct()
    placed = running(points.unionByName(asked), [], ["_t"], {"_rank": ("count", F.col("_point"))})
    ranked = placed.where("_point = 1").select(F.col("_t").alias("window_start"), "_rank")
    wanted = placed.where("_asks = 1").select(F.col("_t").alias(anchor), (F.col("_rank") - (n - 1)).alias("_rank"))
    return wanted.join(ranked, "_rank").select(anchor, "window_start")


def simple_returns(df: DataFrame) -> DataFrame:
    """``value`` over the one before, less 1, in order of observation."""
    before = F.lag("value").over(Window.partitionBy("series_id").orderBy("observation_time"))
    return df.withColumn("value", F.try_divide("value", before) - 1).where(F.col("value").isNotNull()).select(*_COLUMNS)
