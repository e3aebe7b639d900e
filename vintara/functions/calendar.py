"""Calendar expressions and grids of instants.

Instants are TIMESTAMP columns; the session's time zone is UTC. A period's end is its last
microsecond in the declared zone.
"""

from __future__ import annotations

import re
from datetime import datetime, time
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintara.checks import require_none
from vintara.errors import (
    GridDeclarationError,
    InvalidChronologyError,
    NaiveTimestampError,
    ProtocolStructureError,
    ScheduleStructureError,
)

#: ISO 8601 text with an explicit offset.
OFFSET_PATTERN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"
_DAY_END = "59.999999"


def to_instant(text: Column) -> Column:
    """The instant of ISO text with an offset; null for naive text, dates and the rest."""
    return F.when(text.rlike(OFFSET_PATTERN), F.try_to_timestamp(text))


def require_instant(value: datetime, field: str) -> datetime:
    """A zone-aware ``datetime`` as UTC."""
    if not isinstance(value, datetime) or value.tzinfo is None or value.utcoffset() is None:
        raise NaiveTimestampError(f"{field} must be a zone-aware datetime; got {value!r}")
    return value.astimezone(ZoneInfo("UTC"))


def day_end(year: Column, month: Column, day: Column, tz: str = "UTC") -> Column:
    """The last microsecond of a day."""
    seconds = F.lit(_DAY_END).cast("decimal(16,6)")
    return F.make_timestamp(year, month, day, F.lit(23), F.lit(59), seconds, F.lit(tz))


def month_end(year: Column, month: Column, tz: str = "UTC") -> Column:
    """The last microsecond of a month."""
    return day_end(year, month, F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1)))), tz)


def quarter_end(year: Column, quarter: Column, tz: str = "UTC") -> Column:
    """The last microsecond of a quarter (1 to 4)."""
    return month_end(year, quarter * 3, tz)


def shift_months(moment: Column, months: Column | int) -> Column:
    """Months later, the day clamped to the month's last."""
    months = F.lit(months) if isinstance(months, int) else months
    return moment + F.make_ym_interval(F.lit(0), months)


def grid_before(span_start: Column, months: Column | int, tz: str = "UTC") -> Column:
    """The month end just before ``span_start`` moved by ``months``."""
    local = F.from_utc_timestamp(shift_months(span_start, months) - F.expr("INTERVAL 1 MICROSECOND"), tz)
    return month_end(F.year(local), F.month(local), tz)


def period_end_schedule(spark: SparkSession, year: int, month: int, count: int, step: int = 1, tz: str = "UTC") -> DataFrame:
    """``ord, instant``: ``count`` month ends, ``step`` months apart, from a given month."""
    if count < 1 or not 1 <= month <= 12 or step < 1:
        raise GridDeclarationError("a grid has at least one instant and starts in a month from 1 to 12")
    first = year * 12 + month - 1
    at = F.lit(first) + F.col("ord") * step
    return spark.range(count).select(
        F.col("id").cast("int").alias("ord")
    ).select("ord", month_end(F.floor(at / 12).cast("int"), (at % 12 + 1).cast("int"), tz).alias("instant"))


def month_end_schedule(spark: SparkSession, year: int, month: int, count: int, tz: str = "UTC") -> DataFrame:
    return period_end_schedule(spark, year, month, count, 1, tz)


def quarter_end_schedule(spark: SparkSession, year: int, quarter: int, count: int, tz: str = "UTC") -> DataFrame:
    if not 1 <= quarter <= 4:
        raise GridDeclarationError("a quarter is from 1 to 4")
    return period_end_schedule(spark, year, 3 * quarter, count, 3, tz)


def grid_violations(grid: DataFrame, instant: str = "instant", ord_: str = "ord", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose instant isn't after the one before."""
    before = F.lag(instant).over(Window.partitionBy(*by).orderBy(ord_))
    return grid.withColumn("before", before).where(F.col("before") >= F.col(instant))


def require_increasing(grid: DataFrame, instant: str = "instant", ord_: str = "ord") -> DataFrame:
    require_none(grid_violations(grid, instant, ord_), GridDeclarationError, "instants must strictly increase")
    return grid


def holding_instants(accounting: DataFrame, decisions: DataFrame, instant: str = "instant") -> DataFrame:
    """The accounting instants that are decision instants."""
    return accounting.select(instant).intersect(decisions.select(instant))


def month_end_refits(spark: SparkSession, start: datetime, end: datetime, every_months: int, role: str, tz: str = "UTC") -> DataFrame:
    """``cutoff, role``: month ends every ``every_months`` months within ``[start, end]``."""
    if every_months < 1:
        raise ProtocolStructureError("a cadence is of at least one month")
    a, b = require_instant(start, "start"), require_instant(end, "end")
    if a >= b:
        raise InvalidChronologyError("start must be before end")
    local = a.astimezone(ZoneInfo(tz))
    months = (b.year - a.year + 1) * 12 + 12
    grid = period_end_schedule(spark, local.year, local.month, months // every_months + 1, every_months, tz)
    inside = F.col("instant").between(F.lit(a), F.lit(b))
    return grid.where(inside).select(F.col("instant").alias("cutoff"), F.lit(role).alias("role"))


def quarter_end_refits(spark: SparkSession, start: datetime, end: datetime, every_quarters: int, role: str, tz: str = "UTC") -> DataFrame:
    """As :func:`month_end_refits`, over ends of calendar quarters."""
    if every_quarters < 1:
        raise ProtocolStructureError("a cadence is of at least one quarter")
    a, b = require_instant(start, "start"), require_instant(end, "end")
    if a >= b:
        raise InvalidChronologyError("start must be before end")
    local = a.astimezone(ZoneInfo(tz))
    count = (b.year - a.year + 1) * 4 // every_quarters + 2
    grid = period_end_schedule(spark, local.year, 3 * ((local.month - 1) // 3 + 1), count, 3 * every_quarters, tz)
    inside = F.col("instant").between(F.lit(a), F.lit(b))
    return grid.where(inside).select(F.col("instant").alias("cutoff"), F.lit(role).alias("role"))


def observation_refits(instants: DataFrame, every: int, by: tuple[str, ...] = (), instant: str = "instant") -> DataFrame:
    """Every ``every``-th observation instant, in order, within each partition."""
    if every < 1:
        raise ScheduleStructureError("a cadence is of at least one observation")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(instant))
    return instants.withColumn("position", place).where(F.col("position") % every == 0)


_SPAN = re.compile(r"(\d{4}-\d{2}-\d{2})\.\.(\d{4}-\d{2}-\d{2})")


def evaluation_span(literal: str, tz: str = "UTC") -> tuple[datetime, datetime]:
    """``YYYY-MM-DD..YYYY-MM-DD`` as the first and last microsecond of the span."""
    found = _SPAN.fullmatch(literal) if isinstance(literal, str) else None
    if not found:
        raise ProtocolStructureError(f"a span is YYYY-MM-DD..YYYY-MM-DD; got {literal!r}")
    try:
        first, last = (datetime.strptime(text, "%Y-%m-%d") for text in found.groups())
    except ValueError as bad:
        raise ProtocolStructureError(f"no such day in {literal!r}") from bad
    zone = ZoneInfo(tz)
    start, end = first.replace(tzinfo=zone), datetime.combine(last, time.max, zone)
    if start >= end:
        raise ProtocolStructureError(f"a span ends after it starts; got {literal!r}")
    return start, end


def realization_violations(df: DataFrame) -> DataFrame:
    """Rows of ``decision_time, execution_time, start, end`` out of order."""
    lawful = (
        (F.col("decision_time") <= F.col("execution_time"))
        & (F.col("execution_time") <= F.col("start"))
        & (F.col("start") < F.col("end"))
    )
    return df.where(~F.coalesce(lawful, F.lit(False)))


_HORIZON = re.compile(r"(?:(\d+) days?, )?(\d|1\d|2[0-3]):([0-5]\d):([0-5]\d)(?:\.(\d{6}))?")


def horizon_seconds(text: str) -> float:
    """Seconds of ``N days, H:MM:SS``, more than none."""
    found = _HORIZON.fullmatch(text)
    if not found:
        raise GridDeclarationError(f"not a horizon: {text!r}")
    days, hours, minutes, seconds, micros = (int(x or 0) for x in found.groups())
    total = days * 86400 + hours * 3600 + minutes * 60 + seconds + micros / 1e6
    if total <= 0:
        raise GridDeclarationError(f"a horizon is positive: {text!r}")
    return total
