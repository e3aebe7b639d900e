"""Macroeconomic series from the FRED web service.

Answers are JSON with an array of dated values, decoded by Spark's JSON functions.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from datetime import datetime, time, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintara.checks import require_none
from vintara.errors import (
    ProviderResponseError,
    PseudoVintageError,
    UnknownProviderSeriesError,
    UnsupportedFrequencyError,
)
from vintara.functions.calendar import day_end, month_end, quarter_end, require_instant
from vintara.operators.pit import require_observations
from vintara.sources.tables import Availability, require_both

CURRENT_SNAPSHOT, POINT_IN_TIME = "CURRENT_SNAPSHOT", "POINT_IN_TIME"
FREQUENCIES = ("Monthly", "Quarterly", "Daily")
PREFIX, MISSING = "FRED/", "."
_URL = "https://api.stlouisfed.org/fred/series/observations"
_ANSWER = (
    "series_id STRING, realtime_start STRING, realtime_end STRING, error_code STRING, error_message STRING, "
    "observations ARRAY<STRUCT<date: STRING, realtime_start: STRING, realtime_end: STRING, value: STRING>>"
)


def fetch(series_id: str, api_key: str, realtime: str | None = None, timeout: float = 60) -> tuple[bytes, datetime]:
    """An answer from the service, and when it came. The key is checked and never kept."""
    if not (isinstance(api_key, str) and len(api_key) == 32 and api_key.isalnum() and api_key.islower()):
        raise ValueError("a key has 32 lower-case letters and digits")
    now = datetime.now(timezone.utc)
    day = realtime or now.strftime("%Y-%m-%d")
    query = {"series_id": series_id, "api_key": api_key, "file_type": "json", "realtime_start": day, "realtime_end": day}
    with urllib.request.urlopen(f"{_URL}?{urllib.parse.urlencode(query)}", timeout=timeout) as answer:
        return answer.read(), now


def require_payload(data: bytes, series_id: str) -> dict:
    """The answer's own facts, if it is one for this series."""
    try:
        payload = json.loads(data)
    except ValueError as bad:
        raise ProviderResponseError("not JSON") from bad
    if "error" in payload or "error_code" in payload:
        raise UnknownProviderSeriesError(str(payload.get("error", payload.get("error_message"))))
    for name in ("realtime_start", "realtime_end", "observations"):
        if name not in payload:
            raise ProviderResponseError(f"no {name}")
    if payload.get("series_id", series_id) != series_id:
        raise ProviderResponseError("an answer for another series")
    if not payload["observations"]:
        raise ProviderResponseError("no observations")
    return payload


def raw_rows(spark: SparkSession, data: bytes, series_id: str) -> DataFrame:
    """``date, value`` as the provider wrote them; missing values are no rows."""
    require_payload(data, series_id)
    answer = spark.createDataFrame([(data.decode(),)], "text string").select(F.from_json("text", _ANSWER).alias("a"))
    rows = answer.select(F.inline("a.observations")).select("date", F.col("value").alias("cell"))
    return rows.where(F.col("cell").isNotNull() & (F.col("cell") != MISSING))


def period_label(date, frequency: str | None):
    """YYYY-MM for months and quarters, else the date as it is."""
    return F.substring(date, 1, 7) if frequency in ("Monthly", "Quarterly") else date


def decode_unqualified(spark: SparkSession, data: bytes, series_id: str, frequency: str | None = None) -> DataFrame:
    rows = raw_rows(spark, data, series_id).withColumn("value", F.col("cell").try_cast("double"))
    require_none(rows.where("value IS NULL"), ProviderResponseError, "a value is no number")
    return rows.select(
        F.lit(PREFIX + series_id).alias("series_id"), period_label(F.col("date"), frequency).alias("period_key"), "value"
    )


def period_instant(date, frequency: str, tz: str = "UTC"):
    """The last instant of the period that a date begins; null if it begins none."""
    if frequency not in FREQUENCIES:
        raise UnsupportedFrequencyError(f"a frequency is of {FREQUENCIES}")
    year, month, day = (F.substring(date, a, n).cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    if frequency == "Daily":
        return day_end(year, month, day, tz)
    if frequency == "Monthly":
        return F.when(day == 1, month_end(year, month, tz))
    starts = (day == 1) & (month % 3 == 1)
    return F.when(starts, quarter_end(year, F.floor((month - 1) / 3).cast("int") + 1, tz))


def realtime_bound(data: bytes, series_id: str, tz: str) -> datetime:
    """The last instant of the answer's realtime-end day."""
    text = require_payload(data, series_id)["realtime_end"]
    try:
        day = datetime.strptime(text, "%Y-%m-%d")
    except (TypeError, ValueError) as bad:
        raise ProviderResponseError(f"no realtime end: {text!r}") from bad
    return datetime.combine(day, time.max, ZoneInfo(tz))


def decode(
    spark: SparkSession,
    data: bytes,
    series_id: str,
    availability: Availability,
    *,
    frequency: str,
    tz: str,
    retrieved: datetime | None = None,
    data_mode: str = CURRENT_SNAPSHOT,
) -> DataFrame:
    """Observations available at the later of the declared availability and the retrieval.

    A current snapshot says nothing about what was known before it was retrieved. Where
    the retrieval isn't known, it is taken as the last instant, in ``tz``, of the day that
    the answer itself names as its realtime end.
    """
    if data_mode == POINT_IN_TIME:
        raise PseudoVintageError("a current snapshot is no past vintage")
    if data_mode != CURRENT_SNAPSHOT:
        raise ProviderResponseError(f"no data mode {data_mode!r}")
    bound = F.lit(require_instant(retrieved, "retrieved") if retrieved is not None else realtime_bound(data, series_id, tz))
    rows = raw_rows(spark, data, series_id).withColumn("value", F.col("cell").try_cast("double"))
    require_none(rows.where("value IS NULL"), ProviderResponseError, "a value is no number")
    rows = rows.withColumn("observation_time", period_instant(F.col("date"), frequency, tz))
    require_none(rows.where("observation_time IS NULL"), ProviderResponseError, "a date that begins no period")
    declared = F.col("observation_time")
    if availability.mode == "FIXED_LAG":
        lag = availability.lag
        declared = declared + F.make_dt_interval(F.lit(lag.days), F.lit(0), F.lit(0), F.lit(lag.seconds).cast("decimal(18,6)"))
    elif availability.mode != "SAME_INSTANT":
        raise ProviderResponseError("the answers have no availability column")
    out = rows.select(
        F.lit(PREFIX + series_id).alias("series_id"), "observation_time", F.greatest(declared, bound).alias("available_time"), "value"
    )
    return require_observations(out)


def require_snapshot_recency(observations: DataFrame, retrieved: datetime) -> DataFrame:
    """Reject availability before the retrieval."""
    early = observations.where(F.col("available_time") < F.lit(require_instant(retrieved, "retrieved")))
    require_none(early, PseudoVintageError, "available before it was retrieved")
    return observations


def load(spark: SparkSession, series_id: str, *, frequency: str, data: bytes | None = None, api_key: str | None = None, retrieved: datetime | None = None, availability: Availability | None = None, tz: str | None = None) -> DataFrame:
    """Unqualified rows, or observations if an availability and a zone are given.

    The two are one piece of evidence: one without the other is rejected, never filled in.
    """
    require_both(availability, tz)
    if data is None:
        data, retrieved = fetch(series_id, api_key or "")
    if availability is None:
        return decode_unqualified(spark, data, series_id, frequency)
    return decode(spark, data, series_id, availability, frequency=frequency, tz=tz, retrieved=retrieved)
