"""Research factor files: zipped text with one block of dated rows.

Archives are read as binary files and unzipped in tasks, one file a task; dates, missing
markers and availability are column expressions.
"""

from __future__ import annotations

import hashlib
import io
import urllib.request
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintara.checks import require_none
from vintara.errors import ProviderResponseError, UnknownDatasetError
from vintara.functions.calendar import day_end, month_end
from vintara.operators.pit import require_observations
from vintara.sources.tables import Availability, Provenance, require_both

KINDS = ("factor", "portfolio_returns")
PREFIX = "FF/"
#: The provider's marks for a missing number.
MISSING = (-99.99, -999.0)
_BASE = "https://mba.tuck.dartmouth.edu/pages/faculty/ken.french/ftp/"


@dataclass(frozen=True)
class FactorFile:
    """A file of the catalog; ``section`` names the block to read, if it isn't the factors'."""

    archive: str
    member: str
    kind: str
    frequency: str
    fixed_width: bool = False
    section: str | None = None
    units: str = "percent"


# The provider's files.
CATALOG = {
    "factors_monthly_csv": FactorFile("F-F_Research_Data_Factors_CSV.zip", "F-F_Research_Data_Factors.csv", "factor", "monthly"),
    "factors_monthly_txt": FactorFile("F-F_Research_Data_Factors_TXT.zip", "F-F_Research_Data_Factors.txt", "factor", "monthly", True),
    "factors_daily_csv": FactorFile("F-F_Research_Data_Factors_daily_CSV.zip", "F-F_Research_Data_Factors_daily.csv", "factor", "daily"),
    "industry49_monthly_csv": FactorFile(
        "49_Industry_Portfolios_CSV.zip", "49_Industry_Portfolios.csv", "portfolio_returns", "monthly",
        section="Average Value Weighted Returns -- Monthly",
    ),
}
ALIASES = {("factors", "monthly"): "factors_monthly_csv", ("factors", "daily"): "factors_daily_csv", ("industry49", "monthly"): "industry49_monthly_csv"}


def entry(dataset_id: str) -> FactorFile:
    if dataset_id not in CATALOG:
        raise UnknownDatasetError(f"{dataset_id!r} is none of {sorted(CATALOG)}")
    return CATALOG[dataset_id]


def resolve(name: str, frequency: str = "monthly") -> str:
    """A dataset by its own name, or by a short one and a frequency."""
    if name in CATALOG:
        return name
    if (name, frequency) not in ALIASES:
        raise UnknownDatasetError(f"no dataset {name!r} at frequency {frequency!r}")
    return ALIASES[name, frequency]


def fetch(dataset_id: str, timeout: float = 60) -> tuple[bytes, datetime]:
    """The archive from the provider, and when it was retrieved. Runs on the driver."""
    with urllib.request.urlopen(_BASE + entry(dataset_id).archive, timeout=timeout) as answer:
        return answer.read(), datetime.now(timezone.utc)


def _fields(line: str, fixed_width: bool) -> list[str]:
    return line.split() if fixed_width else [cell.strip() for cell in line.split(",")]


def scan_block(text: str, file: FactorFile) -> Iterator[tuple[str, str, str]]:
    """``name, key, cell`` of the first block of dated rows under its header.

    The block ends at a blank line or at a line that begins with no digit.
    """
    lines = iter(text.splitlines())
    for line in lines:
        if file.section is None and all(word in line for word in ("Mkt-RF", "SMB", "RF")):
            header = line
            break
        if file.section is not None and line.strip() == file.section:
            header = next(lines, "")
            break
    else:
        raise ProviderResponseError("the text has no such block")
    names = _fields(header, file.fixed_width)
    names = names if file.fixed_width else names[1:]
    some = False
    for line in lines:
        cells = _fields(line, file.fixed_width)
        if not line.strip():
            if some:
                break
            continue
        if not cells[0].isdigit():
            break
        some = True
        for name, cell in zip(names, cells[1:]):
            yield name, cells[0], cell
    if not some:
        raise ProviderResponseError("the block has no rows")


def _unzip(data: bytes, file: FactorFile) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            if archive.namelist() != [file.member]:
                raise ProviderResponseError(f"the archive holds {archive.namelist()}, not only {file.member}")
            return archive.read(file.member).decode("ascii")
    except (zipfile.BadZipFile, UnicodeDecodeError) as bad:
        raise ProviderResponseError(f"not the provider's archive: {bad}") from bad


def decode_cells(archives: DataFrame, dataset_id: str) -> DataFrame:
    """``series_id, period_key, value`` of archives, which are rows with ``content``."""
    file = entry(dataset_id)

    def cells(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = list(scan_block(_unzip(data, file), file))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["name", "period_key", "cell"])

    found = archives.select("content").mapInArrow(cells, "name string, period_key string, cell string")
    number = F.trim("cell").try_cast("double")
    rows = found.where(F.trim("cell") != "").withColumn("value", number)
    return rows.select(
        F.concat(F.lit(f"{PREFIX}{dataset_id}/"), "name").alias("series_id"), "period_key", "cell", "value"
    )


def decode_unqualified(spark: SparkSession, data: bytes, dataset_id: str) -> DataFrame:
    """Rows with the provider's own period labels; missing numbers are no rows."""
    rows = decode_cells(spark.createDataFrame([(bytearray(data),)], "content binary"), dataset_id)
    require_none(rows.where("value IS NULL"), ProviderResponseError, "a cell is no number")
    return rows.where(~F.col("value").isin(*MISSING)).select("series_id", "period_key", "value")


def period_instant(key, frequency: str, tz: str = "UTC"):
    """The last instant of YYYYMM or YYYYMMDD."""
    part = lambda a, n: F.substring(key, a, n).cast("int")
    if frequency == "daily":
        return day_end(part(1, 4), part(5, 2), part(7, 2), tz)
    return month_end(part(1, 4), part(5, 2), tz)


def qualify(rows: DataFrame, frequency: str, availability: Availability, tz: str) -> DataFrame:
    """Period-labelled rows as bitemporal observations under a policy."""
    length = 8 if frequency == "daily" else 6
    require_none(rows.where(F.length("period_key") != length), ProviderResponseError, "a key of another frequency")
    at = rows.withColumn("observation_time", period_instant(F.col("period_key"), frequency, tz))
    if availability.mode == "SAME_INSTANT":
        known = F.col("observation_time")
    elif availability.mode == "FIXED_LAG":
        lag = availability.lag
        known = F.col("observation_time") + F.make_dt_interval(F.lit(lag.days), F.lit(0), F.lit(0), F.lit(lag.seconds).cast("decimal(18,6)"))
    else:
        raise ProviderResponseError("the files have no availability column")
    return require_observations(at.select("series_id", "observation_time", known.alias("available_time"), "value"))


def decode(spark: SparkSession, data: bytes, dataset_id: str, availability: Availability, tz: str, sha256: str | None = None) -> tuple[DataFrame, Provenance]:
    """Observations of an archive, and where they are from. A pinned digest must match."""
    digest = hashlib.sha256(data).hexdigest()
    if sha256 is not None and digest != sha256:
        raise ProviderResponseError("the bytes aren't those that were pinned")
    file = entry(dataset_id)
    rows = qualify(decode_unqualified(spark, data, dataset_id), file.frequency, availability, tz)
    return rows, Provenance(file.kind, tuple(rows.columns), rows.count(), file.units, file.frequency, digest)


def load(spark: SparkSession, name: str, *, frequency: str = "monthly", data: bytes | None = None, availability: Availability | None = None, tz: str | None = None, sha256: str | None = None) -> DataFrame:
    """Unqualified rows of a dataset, or observations if an availability and a zone are given.

    One of the two without the other is rejected. A pinned digest must be that of the bytes.
    """
    require_both(availability, tz)
    dataset_id = resolve(name, frequency)
    content = fetch(dataset_id)[0] if data is None else data
    if sha256 is not None and hashlib.sha256(content).hexdigest() != sha256:
        raise ProviderResponseError("the bytes aren't those that were pinned")
    if availability is None:
        return decode_unqualified(spark, content, dataset_id)
    return decode(spark, content, dataset_id, availability, tz)[0]


def require_candidate_returns(provenance: Provenance) -> None:
    """Only portfolio returns may serve as asset returns."""
    if provenance.kind != "portfolio_returns":
        raise UnknownDatasetError(f"{provenance.kind} data aren't asset returns")
