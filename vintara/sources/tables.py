"""Tables as bitemporal observations: declared schemas, availability policies, provenance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintara.checks import require_columns, require_none
from vintara.errors import MissingAvailabilityError, NaiveTimestampError, WindowDeclarationError
from vintara.functions.calendar import OFFSET_PATTERN, to_instant
from vintara.operators.pit import require_observations
from vintara.storage import shared_path

MODES = ("EXPLICIT_COLUMN", "SAME_INSTANT", "FIXED_LAG")
#: The columns of observations; ``value`` is null unless ``value_kind`` is number.
COLUMNS = ("series_id", "observation_time", "available_time", "value", "value_str", "value_bool", "value_kind")


@dataclass(frozen=True)
class Availability:
    """When a row became knowable."""

    mode: str
    column: str | None = None
    lag: timedelta = timedelta(0)
    justification: str = ""

    @classmethod
    def explicit_column(cls, name: str) -> Availability:
        """As a column of the row says."""
        if not name.strip():
            raise MissingAvailabilityError("the availability column needs a name")
        return cls("EXPLICIT_COLUMN", column=name)

    @classmethod
    def same_instant(cls) -> Availability:
        """With the observation."""
        return cls("SAME_INSTANT")

    @classmethod
    def fixed_lag(cls, lag: timedelta, *, justification: str) -> Availability:
        """A fixed time after the observation; why must be said."""
        if lag < timedelta(0) or not justification.strip():
            raise WindowDeclarationError("a lag isn't negative and has a justification")
        return cls("FIXED_LAG", lag=lag, justification=justification)


@dataclass(frozen=True)
class DeclaredTable:
    """What a table's columns mean; nothing is inferred."""

    series_id_column: str
    observation_time_column: str
    availability: Availability
    value_column: str
    units: str
    frequency: str
    description_column: str | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.availability, Availability):
            raise MissingAvailabilityError("a table needs an availability policy")
        for name in (self.series_id_column, self.observation_time_column, self.value_column, self.units, self.frequency):
            if not isinstance(name, str) or not name.strip():
                raise ValueError("names, units and frequency aren't blank")

    def columns(self) -> list[str]:
        more = [self.availability.column] if self.availability.mode == "EXPLICIT_COLUMN" else []
        return [self.series_id_column, self.observation_time_column, self.value_column, *more]


@dataclass(frozen=True)
class Provenance:
    """Where a dataset is from."""

    kind: str
    columns: tuple[str, ...]
    row_count: int
    units: str
    frequency: str
    sha256: str | None = None
    extra: Mapping[str, str] = field(default_factory=dict)


def decode_cell(cell: Column) -> Column:
    """``value, value_str, value_kind`` of a CSV cell: int, then float, then text; blank is null."""
    text = F.trim(cell)
    number = F.when(text.rlike(r"^[+-]?(\d+|\d*\.\d+|\d+\.)([eE][+-]?\d+)?$"), text.try_cast("double"))
    kind = (
        F.when((text == "") | text.isNull(), "null")
        .when(text.rlike(r"^[+-]?\d+$"), "int")
        .when(number.isNotNull(), "float")
        .otherwise("str")
    )
    return F.struct(
        number.alias("value"), F.when(kind == "str", cell).alias("value_str"), kind.alias("value_kind")
    )


def _instants(df: DataFrame, name: str) -> tuple[Column, DataFrame]:
    """A column as instants, and the rows where it is none."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.col(name), df.where(F.col(name).isNull())
    if isinstance(kind, T.StringType):
        return to_instant(F.col(name)), df.where(~F.coalesce(F.col(name).rlike(OFFSET_PATTERN), F.lit(False)))
    return F.lit(None).cast("timestamp"), df


def _values(df: DataFrame, name: str, cells: bool) -> list[Column]:
    kind = df.schema[name].dataType
    none = F.lit(None)
    if isinstance(kind, T.StringType):
        if cells:
            cell = decode_cell(F.col(name))
            number = F.when(cell["value_kind"].isin("int", "float"), "number").otherwise(cell["value_kind"])
            parts = [cell["value"], cell["value_str"], none.cast("boolean"), number]
        else:
            parts = [none.cast("double"), F.col(name), none.cast("boolean"), F.when(F.col(name).isNull(), "null").otherwise("str")]
    elif isinstance(kind, T.BooleanType):
        parts = [none.cast("double"), none.cast("string"), F.col(name), F.when(F.col(name).isNull(), "null").otherwise("bool")]
    elif isinstance(kind, T.NumericType):
        parts = [F.col(name).cast("double"), none.cast("string"), none.cast("boolean"), F.when(F.col(name).isNull(), "null").otherwise("number")]
    else:
        raise ValueError(f"values of type {kind.simpleString()} aren't observations")
    return [p.alias(n) for p, n in zip(parts, COLUMNS[3:])]


def from_dataframe(df: DataFrame, declared: DeclaredTable, checked: bool = False, cells: bool = False) -> DataFrame:
    """Observations of a table under its declaration.

    With ``checked`` the rows are validated before: instants with a zone, a known
    availability not before the observation, identities that don't repeat. Without it the
    plan stays lazy, for sources that were validated when they were written.
    """
    wanted = declared.columns()
    if declared.availability.mode == "EXPLICIT_COLUMN" and declared.availability.column not in df.columns:
        raise MissingAvailabilityError(f"no column {declared.availability.column!r}")
    require_columns(df, wanted, ValueError)
    observed, naive = _instants(df, declared.observation_time_column)
    if declared.availability.mode == "EXPLICIT_COLUMN":
        available, unknown = _instants(df, declared.availability.column)
        if checked:
            require_none(unknown.select(*wanted), MissingAvailabilityError, "no availability")
    elif declared.availability.mode == "SAME_INSTANT":
        available = observed
    else:
        lag = declared.availability.lag
        seconds = F.lit(lag.seconds + lag.microseconds / 1e6).cast("decimal(18,6)")
        available = observed + F.make_dt_interval(F.lit(lag.days), F.lit(0), F.lit(0), seconds)
    if checked:
        require_none(naive.select(*wanted), NaiveTimestampError, "a time without an offset")
        blank = df.where(F.coalesce(F.trim(F.col(declared.series_id_column).cast("string")), F.lit("")) == "")
        require_none(blank.select(*wanted), ValueError, "a blank series")
    extra = [F.col("ord")] if "ord" in df.columns else []
    out = df.select(
        F.col(declared.series_id_column).cast("string").alias("series_id"),
        observed.alias("observation_time"),
        available.alias("available_time"),
        *_values(df, declared.value_column, cells),
        *extra,
    )
    return require_observations(out) if checked else out


def from_pandas(spark: SparkSession, frame, declared: DeclaredTable, checked: bool = True) -> DataFrame:
    """A pandas frame; its column names are the table's, its index plays no part.

    Columns of mixed Python values must be made of one type before, as a table's column has one.
    """
    named = frame.reset_index(drop=True)
    named.columns = [str(c) for c in named.columns]
    return from_dataframe(spark.createDataFrame(named), declared, checked)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of each file of a source, read by the executors, as its provenance."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def source_digest(spark: SparkSession, path: str) -> str:
    """One digest of a file's bytes, or of a folder's files in the order of their names."""
    found = [(r["path"].rsplit("/", 1)[-1], r["sha256"]) for r in file_digests(spark, path).select("path", "sha256").collect()]
    if len(found) == 1:
        return found[0][1]
    return hashlib.sha256("".join(f"{name}:{digest}\n" for name, digest in sorted(found)).encode()).hexdigest()


def from_csv(spark: SparkSession, source: str, declared: DeclaredTable, checked: bool = True, multi_line: bool = False) -> DataFrame:
    """A CSV file or folder (or its text, if it has a line break) with a header; cells are decoded.

    Cells in quotes may hold commas, doubled quotes and, in a text or with ``multi_line``
    (which a file pays for by being read in one piece), line breaks. Rows shorter than
    the header are filled with empty cells.
    """
    if "\n" in source:
        # The text goes through the shared folder, so that one reader serves files and texts.
        path = shared_path(spark, "csv")
        spark.createDataFrame([(source.removeprefix("\ufeff"),)], "text string").coalesce(1).write.text(path)
        source, multi_line = path, True
    options = {"header": "true", "encoding": "UTF-8", "mode": "PERMISSIVE", "escape": '"', "multiLine": str(multi_line).lower()}
    frame = spark.read.options(**options).csv(source, inferSchema=False)
    return from_dataframe(frame.fillna(""), declared, checked, cells=True)


def from_parquet(spark: SparkSession, path: str, declared: DeclaredTable, checked: bool = True) -> DataFrame:
    return from_dataframe(spark.read.parquet(path), declared, checked)


def from_records(spark: SparkSession, records: Iterable[Mapping], declared: DeclaredTable, schema: T.StructType, checked: bool = True) -> DataFrame:
    """Row mappings of a known schema."""
    return from_dataframe(spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in records], schema), declared, checked)


def provenance(df: DataFrame, declared: DeclaredTable, kind: str, data: bytes | None = None, path: str | None = None) -> Provenance:
    """Row count, columns and, where there are bytes or a ``path`` that was read, their digest."""
    digest = hashlib.sha256(data).hexdigest() if data is not None else None
    if digest is None and path is not None:
        digest = source_digest(df.sparkSession, path)
    return Provenance(kind, tuple(df.columns), df.count(), declared.units, declared.frequency, digest)


def require_both(availability: Availability | None, tz: str | None) -> None:
    """Reject an availability without a zone, or a zone without an availability."""
    if (availability is None) != (tz is None):
        raise MissingAvailabilityError("an availability and a zone are given together or not at all")
