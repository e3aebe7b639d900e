"""Many archives and answers at once: folders of a provider's files as one DataFrame.

Files are rows: Spark lists and reads them, each task decodes its own, and bytes never pass the
driver. A file's name says what it is; its digest stays with its rows and can be pinned. Every file is
checked, and what is wrong is a query over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintara.checks import require_none, require_unique
from vintara.errors import ProviderResponseError, PseudoVintageError, UnknownDatasetError, UnknownProviderSeriesError
from vintara.functions.calendar import day_end
from vintara.operators.pit import require_observations
from vintara.sources import factors, macro
from vintara.sources.tables import Availability
from vintara.storage import saved

_CELLS = "file string, sha256 string, dataset_id string, name string, period_key string, cell string, problem string"


def _file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, sha256, content`` of the zip archives below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    return files.select(_file_name(F.col("path")).alias("file"), F.sha2("content", 256).alias("sha256"), "content")


def require_pinned(files: DataFrame, pinned: DataFrame) -> DataFrame:
    """``files``, if they are exactly those of ``pinned`` (``file, sha256``), byte for byte."""
    require_unique(pinned, ["file"], ProviderResponseError, "a file is pinned twice")
    both = files.select("file", "sha256").join(pinned.select("file", F.col("sha256").alias("_pinned")), "file", "full")
    require_none(both.where("NOT sha256 <=> _pinned"), ProviderResponseError, "the bytes aren't those that were pinned")
    return files


def decode_archives(files: DataFrame) -> DataFrame:
    """``file, sha256, dataset_id, series_id, period_key, value`` of ``file, sha256, content``.

    The catalog names the dataset of each file, whatever copy it is (``name.zip``, ``any-prefix.name.zip``). Missing numbers are no rows; an
    unknown file, a wrong archive, and a cell that is no number end with an error that names the file.
    """
    known = {entry.archive: name for name, entry in factors.CATALOG.items()}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, sha256, data in zip(*(batch.column(c).to_pylist() for c in ("file", "sha256", "content"))):
                dataset = next((d for archive, d in known.items() if name == archive or name.endswith(f".{archive}")), None)
                rows, problem = [], None
                try:
                    rows = list(factors.scan_block(factors._unzip(data, factors.entry(dataset or name)), factors.entry(dataset or name)))
                except (ProviderResponseError, UnknownDatasetError) as bad:
                    problem = f"{type(bad).__name__}: {bad}"
                rows = rows or [(None, None, None)]
                same = lambda value: pa.array([value] * len(rows), pa.string())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [same(name), same(sha256), same(dataset), *(pa.array(c, pa.string()) for c in zip(*rows)), same(problem)],
                    names=["file", "sha256", "dataset_id", "name", "period_key", "cell", "problem"],
                )

    found = saved(files.select("file", "sha256", "content").mapInArrow(cells, _CELLS))
    require_none(found.where("problem LIKE 'UnknownDataset%'").select("file", "problem"), UnknownDatasetError, "a file of no dataset")
    require_none(found.where("problem IS NOT NULL").select("file", "problem"), ProviderResponseError, "not the provider's archive")
    rows = found.where(F.trim("cell") != "").withColumn("value", F.trim("cell").try_cast("double"))
    require_none(rows.where("value IS NULL").select("file", "name", "period_key", "cell"), ProviderResponseError, "a cell is no number")
    series = F.concat(F.lit(factors.PREFIX), "dataset_id", F.lit("/"), "name").alias("series_id")
    return rows.where(~F.col("value").isin(*factors.MISSING)).select("file", "sha256", "dataset_id", series, "period_key", "value")


def load_archives(
    spark: SparkSession, path: str, availability: Availability | None = None, tz: str | None = None, pinned: DataFrame | None = None
) -> DataFrame:
    """Period-labelled rows of a folder of archives, or observations if an availability and a zone are given."""
    factors.require_both(availability, tz)
    files = archive_files(spark, path)
    if pinned is not None:
        require_pinned(files, pinned)
    rows = decode_archives(files)
    if availability is None:
        return rows
    parts = None
    for frequency in sorted({entry.frequency for entry in factors.CATALOG.values()}):
        names = [d for d, entry in factors.CATALOG.items() if entry.frequency == frequency]
        part = factors.qualify(rows.where(F.col("dataset_id").isin(*names)), frequency, availability, tz)
        parts = part if parts is None else parts.unionByName(part)
    return require_observations(parts)


# Answers of the series service.


def answer_files(spark: SparkSession, path: str) -> DataFrame:
    """``series_id, text`` of the JSON answers below a folder; a file is named after its series."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    return files.select(F.regexp_replace(_file_name(F.col("path")), r"\.json$", "").alias("series_id"), F.decode("content", "UTF-8").alias("text"))


def decode_answers(answers: DataFrame, availability: Availability, tz: str, data_mode: str = macro.CURRENT_SNAPSHOT) -> DataFrame:
    """``series_id, observation_time, available_time, value`` of answers (``series_id, frequency, text``), all in one plan.

    An observation is available at the later of its declared availability and the last instant, in ``tz``, of the day that its answer names as its
    realtime end. Errors of the service, answers for other series, empty ones, values that are no numbers and dates that
    begin no period are rejected, whichever answer has them.
    """
    if data_mode == macro.POINT_IN_TIME:
        raise PseudoVintageError("a current snapshot is no past vintage")
    if availability.mode not in ("SAME_INSTANT", "FIXED_LAG"):
        raise ProviderResponseError("the answers have no availability column")
    require_unique(answers, ["series_id"], ProviderResponseError, "two answers of one series")
    other = answers.where(~F.coalesce(F.col("frequency").isin(*macro.FREQUENCIES), F.lit(False)))
    require_none(other.select("series_id", "frequency"), macro.UnsupportedFrequencyError, f"a frequency is of {macro.FREQUENCIES}")
    read = answers.withColumn("a", F.from_json("text", macro._ANSWER))
    failed = F.col("a.error_code").isNotNull() | F.get_json_object("text", "$.error").isNotNull()
    require_none(read.where(failed).select("series_id", "a.error_message"), UnknownProviderSeriesError, "the service knows no such series")
    end = F.to_date(F.col("a.realtime_end").try_cast("date"))
    tests = {
        "no observations": F.coalesce(F.size("a.observations"), F.lit(0)) < 1,
        "no realtime bounds": F.col("a.realtime_start").isNull() | end.isNull(),
        "an answer for another series": F.coalesce(F.col("a.series_id"), F.col("series_id")) != F.col("series_id"),
    }
    for message, test in tests.items():
        require_none(read.where(test).select("series_id"), ProviderResponseError, message)
    rows = read.select("series_id", "frequency", day_end(F.year(end), F.month(end), F.day(end), tz).alias("_bound"), F.inline("a.observations"))
    rows = rows.where(F.col("value").isNotNull() & (F.col("value") != macro.MISSING))
    instant = F.coalesce(*(F.when(F.col("frequency") == f, macro.period_instant(F.col("date"), f, tz)) for f in macro.FREQUENCIES))
    rows = rows.withColumns({"number": F.col("value").try_cast("double"), "observation_time": instant})
    require_none(rows.where("number IS NULL").select("series_id", "date", "value"), ProviderResponseError, "a value is no number")
    require_none(rows.where("observation_time IS NULL").select("series_id", "date"), ProviderResponseError, "a date that begins no period")
    declared = F.col("observation_time")
    if availability.mode == "FIXED_LAG":
        lag = availability.lag
        declared = declared + F.make_dt_interval(F.lit(lag.days), F.lit(0), F.lit(0), F.lit(lag.seconds).cast("decimal(18,6)"))
    out = rows.select(
        F.concat(F.lit(macro.PREFIX), "series_id").alias("series_id"), "observation_time", F.greatest(declared, F.col("_bound")).alias("available_time"), F.col("number").alias("value")
    )
    return require_observations(out)
