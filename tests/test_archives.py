"""Folders of archives and answers."""

import hashlib
import io
import json
import zipfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from vintara import errors
from vintara.sources import archives, factors, macro, tables

UTC = timezone.utc
SAME = tables.Availability.same_instant()


def zipped(member, text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr(zipfile.ZipInfo(member), text)
    return out.getvalue()


def monthly(k):
    return "about\n\n,Mkt-RF,SMB,RF\n" + "".join(f"2020{m:02},{k + m / 100},-99.99,{-m}\n" for m in range(1, 13)) + "\n annual\n2020,1,2,3\n"


@pytest.fixture
def folder(tmp_path):
    file = factors.CATALOG["factors_monthly_csv"]
    data = {f"v{k}.{file.archive}": zipped(file.member, monthly(k)) for k in range(50)}
    daily = factors.CATALOG["factors_daily_csv"]
    data[daily.archive] = zipped(daily.member, ",Mkt-RF,SMB,RF\n20200102,1,-999,3\n")
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    return tmp_path, data


def test_fifty_archives(spark, folder):
    path, data = folder
    pinned = spark.createDataFrame([(n, hashlib.sha256(d).hexdigest()) for n, d in data.items()], "file string, sha256 string")
    rows = archives.load_archives(spark, f"file://{path}", pinned=pinned).collect()
    assert len(rows) == 50 * 24 + 2  # a missing number is no row
    got = {(r.file, r.series_id, r.period_key): r.value for r in rows}
    name = next(n for n in data if n.startswith("v7."))
    assert got[name, "FF/factors_monthly_csv/Mkt-RF", "202003"] == 7.03 and got[name, "FF/factors_monthly_csv/RF", "202012"] == -12
    assert {r.sha256 for r in rows} == {hashlib.sha256(d).hexdigest() for d in data.values()}
    for wrong in (pinned.limit(3), pinned.withColumn("sha256", F.lit("0" * 64)), pinned.unionByName(pinned.limit(1))):
        with pytest.raises(errors.ProviderResponseError):
            archives.load_archives(spark, f"file://{path}", pinned=wrong)
    with pytest.raises(errors.MissingAvailabilityError):
        archives.load_archives(spark, f"file://{path}", SAME)
    # Fifty copies of one series are fifty times the same identities.
    with pytest.raises(errors.AmbiguousObservationError):
        archives.load_archives(spark, f"file://{path}", SAME, "UTC")


def test_observations_of_archives(spark, tmp_path):
    for dataset, text in (("factors_monthly_csv", monthly(0)), ("factors_daily_csv", ",Mkt-RF,SMB,RF\n20200102,1,-999,3\n")):
        file = factors.CATALOG[dataset]
        (tmp_path / file.archive).write_bytes(zipped(file.member, text))
    rows = archives.load_archives(spark, f"file://{tmp_path}", SAME, "UTC").collect()
    at = {(r.series_id, r.observation_time.replace(tzinfo=UTC)) for r in rows}
    assert len(rows) == 26 and ("FF/factors_daily_csv/RF", datetime(2020, 1, 2, 23, 59, 59, 999999, UTC)) in at
    assert ("FF/factors_monthly_csv/Mkt-RF", datetime(2020, 2, 29, 23, 59, 59, 999999, UTC)) in at


@pytest.mark.parametrize("name, content, error", [
    ("other.zip", zipped("x", "y"), errors.UnknownDatasetError),
    ("F-F_Research_Data_Factors_CSV.zip", b"no zip", errors.ProviderResponseError),
    ("F-F_Research_Data_Factors_CSV.zip", zipped("another.csv", "x"), errors.ProviderResponseError),
    ("F-F_Research_Data_Factors_CSV.zip", zipped("F-F_Research_Data_Factors.csv", "nothing here"), errors.ProviderResponseError),
    ("F-F_Research_Data_Factors_CSV.zip", zipped("F-F_Research_Data_Factors.csv", ",Mkt-RF,SMB,RF\n202001,x,1,2\n"), errors.ProviderResponseError),
])
def test_one_wrong_archive_among_many(spark, folder, name, content, error):
    path, _ = folder
    (path / name).write_bytes(content)
    with pytest.raises(error, match=name):
        archives.load_archives(spark, f"file://{path}")


def answer(values, **more):
    rows = [{"date": d, "realtime_start": "2026-01-01", "realtime_end": "2026-01-01", "value": v} for d, v in values]
    return {"realtime_start": "2026-01-01", "realtime_end": "2026-01-01", "observations": rows} | more


GOOD = {"M": ("Monthly", answer([("2024-01-01", "1.5"), ("2024-02-01", "."), ("2024-03-01", "2")])), "Q": ("Quarterly", answer([("2024-04-01", "7")])), "D": ("Daily", answer([("2026-07-08", "3")], series_id="D"))}


def answers_of(spark, given):
    return spark.createDataFrame([(s, f, json.dumps(a) if isinstance(a, dict) else a) for s, (f, a) in given.items()], "series_id string, frequency string, text string")


def test_answers_agree_with_one_at_a_time(spark, tmp_path):
    got = archives.decode_answers(answers_of(spark, GOOD), SAME, "America/New_York").collect()
    want = []
    for series, (frequency, payload) in GOOD.items():
        data = json.dumps(payload).encode()
        (tmp_path / f"{series}.json").write_bytes(data)
        want += macro.decode(spark, data, series, SAME, frequency=frequency, tz="America/New_York").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 4
    kinds = spark.createDataFrame([(s, f) for s, (f, _) in GOOD.items()], "series_id string, frequency string")
    read = archives.answer_files(spark, f"file://{tmp_path}").join(kinds, "series_id")
    assert sorted(map(tuple, archives.decode_answers(read, SAME, "America/New_York").collect())) == sorted(map(tuple, got))


@pytest.mark.parametrize("frequency, payload, error", [
    ("Monthly", {"error_code": 400, "error_message": "Bad Request"}, errors.UnknownProviderSeriesError),
    ("Monthly", {"error": {"code": 1}}, errors.UnknownProviderSeriesError),
    ("Monthly", answer([]), errors.ProviderResponseError),
    ("Monthly", "no json", errors.ProviderResponseError),
    ("Monthly", answer([("2024-01-01", "1")], realtime_end="soon"), errors.ProviderResponseError),
    ("Monthly", answer([("2024-01-01", "1")], series_id="Y"), errors.ProviderResponseError),
    ("Monthly", answer([("2024-01-01", "one")]), errors.ProviderResponseError),
    ("Monthly", answer([("2024-01-02", "1")]), errors.ProviderResponseError),
    ("Quarterly", answer([("2024-02-01", "1")]), errors.ProviderResponseError),
    ("Weekly", answer([("2024-02-01", "1")]), errors.UnsupportedFrequencyError),
    ("Monthly", answer([("2024-01-01", "1"), ("2024-01-01", "1")]), errors.AmbiguousObservationError),
])
def test_one_wrong_answer_among_many(spark, frequency, payload, error):
    with pytest.raises(error):
        archives.decode_answers(answers_of(spark, GOOD | {"X": (frequency, payload)}), SAME, "UTC")
    with pytest.raises(errors.PseudoVintageError):
        archives.decode_answers(answers_of(spark, GOOD), SAME, "UTC", data_mode=macro.POINT_IN_TIME)
