"""Records and digests of runs, measures of one's own, covariances by blocks, gates and sources."""

import hashlib
from datetime import datetime, timedelta, timezone
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vintara import errors
from vintara.operators import allocate, features, gram, metrics, portfolio
from vintara.plans import results
from vintara.sources import tables

UTC = timezone.utc
START = datetime(2020, 1, 1, tzinfo=UTC)


def path_of(spark, n=12, names=("a", "b")):
    rng = np.random.default_rng(1)
    rows = []
    for name in names:
        wealth = 1.0
        for k in range(n):
            r = float(rng.uniform(-0.05, 0.06))
            rows.append((name, k, START + timedelta(days=k), START + timedelta(days=k + 1), r, r, 0.0, 0.0, wealth, wealth * (1 + r)))
            wealth *= 1 + r
    schema = "strategy_id string, period int, period_start timestamp, period_end timestamp, gross_return double, net_return double, turnover double, transaction_cost double, wealth_open double, wealth_close double"
    return spark.createDataFrame(rows, schema)


def digests(frame):
    return {r.strategy_id: (r.n_periods, r.digest) for r in results.path_digests(frame).collect()}


def test_digest_of_a_path_depends_on_every_row_and_its_place(spark, monkeypatch):
    ledger = path_of(spark, 40)
    monkeypatch.setattr(results, "DIGEST_PERIODS", 7)
    first = digests(ledger)
    assert first == digests(ledger.repartition(9)) and first["a"][0] == 40 and first["a"] != first["b"]
    changed = ledger.withColumn("turnover", F.when(F.col("period") == 20, 1e-9).otherwise(F.col("turnover")))
    swapped = ledger.withColumn("period", F.when(F.col("period") == 3, 4).when(F.col("period") == 4, 3).otherwise(F.col("period")))
    for other in (changed, swapped, ledger.where("period <> 39"), ledger.where("period <> 14")):
        assert digests(other)["a"][1] != first["a"][1]
    assert results.ledger_digest(ledger, "a") == first["a"][1] and results.ledger_digest(ledger, "none") is None


def test_digest_of_a_million_periods(spark):
    one = spark.range(1_000_000).select(F.lit("s").alias("strategy_id"), F.col("id").cast("int").alias("period"), (F.col("id") / 7).alias("net_return"))
    found = digests(one)
    assert found["s"][0] == 1_000_000 and digests(one.withColumn("net_return", F.when(F.col("period") == 777_777, 0.0).otherwise(F.col("net_return"))))["s"] != found["s"]


def composed(spark, settings=None):
    ledger = path_of(spark)
    measured = metrics.core_metrics(ledger, 12, 2.0)
    manifest = results.RunManifest("e", "0" * 64, "1", 3, "2026-01-01T00:00:00Z", "env \"quoted\"")
    conformance = results.verdicts(spark, {"rate": "0"}, settings or {"rate": "0"}, set())
    return measured, results.run_records(ledger, measured, manifest, conformance, {"gamma": 2.0})


def test_records_round_trip(spark):
    measured, records = composed(spark)
    texts = results.records_to_json(records)
    again = results.records_to_json(results.records_from_json(texts))
    assert sorted(texts.collect()) == sorted(again.collect())
    for row in texts.collect():
        data = results.strict_json(row.text)
        assert data["path"]["n_periods"] == 12 and data["manifest"]["environment"] == 'env "quoted"' and data["declared"] == {"gamma": 2.0}
        assert list(data) == sorted(data) and list(data["metrics"]) == sorted(data["metrics"])
    want = {r.strategy_id: r.sharpe_ratio for r in measured.collect()}
    got = {r.strategy_id: r.v for r in records.select("strategy_id", F.try_variant_get("record", "$.metrics.sharpe_ratio", "double").alias("v")).collect()}
    assert got == pytest.approx(want)


def test_records_are_strict(spark):
    _, records = composed(spark)
    text = results.records_to_json(records).where("strategy_id = 'a'").first().text
    for bad in (text[:-1], text.replace('"path"', '"paht"'), text.replace('"strategy_id":"a"', '"strategy_id":"z"'), text.replace('"n_periods":12', '"n_periods":"many"'), text[:-1] + ',"path":1}', "", None):
        with pytest.raises(errors.ResultStructureError):
            results.records_from_json(spark.createDataFrame([("a", bad)], "strategy_id string, text string"))
    with pytest.raises(errors.ResultStructureError):
        composed(spark, {"rate": "0.1"})


def test_measures_of_ones_own(spark):
    ledger = path_of(spark, 30)
    got = {r.strategy_id: r for r in metrics.evaluate(ledger, {"worst": F.min("net_return"), "last": lambda batches: max(b.column("period")[-1].as_py() for b in batches)}).collect()}
    rows = ledger.collect()
    for name in "ab":
        assert got[name].worst == min(r.net_return for r in rows if r.strategy_id == name) and got[name]["last"] == 29
    with pytest.raises(errors.ExecutionError):
        metrics.evaluate(ledger, {})


def test_covariances_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(START, f"a{k:03}", i, float(rng.normal(1e4, 1))) for k in range(23) for i in range(15) if (k, i) not in ((3, 2), (3, 5), (20, 2))]
    rows += [(START + timedelta(days=1), "solo", 0, 1.0), (START + timedelta(days=1), "null", 0, None)]
    windows = spark.createDataFrame(rows, "decision_time timestamp, asset string, t int, r double")
    want = {(r.decision_time, r.a, r.b): r.covariance for r in allocate.sample_covariance(windows.where("r IS NOT NULL")).collect()}
    for block in (4, 23, 256):
        monkeypatch.setattr(gram, "BLOCK", block)
        got = {(r.decision_time, r.a, r.b): r.covariance for r in gram.block_covariance(windows).collect()}
        assert got.keys() == want.keys()
        for key in want:
            assert (got[key] is None) == (want[key] is None) and (want[key] is None or got[key] == pytest.approx(want[key], rel=1e-6, abs=1e-9)), key
    assert gram.block_covariance(windows.limit(0)).isEmpty()


def test_covariances_of_a_wide_universe(spark):
    frame = spark.range(600 * 100).select(F.lit(START).cast("timestamp").alias("decision_time"), F.format_string("a%04d", F.floor(F.col("id") / 100)).alias("asset"), (F.col("id") % 100).alias("t"), F.sin(F.col("id") * 1.7).alias("r"))
    found = gram.block_covariance(frame)
    assert found.count() == 600 * 601 // 2
    x = np.sin(np.arange(60_000) * 1.7).reshape(600, 100)
    assert found.where("a = 'a0003' AND b = 'a0577'").first().covariance == pytest.approx(np.cov(x[3], x[577])[0, 1])


def test_exact_rank():
    def by_fractions(panel):
        rows = [[Fraction(float(x)) for x in row] for row in panel]
        rows = [[x - sum(c) / len(rows) for x, c in zip(row, zip(*rows))] for row in rows]
        rank = 0
        for column in range(len(rows[0])):
            lead = next((i for i in range(rank, len(rows)) if rows[i][column]), None)
            if lead is not None:
                rows[rank], rows[lead] = rows[lead], rows[rank]
                for i in range(rank + 1, len(rows)):
                    k = rows[i][column] / rows[rank][column]
                    rows[i] = [x - k * y for x, y in zip(rows[i], rows[rank])]
                rank += 1
        return rank

    rng = np.random.default_rng(0)
    for n, p in ((5, 3), (3, 5), (8, 8), (2, 1)):
        panel = rng.normal(size=(n, p))
        assert allocate.exact_rank(panel) == by_fractions(panel) == min(p, n - 1)
    wide = rng.normal(size=(9, 3))
    assert allocate.exact_rank(np.c_[wide, 2 * wide[:, 0], np.full(9, 0.1), np.zeros(9)]) == 3
    assert allocate.exact_rank(np.zeros((4, 2))) == 0


def test_gates_before_a_solve(spark):
    rows = [(START, a, i, float(v)) for a in "xy" for i, v in enumerate(np.random.default_rng(3).normal(size=5))]
    windows = spark.createDataFrame([(d, a, i, v + (a == "y") * i) for d, a, i, v in rows], "decision_time timestamp, asset string, t int, r double")
    for rules in (portfolio.WeightConstraints(allow_short=True), portfolio.WeightConstraints(budget=0.9), portfolio.WeightConstraints(max_gross=1.5), portfolio.WeightConstraints(max_net=1.0)):
        with pytest.raises(errors.ExecutionError, match="long-only"):
            allocate.minimum_variance(windows, rules)
    assert allocate.minimum_variance(windows, checked=True).count() == 2
    for bad in (windows.withColumn("r", F.when(F.col("t") == 2, float("inf")).otherwise(F.col("r"))), windows.withColumn("r", F.when(F.col("t") != 2, F.col("r"))), windows.unionByName(windows.limit(1))):
        with pytest.raises(errors.ExecutionError):
            allocate.minimum_variance(bad, checked=True)


def test_books_and_states(spark):
    rows = [(1, "a", 0.5, "TARGET"), (1, " ", 0.5, "TARGET"), (2, "a", float("nan"), "PRE_TRADE"), (3, "a", 1.0, "HELD"), (4, "a", 0.5, "POST_TRADE"), (4, "a", 0.5, "POST_TRADE"), (5, None, None, None), (6, "a", 1.0, "PRE_TRADE")]
    books = spark.createDataFrame(rows, "book_id int, asset string, weight double, state string")
    broken = {(r.book_id, tuple(r.broken)) for r in portfolio.book_violations(books, ["book_id"]).collect()}
    assert broken == {(1, ("blank_asset",)), (2, ("not_finite",)), (3, ("state",)), (4, ("repeated",)), (5, ("blank_asset", "not_finite", "state"))}
    with pytest.raises(errors.ExecutionError):
        portfolio.require_books(books, ["book_id"])
    growth = spark.createDataFrame([("a", 1.1)], "asset string, g double")
    portfolio.drift(books.where("book_id = 6"), growth, ["book_id"], [])
    with pytest.raises(errors.ExecutionError, match="target"):
        portfolio.drift(books.where("book_id = 6").withColumn("state", F.lit("TARGET")), growth, ["book_id"], [])


def test_pandas_frames_and_digests_of_files(spark, tmp_path):
    frame = pd.DataFrame({"s": ["a", "b"], "at": ["2024-01-01T00:00:00Z", "2024-01-02T00:00:00+02:00"], "v": [1.5, 2.5]}, index=[7, 7])
    declared = tables.DeclaredTable("s", "at", tables.Availability.same_instant(), "v", units="u", frequency="daily")
    got = tables.from_pandas(spark, frame, declared).orderBy("series_id").collect()
    assert [(r.series_id, r.value) for r in got] == [("a", 1.5), ("b", 2.5)] and list(frame.index) == [7, 7]
    with pytest.raises(errors.NaiveTimestampError):
        tables.from_pandas(spark, frame.assign(at="2024-01-01T00:00:00"), declared)
    data = {"one.csv": b"s,at,v\na,2024-01-01T00:00:00Z,1\n", "two.csv": b"s,at,v\n"}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    one = tmp_path / "one.csv"
    found = tables.from_csv(spark, f"file://{one}", declared)
    made = tables.provenance(found, declared, "csv", path=f"file://{one}")
    assert made.sha256 == hashlib.sha256(data["one.csv"]).hexdigest()
    listed = "".join(f"{n}:{hashlib.sha256(c).hexdigest()}\n" for n, c in sorted(data.items()))
    assert tables.source_digest(spark, f"file://{tmp_path}") == hashlib.sha256(listed.encode()).hexdigest()


def test_single_series(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "series_id string, value double")
    assert features.require_single_series(rows.where("series_id = 'a'")).count() == 1
    for bad in (rows, rows.limit(0)):
        with pytest.raises(errors.AmbiguousObservationError):
            features.require_single_series(bad)
