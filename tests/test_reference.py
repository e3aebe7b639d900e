"""Golden rows and rejections."""

import io
import json
import math
import zipfile
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from pyspark.sql import functions as F
from vintara import errors
from vintara.functions import calendar as cal
from vintara.operators import allocate as alloc
from vintara.operators import diagnostics as dia
from vintara.operators import features as trf
from vintara.operators import ledger as led
from vintara.operators import metrics as met
from vintara.operators import pit
from vintara.operators import portfolio as ptf
from vintara.plans import compare, experiment, protocol, results
from vintara.sources import dataset, factors, macro, tables
from vintara.streaming import observations as stream

UTC = timezone.utc


def day(d, month=1, year=2026):
    return datetime(year, month, d, tzinfo=UTC)


def obs(spark, rows):
    return spark.createDataFrame(
        [(s, o, a, float(v), i) for i, (s, o, a, v) in enumerate(rows)],
        "series_id string, observation_time timestamp, available_time timestamp, value double, ord long",
    )


def utc(t):
    return t.replace(tzinfo=UTC) if t is not None else None


# Features.

LATE = [("macro.gdp", day(1), day(1), 1), ("macro.gdp", day(2), day(2), 2), ("macro.gdp", day(3), day(9), 9), ("macro.gdp", day(4), day(4), 4), ("macro.gdp", day(5), day(5), 5)]


def test_rolling_windows_run_in_order_of_availability(spark):
    got = trf.rolling_mean(obs(spark, LATE), 2).orderBy("available_time").collect()
    assert [(utc(r.available_time), r.value) for r in got] == [(day(2), 1.5), (day(4), 3.0), (day(5), 4.5), (day(9), 7.0)]
    assert {r.series_id for r in got} == {"macro.gdp|rolling_mean[2]"} and all(r.observation_time == r.available_time for r in got)
    spread = trf.rolling_volatility(obs(spark, LATE), 2).orderBy("available_time").collect()
    assert [r.value for r in spread] == [np.std(p) for p in ((1, 2), (2, 4), (4, 5), (5, 9))]
    with pytest.raises(errors.InsufficientWindowError):
        trf.require_rows(obs(spark, LATE), 6)
    with pytest.raises(errors.WindowDeclarationError):
        trf.rolling_mean(obs(spark, LATE), 0)


def test_lag_moves_time_and_not_rows(spark):
    (row,) = trf.lag(obs(spark, LATE[2:3]), 2, timedelta(days=1)).collect()
    assert (utc(row.observation_time), utc(row.available_time), row.value) == (day(5), day(9), 9.0)


def test_carry_forward_takes_the_latest_publication(spark):
    rows = [("s", day(1), day(1), 1), ("s", day(5), day(5), 5), ("s", day(1), day(6), 1.5)]
    at = spark.createDataFrame([(day(5),), (day(7),), (day(30),)], "decision_time timestamp")
    for few in (True, False):
        got = trf.carry_forward(obs(spark, rows), at, timedelta(days=2), few=few).orderBy("available_time").collect()
        assert [(utc(r.available_time), r.value) for r in got] == [(day(5), 5.0), (day(7), 1.5)]


def test_scalers_reject_no_spread(spark):
    flat = obs(spark, [("s", day(d), day(d), 3) for d in (1, 2)])
    for scale in (trf.standard_scale, trf.minmax_scale):
        with pytest.raises(errors.InsufficientWindowError):
            scale(flat, flat)


# Point in time.


def test_visible_takes_the_newest_period(spark):
    rows = [("s", day(1), day(1), 1), ("s", day(5), day(5), 5), ("s", day(1), day(6), 1.5), ("t", day(1), day(20), 7)]
    at = spark.createDataFrame([(day(1),), (day(7),)], "decision_time timestamp")
    series = spark.createDataFrame([("s",), ("t",), ("u",)], "series_id string")
    for few in (True, False):
        got = {(utc(r.decision_time), r.series_id): r.value for r in pit.visible_at(obs(spark, rows), at, series, few).collect()}
        assert got == {(d, s): None for d in (day(1), day(7)) for s in "stu"} | {(day(1), "s"): 1.0, (day(7), "s"): 5.0}
    with pytest.raises(errors.UnknownSeriesError):
        pit.require_known_series(obs(spark, rows), series)


def test_membership_digest_covers_the_whole_information_set(spark, sf_dir):
    import hashlib

    from vintara.plans import backtest_queries, views

    def micros(t):
        return (utc(t) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)

    def digest(members):
        level = sorted((d, d) for d in (hashlib.sha256(json.dumps([s, str(o), str(a)], separators=(",", ":")).encode()).hexdigest() for s, o, a in members))
        for digits in results.MEMBER_LEVELS:
            groups = {}
            for at, d in sorted(level):
                groups.setdefault(at[:digits], []).append(d)
            level = [(at, hashlib.sha256(",".join(ds).encode()).hexdigest()) for at, ds in groups.items()]
        return len(members), level[0][1]

    kept = [(r.series_id, micros(r.observation_time), micros(r.available_time)) for r in views.obs(spark, sf_dir).collect()]
    expected = {}
    for r in views.grid(spark).collect():
        latest = {}
        for s, o, a in kept:
            if a <= micros(r.decision_time):
                latest[s, o] = max(a, latest.get((s, o), a))
        if latest:
            expected[micros(r.decision_time)] = digest([(s, o, a) for (s, o), a in latest.items()])
    found = backtest_queries.res_membership_digest(spark, sf_dir).collect()
    assert {micros(r.decision_time): (r.n_members, r.digest) for r in found} == expected


def test_observations_that_are_rejected(spark):
    with pytest.raises(errors.AmbiguousObservationError):
        pit.require_observations(obs(spark, [("s", day(1), day(2), 1), ("s", day(1), day(2), 1)]))
    with pytest.raises(errors.InvalidChronologyError):
        pit.require_observations(obs(spark, [("s", day(2), day(1), 1)]))
    late = obs(spark, [("s", day(1), day(3), 1)]).withColumn("decision_time", F.lit(day(2)))
    with pytest.raises(errors.FutureInformationError):
        pit.require_information_set(late)
    revised = obs(spark, [("s", day(1), day(1), 1), ("s", day(1), day(2), 2)]).withColumn("decision_time", F.lit(day(3)))
    with pytest.raises(errors.AmbiguousObservationError):
        pit.require_information_set(revised)
    with pytest.raises(errors.FeatureLineageError):
        pit.require_lineage(obs(spark, [("s", day(1), day(1), 1)]), obs(spark, [("s", day(1), day(2), 1)]))
    (vintage,) = pit.require_information_set(
        pit.vintage_as_of(revised.drop("decision_time"), spark.createDataFrame([(day(3),)], "decision_time timestamp"))
    ).collect()
    assert vintage.value == 2.0


def test_leakage_battery(spark):
    cases = {
        "late": (lambda: pit.require_available(obs(spark, LATE).withColumn("decision_time", F.lit(day(3)))), errors.FutureInformationError),
        "naive": (lambda: cal.require_instant(datetime(2026, 1, 1), "t"), errors.NaiveTimestampError),
        "lawful": (lambda: None, errors.FutureInformationError),
    }
    assert [f.blocked for f in experiment.run_leakage_cases(cases)] == [True, True, False]


# Calendar.


def test_calendar(spark):
    def one(column):
        return utc(spark.range(1).select(column.alias("x")).first().x)

    assert one(cal.month_end(F.lit(2024), F.lit(2), "Australia/Melbourne")) == datetime(2024, 2, 29, 12, 59, 59, 999999, UTC)
    assert one(cal.quarter_end(F.lit(2024), F.lit(1))) == datetime(2024, 3, 31, 23, 59, 59, 999999, UTC)
    assert one(cal.shift_months(F.lit(datetime(2024, 3, 31, tzinfo=UTC)), -1)) == datetime(2024, 2, 29, tzinfo=UTC)
    assert one(cal.to_instant(F.lit("2024-01-31T23:59:59+01:00"))) == datetime(2024, 1, 31, 22, 59, 59, tzinfo=UTC)
    assert one(cal.to_instant(F.lit("2024-01-31T23:59:59"))) is None
    refits = cal.month_end_refits(spark, day(1), day(30, 12), 3, "evaluation").orderBy("cutoff").collect()
    assert [utc(r.cutoff).month for r in refits] == [1, 4, 7, 10]
    quarters = cal.quarter_end_refits(spark, day(1), day(31, 12), 1, "evaluation").collect()
    assert sorted(utc(r.cutoff).month for r in quarters) == [3, 6, 9]
    assert cal.evaluation_span("2024-01-01..2024-01-31")[1] == datetime(2024, 1, 31, 23, 59, 59, 999999, UTC)
    with pytest.raises(errors.ProtocolStructureError):
        cal.evaluation_span("2024-02-01..2024-01-31")
    grid = cal.month_end_schedule(spark, 2024, 1, 3)
    cal.require_increasing(grid)
    with pytest.raises(errors.GridDeclarationError):
        cal.require_increasing(grid.withColumn("ord", -F.col("ord")))
    assert cal.horizon_seconds("2 days, 1:00:01") == 2 * 86400 + 3601
    for bad in ("-1 days, 1:00:00", "0:00:00", "1:99:00", "24:00:00"):
        with pytest.raises(errors.GridDeclarationError):
            cal.horizon_seconds(bad)
    with pytest.raises(errors.ProtocolStructureError):
        cal.quarter_end_refits(spark, day(1), day(1, 6), 0, "x")


# Diagnostics.


def test_quantiles_and_ties(spark):
    for values, want in (((2, 4, 9, 16), (3.5, 6.5, 10.75)), ((5, 5, 7, 9, 9), (5, 7, 9))):
        row = dia.describe(obs(spark, [("FF/s", day(i + 1), day(i + 1), v) for i, v in enumerate(values)])).first()
        assert (row.q25, row.median, row.q75) == want and row.series_id == "s"
    one = dia.describe(obs(spark, [("s", day(1), day(1), 1)])).first()
    assert one["std"] is None and one.undefined == ["insufficient_n"]
    a = [("a", day(d), day(d), v) for d, v in ((1, 1), (2, 2), (3, 2), (4, 4))]
    b = [("b", day(d), day(d), v) for d, v in ((1, 10), (2, 30), (3, 20), (4, 40))]
    c = [("c", day(d), day(d), 1) for d in (1, 2, 3, 4)]
    found = {(r.first, r.second): r for r in dia.correlation(obs(spark, a + b + c), method="spearman").collect()}
    assert math.isclose(found["a", "b"].coefficient, np.corrcoef([1, 2.5, 2.5, 4], [1, 3, 2, 4])[0, 1], rel_tol=1e-12)
    assert found["a", "c"].reason == "constant_series" and found["a", "c"].coefficient is None
    few = dia.correlation(obs(spark, a[:2] + b[:2])).collect()
    assert {r.reason for r in few} == {"insufficient_overlap"}
    with pytest.raises(errors.AmbiguousObservationError):
        dia.correlation(obs(spark, a + a))
    spec = dia.plot(obs(spark, a + b), "coverage")
    assert spec.labels == ["a", "b"] and spec.series["n_records"] == [4, 4]


# Ledger and metrics.


def run_ledger(spark, initial, instants, decisions, growth, **options):
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    return led.build_ledger(
        frame([("s", a, w) for a, w in initial.items()], "strategy_id string, asset string, weight double"),
        frame([("s", t) for t in instants], "strategy_id string, instant timestamp"),
        frame(
            [("s", t, a, float(w)) for t, book in decisions.items() for a, w in book.items()],
            "strategy_id string, execution_time timestamp, asset string, weight double",
        ),
        frame([(t, a, float(g)) for t, gs in growth.items() for a, g in gs.items()], "instant timestamp, asset string, g double"),
        **options,
    ).orderBy("period")


def abc(*values):
    return dict(zip("ABC", values))


WORLDS = [
    (
        abc(0.5, 0.25, 0.25),
        [day(1), day(1, 2), day(1, 3), day(1, 4)],
        {day(8): abc(0.5, 0.25, 0.25), day(24): abc(0.25, 0.25, 0.5), day(12, 2): abc(0.125, 0.375, 0.5)},
        {day(1): abc(3, 1, 1), day(8): abc(1, 1.5, 0.5), day(24): abc(3, 1.5, 0.75), day(1, 2): abc(0.5, 1.5, 1.5), day(12, 2): abc(4, 2, 1.5), day(1, 3): abc(2, 2, 2)},
        [(2, 793 / 512, 77 / 512, 5 / 8, 1305 / 512), (1, 15 / 16, 1 / 32, 1 / 8, 40455 / 8192), (1, 1, 0, 0, 40455 / 4096)],
    ),
    (
        abc(0.5, 0.5),
        [day(1), day(1, 2), day(1, 3), day(1, 4)],
        {day(20): abc(0.25, 0.75), day(20, 2): abc(0.75, 0.25), day(1, 3): abc(0.25, 0.75)},
        {day(1): abc(1.5, 0.5), day(20): abc(1, 1), day(1, 2): abc(1.5, 0.5), day(20, 2): abc(0.5, 1.5), day(1, 3): abc(1, 1)},
        [(0, -1 / 8, 1 / 8, 1 / 2, 7 / 8), (-7 / 16, -121 / 256, 1 / 16, 1 / 4, 945 / 2048), (0, -1 / 16, 1 / 16, 1 / 4, 14175 / 32768)],
    ),
    (
        abc(0.5, 0.5),
        [day(1), day(1, 2), day(1, 3)],
        {day(15): abc(0.25, 0.25, 0.5), day(25): abc(0.5, 0.5)},
        {day(1): abc(1.5, 0.5), day(15): abc(2, 2, 2), day(25): abc(1.5, 0.5), day(1, 2): abc(0.5, 1.5)},
        [(1, 17 / 32, 15 / 64, 1, 49 / 32), (-1 / 4, -1 / 4, 0, 0, 147 / 128)],
    ),
]


@pytest.mark.parametrize("world", WORLDS)
def test_ledger_worlds(spark, world):
    initial, instants, decisions, growth, want = world
    rows = run_ledger(spark, initial, instants, decisions, growth, rate=0.25).collect()
    got = [(r.gross_return, r.net_return, r.transaction_cost, r.turnover, r.wealth_close) for r in rows]
    assert np.allclose(got, want, rtol=1e-12, atol=1e-12)
    assert all(math.isclose(a.wealth_close, b.wealth_open) for a, b in zip(rows, rows[1:]))


def test_ledger_rejects(spark):
    initial, instants, decisions, growth, _ = WORLDS[0]
    for bad in (
        dict(initial=abc(0.5, 0.25, 0.2)),
        dict(decisions={day(1, 4): abc(0.5, 0.25, 0.25)}),
        dict(growth={t: g for t, g in growth.items() if t != day(8)}),
        dict(growth=growth | {day(1): abc(0, 0, 0)}),
        dict(rate=9.0),
    ):
        args = dict(initial=initial, instants=instants, decisions=decisions, growth=growth) | bad
        with pytest.raises(errors.ExecutionError):
            run_ledger(spark, **args).collect()


def test_metrics_of_a_cost_path(spark):
    months = [day(1, m) for m in range(1, 6)]
    growth = {t: {"A": 0.995, "B": b} for t, b in zip(months, (1.010, 1.011, 1.012, 1.013))}
    ledger = run_ledger(
        spark, {"A": 0.4, "B": 0.6}, months, {day(1, 2): {"A": 0.5, "B": 0.5}}, growth, rate=0.001, measure="two_sided", initial_wealth=100.0
    )
    want = {
        "net": (0.014586573892535926, 0.04352403483591405, 0.0021080438966844394, 14.954164325275903, 0.04439940096847672),
        "gross": (0.014796810681999784, 0.0441474133219697, 0.0017848434434508613, 18.01133507811479, 0.04504926888625249),
    }
    for basis, values in want.items():
        row = met.core_metrics(ledger, 12, 2.0, 0.001, basis).first()
        got = (row.cumulative_return, row.annualized_mean_return, row.annualized_volatility, row.sharpe_ratio, row.certainty_equivalent_return)
        assert np.allclose(got, values, rtol=1e-9) and row.max_drawdown == 0 and row.metric_status == "ok"


def test_metrics_of_a_single_asset(spark):
    months = [day(1, m) for m in range(1, 5)]
    ledger = run_ledger(spark, {"A": 1.0}, months, {}, {t: {"A": g} for t, g in zip(months, (1.10, 0.50, 1.20))})
    row = met.core_metrics(ledger, 12, 2.0, 0.001).first()
    assert np.allclose(
        (row.cumulative_return, row.annualized_mean_return, row.annualized_volatility, row.sharpe_ratio, row.max_drawdown, row.certainty_equivalent_return),
        (-0.34, -0.8, 1.3114877048604001, -0.6191441955503748, -0.5, -0.9295925129408775),
        rtol=1e-12,
    )
    logs = ledger.groupBy("strategy_id").agg(met.certainty_equivalent(1).alias("x")).first().x
    assert math.isclose(logs, -0.12934123088263882, rel_tol=1e-12)
    rates = spark.createDataFrame([(i, 0.001) for i in range(2)], "period int, risk_free double")
    with pytest.raises(errors.ExecutionError):
        met.core_metrics(ledger, 12, 2.0, rates)


# Books and allocation.


def test_books(spark):
    book = lambda rows: spark.createDataFrame(rows, "b int, asset string, weight double")
    found = ptf.target_violations(book([(1, "A", 0.5), (1, "B", 0.6), (2, "A", 1.2), (2, "B", -0.2), (3, "A", 1.0)]), ["b"])
    assert {r.b: r.broken for r in found.collect()} == {1: ["budget"], 2: ["short"]}
    costs = ptf.trade_costs(book([(1, "A", 1.0)]), book([(1, "B", 1.0)]), ["b"], 0.1, "two_sided").first()
    assert (costs.turnover, costs.q, costs.f_cost) == (2.0, 0.2, 0.8)
    growth = spark.createDataFrame([("A", 1.5), ("B", 0.5)], "asset string, g double")
    drifted = {r.asset: r.weight for r in ptf.drift(book([(1, "A", 0.5), (1, "B", 0.5)]), growth, ["b"], []).collect()}
    assert drifted == {"A": 0.75, "B": 0.25}
    with pytest.raises(errors.ExecutionError):
        ptf.drift(book([(1, "A", 1.0)]), growth, ["b"], [])
    with pytest.raises(errors.ConfigurationError):
        ptf.WeightConstraints(max_gross=0.5)


def panel(spark, **series):
    rows = [(day(1, 6), a, day(i + 1), float(r)) for a, rs in series.items() for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, "decision_time timestamp, asset string, t timestamp, r double")


def weights(df):
    return {r.asset: r.weight for r in df.collect()}


def test_inverse_volatility(spark):
    got = weights(alloc.inverse_volatility(panel(spark, LOW=(0.01, 0.02, 0.01, 0.02), HIGH=(0.08, -0.02, 0.06, -0.04))))
    assert math.isclose(got["LOW"], 0.9106986502214993, rel_tol=1e-12) and math.isclose(got["HIGH"], 0.08930134977850068, rel_tol=1e-11)


def test_minimum_variance(spark):
    a = math.sqrt(3e-4)
    got = weights(alloc.minimum_variance(panel(spark, LOW=(a, -a, a, -a), HIGH=(0.015, 0.015, -0.015, -0.015))))
    assert math.isclose(got["LOW"], 3 / 7, abs_tol=1e-9) and math.isclose(got["HIGH"], 4 / 7, abs_tol=1e-9)
    with pytest.raises(Exception, match="full rank"):
        alloc.minimum_variance(panel(spark, A=(1, 2, 3, 4), B=(2, 4, 6, 8))).collect()


def test_mean_variance(spark):
    low, high = (math.sqrt(6), -math.sqrt(6), 0, 0), (0, 0, math.sqrt(1.5), -math.sqrt(1.5))
    rows = panel(spark, LOW=low, HIGH=high)
    forecasts = spark.createDataFrame([(day(1, 6), "LOW", 1.0), (day(1, 6), "HIGH", 2.0)], "decision_time timestamp, asset string, expected_return double")
    for risk, want in ((2.0, 0.1), (4.0, 0.15)):
        got = weights(alloc.mean_variance(rows, forecasts, risk))
        assert math.isclose(got["LOW"], want, abs_tol=1e-9) and math.isclose(got["HIGH"], 1 - want, abs_tol=1e-9)
    with pytest.raises(errors.ExecutionError):
        alloc.mean_variance(rows, forecasts.limit(1), 2.0)


def test_solver_settles_on_random_programs():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(2, 12))
        q = np.cov(rng.standard_normal((n + 5, n)), rowvar=False)
        c = rng.standard_normal(n) * rng.choice([0, 0.1, 1])
        alloc.require_accepted(q, c, alloc.solve_long_only(q, c))
    with pytest.raises(errors.OptimizationFailureError):
        alloc.require_accepted(np.eye(2), np.zeros(2), np.array([0.9, 0.1]))


# Sources.


def test_tables(spark):
    declared = tables.DeclaredTable("s", "o", tables.Availability.fixed_lag(timedelta(days=1), justification="x"), "v", "u", "daily")
    text = "s,o,v,more\nA,2024-01-01T00:00:00Z,1,z\nA,2024-01-02T00:00:00+00:00,2.5,z\nB,2024-01-01T00:00:00Z,,z\nB,2024-01-03T00:00:00Z,word,z\n"
    rows = {(r.series_id, r.value, r.value_kind) for r in tables.from_csv(spark, text, declared).collect()}
    assert rows == {("A", 1.0, "number"), ("A", 2.5, "number"), ("B", None, "null"), ("B", None, "str")}
    with pytest.raises(errors.NaiveTimestampError):
        tables.from_csv(spark, "s,o,v\nA,2024-01-01T00:00:00,1\n", declared)
    with pytest.raises(errors.AmbiguousObservationError):
        tables.from_csv(spark, "s,o,v\nA,2024-01-01T00:00:00Z,1\nA,2024-01-01T00:00:00Z,1\n", declared)
    explicit = tables.DeclaredTable("s", "o", tables.Availability.explicit_column("a"), "v", "u", "daily")
    with pytest.raises(errors.MissingAvailabilityError):
        tables.from_csv(spark, "s,o,v\nA,2024-01-01T00:00:00Z,1\n", explicit)
    with pytest.raises(errors.InvalidChronologyError):
        tables.from_csv(spark, "s,o,v,a\nA,2024-01-02T00:00:00Z,1,2024-01-01T00:00:00Z\n", explicit)
    # Cells in quotes, and a row shorter than the header.
    quoted = 's,o,v,"more, or less"\n"A ""1""",2024-01-01T00:00:00Z,"x\ny",z\nB,2024-01-01T00:00:00Z\n'
    rows = {(r.series_id, r.value_str, r.value_kind) for r in tables.from_csv(spark, quoted, declared).collect()}
    assert rows == {('A "1"', "x\ny", "str"), ("B", None, "null")}


def test_storage_on_a_cluster_needs_a_named_folder():
    from vintara import storage

    assert [m for m in ("local", "local[4]", "local[*]", "local-cluster[2,1,1024]", "yarn", "spark://h:7077") if storage.runs_in_one_process(m)] == ["local", "local[4]", "local[*]"]


def test_running_totals_in_buckets(spark):
    from vintara.operators.buckets import running

    rng = np.random.default_rng(3)
    rows = [("hot" if rng.random() < 0.7 else "x", int(rng.integers(0, 40)), float(rng.integers(0, 9))) for _ in range(400)] + [(None, 1, None)]
    frame = spark.createDataFrame(rows, "g string, k int, v double")
    got = running(frame, ["g"], ["k"], {"total": ("sum", F.col("v")), "top": ("max", F.col("v")), "n": ("count", F.col("v"))}, rows=30).collect()
    want = []
    for g, k, v in rows:
        upto = [w for h, q, w in rows if h == g and q <= k and w is not None]
        want.append((g, k, v, sum(upto) if upto else None, max(upto, default=None), len(upto)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_windows_across_buckets(spark, monkeypatch):
    from vintara.operators import buckets

    rng = np.random.default_rng(5)
    start = day(1)
    rows = [("hot" if i % 5 else f"s{i % 3}", start + timedelta(minutes=int(rng.integers(0, 300))), None, int(rng.integers(0, 50))) for i in range(400)]
    frame = obs(spark, [(s, t, t + timedelta(minutes=v), v) for s, t, _, v in rows])
    decisions = spark.createDataFrame([(start + timedelta(minutes=7 * i),) for i in range(60)], "decision_time timestamp")
    instants = spark.createDataFrame([(start + timedelta(minutes=3 * i),) for i in range(90)], "instant timestamp")
    anchors = spark.createDataFrame([(start + timedelta(minutes=4 * i - 30),) for i in range(90)], "cutoff timestamp")

    def results():
        mean = trf.rolling_mean(frame, 4).groupBy("series_id", "available_time").agg(F.round(F.sum("value"), 9), F.count(F.lit(1)))
        return [sorted(map(str, df.collect())) for df in (mean, pit.as_of(frame, decisions, few=False), trf.window_start(instants, anchors, 12))]

    whole = results()
    assert whole[1] == sorted(map(str, pit.as_of(frame, decisions, few=True).collect()))
    times = [start + timedelta(minutes=3 * i) for i in range(90)]
    want = [(a, [t for t in times if t <= a][-12]) for a in (start + timedelta(minutes=4 * i - 30) for i in range(90)) if sum(t <= a for t in times) >= 12]
    assert sorted((utc(r.cutoff), utc(r.window_start)) for r in trf.window_start(instants, anchors, 12).collect()) == want
    monkeypatch.setattr(buckets, "BUCKET_ROWS", 37)
    monkeypatch.setattr(trf, "BUCKET_ROWS", 37)
    assert results() == whole


def test_series_of_one_local_id_are_rejected(spark):
    rows = [(f"{p}/a", day(d), day(d), d) for p in "xy" for d in (1, 2, 3, 4)]
    for report in (dia.describe, dia.correlation, dia.series_table):
        with pytest.raises(errors.AmbiguousObservationError):
            report(obs(spark, rows))


def test_comparisons_carry_every_declaration(spark):
    measured = spark.createDataFrame([(s, *([float(i)] * 6)) for i, s in enumerate("abc")], ", ".join(["strategy_id string", *(f"{m} double" for m in met.METRICS)]))
    under = lambda gamma, path="main": compare.observations(measured, basis="net", periods_per_year=12, gamma=gamma, risk_free=0.0, path=path)
    records = under(1.0).where("strategy_id = 'a'").unionByName(under(2.0).where("strategy_id = 'a'")).unionByName(under(1.0, "other").where("strategy_id = 'b'"))
    spec = compare.ComparisonSpec({"a": "target", "b": "comparator", "z": "benchmark"}, ("sharpe_ratio",), {"z": "a market"})
    table = compare.ComparisonTable.of(spec, records)
    (_, verdict, some), = table.rows
    assert verdict == "missing_values" and [c.status for c in some] == ["ok", "missing_path", "missing_record"]
    assert some[0].observations == (("net", 12, 1.0, 0.0, 0.0), ("net", 12, 2.0, 0.0, 0.0))
    assert compare.ComparisonTable.from_json(table.to_json()) == table and "z (benchmark, a market)" in table.render()
    alone = compare.ComparisonTable.of(compare.ComparisonSpec({"a": "target"}, ("sharpe_ratio",)), records)
    assert alone.rows[0][1] == "multiple_declaration_sets"
    with pytest.raises(errors.ComparisonError):
        compare.cells(spark.createDataFrame([("a",)], "strategy_id string"), ["sharpe_ratio"], records.withColumn("value", F.lit(float("inf"))))


def test_compensated_sums(spark):
    rows = [[0.1] * 10, [1e16, 1.0, -1e16], [1 / 3, 1 / 3, 1 / 3], []]
    frame = spark.createDataFrame([(r,) for r in rows], "v array<double>")
    assert [r[0] for r in frame.select(led.compensated_sum(F.col("v"))).collect()] == [1.0, 1.0, 1.0, 0.0]
    instants = spark.createDataFrame([("s", day(1)), ("s", day(2))], "strategy_id string, instant timestamp")
    grown = spark.createDataFrame([(day(1), "A", 1.0), (day(1), "B", 1.0)], "instant timestamp, asset string, g double")
    none = spark.createDataFrame([], "strategy_id string, execution_time timestamp, asset string, weight double")
    for off, raises in ((0.0, False), (1e-12, True)):
        book = spark.createDataFrame([("s", "A", 0.5), ("s", "B", 0.5 + off)], "strategy_id string, asset string, weight double")
        assert led.build_ledger(book, instants, none, grown).count() == 1
        if raises:
            with pytest.raises(errors.ExecutionError):
                led.build_ledger(book, instants, none, grown, strict_budget=True)


def test_a_long_ledger_is_linear(spark):
    n = 100_000
    at = F.timestamp_micros(F.col("id") * 60_000_000)
    instants = spark.range(n + 1).select(F.lit("s").alias("strategy_id"), at.alias("instant"))
    growth = spark.range(n).select(at.alias("instant"), F.lit("A").alias("asset"), F.lit(1.0).alias("g"))
    growth = growth.unionByName(growth.withColumn("asset", F.lit("B")))
    initial = spark.createDataFrame([("s", "A", 0.5), ("s", "B", 0.5)], "strategy_id string, asset string, weight double")
    every = spark.range(1, n, 7).select(F.lit("s").alias("strategy_id"), at.alias("execution_time"))
    decisions = every.withColumns({"asset": F.lit("A"), "weight": F.lit(0.5)}).unionByName(every.withColumns({"asset": F.lit("B"), "weight": F.lit(0.5)}))
    found = led.build_ledger(initial, instants, decisions, growth, 0.001)
    assert found.count() == n and found.where("gross_return <> 0 OR turnover <> 0").count() == 0


def archive(member, text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(member, text)
    return out.getvalue()


def test_factor_files(spark):
    lines = "made up\n\n,Mkt-RF,SMB,RF\n202401, 1.5,-99.99,0.1\n202402,-999,2.5,0.1\n\n Annual\n,Mkt-RF,SMB,RF\n2024,9,9,9\n"
    file = factors.CATALOG["factors_monthly_csv"]
    data = archive(file.member, lines)
    got = {(r.series_id.split("/")[-1], r.period_key, r.value) for r in factors.load(spark, "factors", data=data).collect()}
    assert got == {("Mkt-RF", "202401", 1.5), ("RF", "202401", 0.1), ("SMB", "202402", 2.5), ("RF", "202402", 0.1)}
    rows, source = factors.decode(spark, data, "factors_monthly_csv", tables.Availability.same_instant(), "UTC")
    assert utc(rows.agg(F.max("observation_time")).first()[0]) == datetime(2024, 2, 29, 23, 59, 59, 999999, UTC)
    text = archive(factors.CATALOG["factors_monthly_txt"].member, "x\n\n  Mkt-RF  SMB  RF\n202401  1.5 -99.99 0.1\n202402 -999 2.5 0.1\n")
    assert factors.decode_unqualified(spark, text, "factors_monthly_txt").count() == 4
    with pytest.raises(errors.UnknownDatasetError):
        factors.require_candidate_returns(source)
    with pytest.raises(errors.UnknownDatasetError):
        factors.resolve("nothing")
    with pytest.raises(errors.ProviderResponseError):
        factors.decode(spark, data, "factors_monthly_csv", tables.Availability.same_instant(), "UTC", sha256="0" * 64)
    whole = dataset.Dataset(
        factors.decode_unqualified(spark, data, "factors_monthly_csv"), source,
        lambda policy, tz: factors.decode(spark, data, "factors_monthly_csv", policy, tz)[0],
    )
    with pytest.raises(errors.UnqualifiedDataError):
        whole.to_information_set(day(1))
    qualified = whole.qualify(tables.Availability.same_instant(), "UTC")
    assert qualified.to_information_set(day(1)).count() == 4 and qualified.same_as(qualified) and len(whole.to_pandas()) == 4


def test_macro_series(spark):
    data = json.dumps(
        {"series_id": "X", "realtime_start": "2026-09-12", "realtime_end": "2026-09-12",
         "observations": [{"date": f"2024-0{m}-01", "value": v} for m, v in ((1, "1.5"), (2, "."), (4, "2"))]}
    ).encode()
    got = {(r.period_key, r.value) for r in macro.load(spark, "X", frequency="Monthly", data=data).collect()}
    assert got == {("2024-01", 1.5), ("2024-04", 2.0)}
    rows = macro.decode(spark, data, "X", tables.Availability.same_instant(), frequency="Quarterly", tz="UTC", retrieved=day(12, 9))
    got = rows.orderBy("observation_time").collect()
    assert [utc(r.observation_time).month for r in got] == [3, 6] and {utc(r.available_time) for r in got} == {day(12, 9)}
    macro.require_snapshot_recency(rows, day(12, 9))
    # Bytes without a retrieval are known from the end of the day that they name themselves.
    unknown = macro.load(spark, "X", frequency="Monthly", data=data, availability=tables.Availability.same_instant(), tz="UTC").collect()
    assert {utc(r.available_time) for r in unknown} == {datetime(2026, 9, 12, 23, 59, 59, 999999, UTC)}
    for half in ({"availability": tables.Availability.same_instant()}, {"tz": "UTC"}):
        with pytest.raises(errors.MissingAvailabilityError):
            macro.load(spark, "X", frequency="Monthly", data=data, **half)
    with pytest.raises(errors.PseudoVintageError):
        macro.require_snapshot_recency(rows, day(13, 9))
    with pytest.raises(errors.PseudoVintageError):
        macro.decode(spark, data, "X", tables.Availability.same_instant(), frequency="Monthly", tz="UTC", retrieved=day(1), data_mode="POINT_IN_TIME")
    with pytest.raises(errors.UnsupportedFrequencyError):
        macro.decode(spark, data, "X", tables.Availability.same_instant(), frequency="Weekly", tz="UTC", retrieved=day(1))
    with pytest.raises(errors.UnknownProviderSeriesError):
        macro.load(spark, "X", frequency="Monthly", data=b'{"error_code": 400, "error_message": "no"}')
    with pytest.raises(ValueError):
        macro.fetch("X", "short")


# Protocols, experiments, results.


def test_protocols(spark):
    design = protocol.Design("2024-02-01..2024-12-31", estimation=protocol.window(years=1), refit="quarterly")
    found = protocol.resolve_protocols(design, ["a", "b"], {"b": protocol.Override(refit="none")})
    cutoffs = [e.cutoff for e in found["a"].events]
    assert [(c.year, c.month, c.day) for c in cutoffs] == [(2024, 1, 31), (2024, 4, 30), (2024, 7, 31), (2024, 10, 31)]
    assert len(found["b"].events) == 1
    events = protocol.events_frame(spark, found)
    parts = spark.createDataFrame(
        [(s, p.start, p.end) for s, x in found.items() for p in x.partitions], "strategy_id string, start timestamp, end timestamp"
    )
    assert protocol.events_outside(events, parts).count() == 0
    with pytest.raises(errors.ProtocolStructureError):
        protocol.Design("2024-02-01..2024-12-31", refit="monthly", learning="FIXED_ORIGIN")
    with pytest.raises(errors.ProtocolStructureError):
        protocol.window(years=1, months=1)
    with pytest.raises(errors.ProtocolVocabularyError):
        protocol.Design("2024-02-01..2024-12-31", refit="weekly")
    plan = protocol.FittingPlan("mean", {"window": 3}, seed=1, determinism="seeded")
    assert plan.digest != protocol.FittingPlan("mean", {"window": 3.0}, seed=1, determinism="seeded").digest
    fit = protocol.fit_provenance(plan, obs(spark, LATE), day(9))
    assert fit.n_records == 5
    with pytest.raises(errors.FutureInformationError):
        protocol.fit_provenance(plan, obs(spark, LATE), day(5))
    with pytest.raises(errors.ProvenanceStructureError):
        protocol.match_fits(found, {"b": [fit]})
    protocol.require_reproducible(obs(spark, LATE), obs(spark, LATE))
    assert protocol.window(observations=2).start(day(5), [day(1), day(4), day(5), day(6)]) == day(4)


def test_experiment(spark):
    config = experiment.Configuration("inverse", ("equal", "same"), benchmarks=("equal",))
    assert experiment.Configuration.from_canonical_text(config.canonical_text()) == config
    rng = np.random.default_rng(0)
    months = [day(1, m) for m in range(1, 8)]
    rows = [(t, a, day(d), float(x)) for t in months[:6] for a in "AB" for d, x in enumerate(rng.standard_normal(5) / 100, 1)]
    windows = spark.createDataFrame(rows, "decision_time timestamp, asset string, t timestamp, r double")

    def keep(rows, state):
        book = state.get("book")
        if book is None:
            book = rows[["asset"]].drop_duplicates().assign(weight=0.5)
        return book, {"book": book}

    strategies = {
        "inverse": alloc.inverse_volatility,
        "equal": lambda w: alloc.equal_weight(w.select("decision_time", "asset").distinct()),
        "same": lambda w: experiment.run_stateful(w, "same", keep),
    }
    grows = spark.createDataFrame([(t, a, 1.01 if a == "A" else 0.99) for t in months for a in "AB"], "instant timestamp, asset string, g double")
    instants = spark.createDataFrame([(t,) for t in months], "instant timestamp")
    run = experiment.Experiment(config, strategies, rate=0.001, rebalance_every=2)
    ledger, measured = run.run(windows, instants, grows)
    rows = {r.strategy_id: r for r in measured.collect()}
    assert set(rows) == {"inverse", "equal", "same"} and math.isclose(rows["same"].cumulative_return, rows["equal"].cumulative_return)
    assert ledger.where("strategy_id = 'equal' AND turnover > 0").count() == 2
    spec = compare.ComparisonSpec({"inverse": "target", "equal": "benchmark", "gone": "comparator"})
    records = compare.observations(measured, basis="net", periods_per_year=12, gamma=1.0, risk_free=0.0)
    table = compare.ComparisonTable.of(spec, records)
    assert compare.ComparisonTable.from_json(table.to_json()) == table
    assert "missing_record" in table.render() and table.rows[0][1] == "missing_values"
    assert len(results.ledger_digest(ledger, "equal")) == 64
    with pytest.raises(errors.ConfigurationError):
        experiment.Experiment(config, {"inverse": alloc.inverse_volatility})
    with pytest.raises(errors.ConfigurationError):
        experiment.select(config, ["nobody"])


def test_what_a_protocol_requires(spark):
    part = protocol.Partition("development", day(1), day(9))
    made = protocol.Protocol((part,), (protocol.FitEvent("initial_fit", "development", day(5)),), estimation=protocol.window(observations=3))
    seen = obs(spark, [("s", day(d), day(d), d) for d in (1, 2, 3, 7)])
    protocol.require_first_decision(seen, made)
    with pytest.raises(errors.ProtocolStructureError):
        protocol.require_first_decision(seen.where("value <> 2"), made)
    refits = protocol.RefitSchedule((day(2), day(4)))
    assert refits.latest(day(3)) == day(2) and refits.latest(day(1)) is None
    with pytest.raises(errors.ScheduleStructureError):
        protocol.RefitSchedule((day(4), day(2)))
    assert protocol.require_selection_labels(seen, day(7)) is seen
    with pytest.raises(errors.FutureInformationError):
        protocol.require_selection_labels(seen, day(6))
    kinds = "decision_time timestamp, asset string, screening_time timestamp, membership_available_time timestamp"
    schedule = spark.createDataFrame([(day(3), "A", day(2), day(1))], kinds)
    assert experiment.require_schedule(schedule) is schedule
    with pytest.raises(errors.FutureInformationError):
        experiment.require_schedule(schedule.withColumn("screening_time", F.lit(day(4))))
    told = spark.createDataFrame([(day(3), day(2))], "decision_time timestamp, produced_at timestamp")
    assert pit.require_forecasts(told) is told
    with pytest.raises(errors.FutureInformationError):
        pit.require_forecasts(told.withColumn("produced_at", F.lit(day(4))))
    realised = spark.createDataFrame([(day(1), day(1), day(2), day(3)), (day(2), day(1), day(2), day(3))], ["decision_time", "execution_time", "start", "end"])
    assert cal.realization_violations(realised).count() == 1
    declared = tables.DeclaredTable("s", "o", tables.Availability.same_instant(), "v", "u", "daily")
    schema = spark.createDataFrame([], "s string, o timestamp, v double").schema
    assert tables.from_records(spark, [{"s": "A", "o": day(1), "v": 1.0}], declared, schema).count() == 1


def test_fit_events_lie_in_partitions():
    part = protocol.Partition("development", day(1), day(9))
    assert protocol.Protocol((part,), (protocol.FitEvent("initial_fit", "development", day(9)),)).events
    for parts in ((part,), ()):
        with pytest.raises(errors.ProtocolStructureError):
            protocol.Protocol(parts, (protocol.FitEvent("initial_fit", "development", day(10)),))


def test_declared_runs_say_everything(spark):
    from vintara.plans import declared

    config = experiment.Configuration("a", ("b",))
    none = {"a": protocol.Protocol((), ()), "b": protocol.Protocol((), ())}
    ready = declared.Conditions()
    with pytest.raises(TypeError):
        declared.run_declared(config, {}, ready, none, None)
    for protocols, fits in ((none, {"a": ()}), ({"a": none["a"]}, {"a": (), "b": ()}), (none, {"a": (), "b": (protocol.FitProvenance("x", day(1), 1),)})):
        with pytest.raises(errors.ExecutionError):
            declared.run_declared(config, {}, ready, protocols, fits)
    with pytest.raises(errors.ConfigurationError):
        declared.run_declared(config, {}, ready, none, {"a": (), "b": ()})


def test_decision_contexts_and_results(spark):
    from vintara.plans import declared

    universe = spark.createDataFrame([(day(1), "A"), (day(1), "B"), (day(2), "A")], "decision_time timestamp, asset string")
    books = spark.createDataFrame([(day(1), "A", 1.0, "PRE_TRADE")], "decision_time timestamp, asset string, weight double, state string")
    seen = spark.createDataFrame([(day(1), day(1))], "decision_time timestamp, as_of timestamp")
    told = spark.createDataFrame([(day(1), day(1))], "decision_time timestamp, forecast_time timestamp")
    assert declared.require_contexts(universe, books, seen, told) is universe
    for bad, error in (
        (dict(universe=universe.unionByName(universe)), errors.ConfigurationError),
        (dict(universe=universe, holdings=books.withColumn("state", F.lit("TARGET"))), errors.ExecutionError),
        (dict(universe=universe, holdings=books.withColumn("decision_time", F.lit(day(9)))), errors.ExecutionError),
        (dict(universe=universe, information=seen.withColumn("as_of", F.lit(day(2)))), errors.FutureInformationError),
        (dict(universe=universe, forecasts=told.withColumn("forecast_time", F.lit(day(2)))), errors.ExecutionError),
    ):
        with pytest.raises(error):
            declared.require_contexts(**bad)
    results_ = spark.createDataFrame([("s", day(1), day(1)), ("s", day(2), day(3))], "strategy_id string, decision_time timestamp, execution_time timestamp")
    assert declared.require_results(results_, results_) is results_
    for bad in (results_.withColumn("execution_time", F.lit(day(1))), results_.limit(1)):
        with pytest.raises(errors.ExecutionError):
            declared.require_results(bad, results_)
    assert declared.rebalance_violations(results_).count() == 0
    assert declared.rebalance_violations(results_.withColumn("execution_time", F.lit(day(5)))).count() == 1
    assert declared.on_schedule(spark.createDataFrame([(day(1),), (day(7),)], "instant timestamp"), universe).count() == 1
    links = spark.createDataFrame([("s", day(1), "f"), ("s", day(2), "f"), ("t", day(1), "g")], "strategy_id string, decision_time timestamp, fit_id string")
    assert declared.forecast_links(links).count() == 2
    with pytest.raises(errors.ExecutionError):
        declared.forecast_links(links.withColumn("decision_time", F.lit(day(1))))
    mapping = spark.createDataFrame([("x/1", "A"), ("x/2", "B")], "series_id string, asset string")
    rows = spark.createDataFrame([("x/1", 1.0), ("x/3", 2.0)], "series_id string, value double")
    assert [(r.asset, r.value) for r in declared.mapped_assets(rows, mapping).collect()] == [("A", 1.0)]
    with pytest.raises(errors.ConfigurationError):
        declared.mapped_assets(rows, mapping.withColumn("asset", F.lit("A")))
    used = spark.createDataFrame([(day(1), day(2))], "use_time timestamp, available_time timestamp")
    with pytest.raises(errors.FutureInformationError):
        declared.require_factors_available(used)
    values = spark.createDataFrame([("a", "g", "3"), ("b", "g", "3"), ("a", "l", "1"), ("b", "l", "1"), ("a", "own", "1")], "strategy_id string, name string, value string")
    said = spark.createDataFrame([("g", "identical"), ("l", "distinct")], "name string, relation string")
    assert [r["name"] for r in declared.relation_violations(values, said).collect()] == ["l"]


def test_result_records():
    manifest = results.RunManifest("e", "0" * 64, "1", 0, "2026-01-01T00:00:00Z", "test")
    block = results.MetricsBlock({"cumulative_return": 0.1}, "net", 12, 1.0, 0.0)
    path = results.PathResult("d", 3, "a", "b", 1.0, 1.1, [block])
    record = results.ResultRecord(manifest, "s", {"rate": 0.1}, {"rate": 0.1}, [path])
    assert results.ResultRecord.from_json(record.to_json()).to_json() == record.to_json() and record.verdict == "consistent"
    with pytest.raises(errors.ResultStructureError):
        results.ResultRecord(manifest, "s", {"rate": 0.1}, {"rate": 0.2})
    for bad in ('{"a": NaN}', '{"a": 1, "a": 2}', "{"):
        with pytest.raises(errors.ResultStructureError):
            results.strict_json(bad)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    pit_rows = obs(spark, LATE + [("macro.gdp", day(1), day(12), 1.5)]).drop("ord")
    pit_rows.write.parquet(src)
    query = stream.write(stream.current_vintages(stream.read_observations(spark, src)), "vintages", str(tmp_path / "c1"), "complete")
    query.processAllAvailable()
    query.stop()
    got = {(utc(r.observation_time), r.value) for r in spark.table("vintages").collect()}
    assert got == {(day(1), 1.5), (day(2), 2.0), (day(3), 9.0), (day(4), 4.0), (day(5), 5.0)}
    means = stream.windowed_means(stream.read_observations(spark, src), "2 days")
    query = stream.write(means, "means", str(tmp_path / "c2"), "complete")
    query.processAllAvailable()
    query.stop()
    assert sum(r.n for r in spark.table("means").collect()) == 6
