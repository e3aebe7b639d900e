"""Strategies that see their book, fits on events, joins on time, running totals over buckets."""

import sys
import time
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from vintara import errors
from vintara.operators import allocate, buckets, fitting, ledger, metrics, pit
from vintara.plans import holdings

# Strategies of this module go to the workers as they are; the module isn't there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
UTC = timezone.utc
START = datetime(2020, 1, 1, tzinfo=UTC)


def day(n):
    return START + timedelta(days=n)


@pytest.fixture
def few_rows(monkeypatch):
    """Buckets so small that small tables fill many."""
    monkeypatch.setattr(buckets, "BUCKET_ROWS", 40)


# Strategies that see their book.


def world(spark, n, assets=("A", "B"), seed=0):
    rng = np.random.default_rng(seed)
    growth = rng.uniform(0.9, 1.1, (n, len(assets))).tolist()
    rows = [(day(i), a, growth[i][k]) for i in range(n) for k, a in enumerate(assets)]
    outcomes = spark.createDataFrame(rows, "decision_time timestamp, asset string, g double")
    weights = spark.createDataFrame([(a, 1 / len(assets)) for a in assets], "asset string, weight double")
    return outcomes.select("decision_time", "asset"), outcomes, holdings.Opening(weights, 100.0, day(-100)), growth


def band(context):
    far = max(abs(w - 0.5) for w in context.book.values()) > 0.05
    trades = (context.state or 0) + 1
    return holdings.Decision({a: 0.5 for a in context.universe}, trades) if far else None


def test_a_book_drifts_between_trades(spark):
    universe, outcomes, opening, growth = world(spark, 60)
    decided, paths, measured = holdings.HoldingRun({"band": band, "never": lambda c: None}, rate=0.01).run(universe, outcomes, opening)
    rows = {(r.strategy_id, r.decision_time.replace(tzinfo=UTC), r.asset): r for r in decided.collect()}
    wealth, book, traded = 100.0, [0.5, 0.5], 0
    closes = []
    for i, g in enumerate(growth):
        got = [rows["band", day(i), a] for a in "AB"]
        assert [r.pre for r in got] == pytest.approx(book)
        cost = 0.0
        if max(abs(w - 0.5) for w in book) > 0.05:
            assert all(r.traded and r.target == 0.5 for r in got)
            cost, book, traded = 0.01 * 0.5 * sum(abs(w - 0.5) for w in book), [0.5, 0.5], traded + 1
        else:
            assert not any(r.traded for r in got) and all(r.target is None for r in got)
        values = [w * x for w, x in zip(book, g)]
        wealth, book = wealth * sum(values) * (1 - cost), [v / sum(values) for v in values]
        closes.append(wealth)
    assert traded > 2
    got = [r.wealth_close for r in paths.where("strategy_id = 'band'").orderBy("period").collect()]
    assert got == pytest.approx(closes[:-1])  # the last date closes the path
    assert measured.count() == 2


def test_a_hundred_thousand_decisions(spark):
    n = 100_000
    rows = spark.range(n).select(F.timestamp_seconds(F.col("id") * 3600).alias("decision_time"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("asset"))
    outcomes = rows.withColumn("g", F.when(F.col("asset") == "A", 1.001).otherwise(0.999))
    weights = spark.createDataFrame([("A", 0.5), ("B", 0.5)], "asset string, weight double")
    began = time.time()
    decided = holdings.HoldingRun({"band": band}).decide(rows, outcomes, holdings.Opening(weights))
    assert decided.count() == 2 * n and 0 < decided.where("traded").count() < n
    assert time.time() - began < 120


def test_state_policy_and_features(spark):
    universe, outcomes, opening, _ = world(spark, 20)
    features = outcomes.select("decision_time", "asset", (F.col("g") * 0 + 7).alias("signal"))
    seen = holdings.HoldingRun({"count": counting}, policy=holdings.every(3)).decide(universe, outcomes, opening, [features])
    traded = [r.decision_time.replace(tzinfo=UTC) for r in seen.where("traded AND asset = 'A'").orderBy("decision_time").collect()]
    assert traded == [day(i) for i in range(0, 20, 3)]
    # The state is how often it has decided; it decides the weight.
    assert [r.target for r in seen.where("traded AND asset = 'A'").orderBy("decision_time").collect()] == pytest.approx([1 / (k + 2) for k in range(7)])


def counting(context):
    assert context.rows["signal"] == [7.0, 7.0] and "g" not in context.rows
    k = context.state or 0
    return holdings.Decision({"A": 1 / (k + 2), "B": 1 - 1 / (k + 2)}, k + 1)


def test_what_ends_a_run(spark):
    universe, outcomes, opening, _ = world(spark, 5)

    def run(step=lambda c: None, engine=holdings.exact_fill, universe=universe, outcomes=outcomes, opening=opening):
        return holdings.HoldingRun({"s": step}, engine=engine).decide(universe, outcomes, opening)

    def early(context):
        raise errors.FutureInformationError("peeked")

    with pytest.raises(errors.FutureInformationError, match="peeked"):
        run(early)
    for step in (lambda c: 1 / 0, lambda c: holdings.Decision({"A": 1.0}), lambda c: holdings.Decision({"A": 2.0, "B": -1.0}), lambda c: holdings.Decision({"A": 0.4, "B": 0.4})):
        with pytest.raises(errors.ExecutionError):
            run(step)
    half = lambda c: holdings.Decision({"A": 0.5, "B": 0.5})
    with pytest.raises(errors.ExecutionError, match="exactly"):
        run(half, engine=lambda context, target: {"A": 0.6, "B": 0.4})
    with pytest.raises(errors.ExecutionError, match="outcomes"):
        run(outcomes=outcomes.where(~((F.col("decision_time") == day(2)) & (F.col("asset") == "A"))))
    with pytest.raises(errors.ExecutionError, match="negative"):
        run(outcomes=outcomes.withColumn("g", -F.col("g")))
    for weights in ([("A", 1.0)], [("A", 0.5), ("B", 0.6)], [("A", 0.5), ("B", 0.5), ("C", 0.0)]):
        book = spark.createDataFrame(weights, "asset string, weight double")
        with pytest.raises(errors.ExecutionError, match="opening"):
            run(opening=holdings.Opening(book))
    with pytest.raises(errors.ExecutionError, match="opening"):
        run(opening=holdings.Opening(opening.weights, wealth=0.0))
    with pytest.raises(errors.ExecutionError, match="opening"):
        run(opening=holdings.Opening(opening.weights, last_rebalance=day(3)))
    with pytest.raises(errors.ConfigurationError):
        holdings.HoldingRun({})


# Fits.


def cases(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k, asset in enumerate("AB"):
        x, z = rng.normal(5, 1, n) + k, rng.normal(0, 3, n)
        y = 1e6 + 2 * x - z + rng.normal(0, 0.1, n)
        rows += [(asset, day(int(i // 2)), float(a), float(b), float(c)) for i, a, b, c in zip(range(n), x, z, y)]
    return rows, spark.createDataFrame(rows, "asset string, available_time timestamp, x double, z double, y double")


def test_fits_of_all_events_at_once(spark, few_rows):
    rows, frame = cases(spark)
    spans = [("early", day(1), None), ("all", day(500), None), ("rolling", day(100), day(60)), ("short", day(30), day(29)), ("nothing", day(-5), None)]
    events = spark.createDataFrame(spans, "fit_id string, cutoff timestamp, window_start timestamp")
    got = {(r.fit_id, r.asset): r for r in fitting.fit_least_squares(frame, events, ["x", "z"]).collect()}
    assert not any(fit == "nothing" for fit, _ in got)
    for fit, cutoff, start in spans[:4]:
        for asset in "AB":
            inside = [r for r in rows if r[0] == asset and r[1] <= cutoff and (start is None or r[1] > start)]
            r = got[fit, asset]
            assert r.n == len(inside)
            if len(inside) <= 2:
                assert r.status == "undefined" and r.coefficients is None and r.intercept is None
                continue
            design = np.array([[1.0, x, z] for _, _, x, z, _ in inside])
            beta, *_ = np.linalg.lstsq(design, np.array([y for *_, y in inside]), rcond=None)
            assert [r.intercept, *r.coefficients] == pytest.approx(beta.tolist(), rel=1e-7)
            if len(inside) > 4:
                left = np.array([y for *_, y in inside]) - design @ beta
                assert r.residual_variance == pytest.approx(left @ left / (len(inside) - 3), rel=1e-4)


def test_dependent_regressors_and_nulls_are_undefined(spark):
    _, frame = cases(spark, 40)
    events = spark.createDataFrame([("all", day(500), None)], "fit_id string, cutoff timestamp, window_start timestamp")
    twice = frame.withColumn("z", 2 * F.col("x"))
    assert {r.status for r in fitting.fit_least_squares(twice, events, ["x", "z"]).collect()} == {"undefined"}
    flat = frame.withColumn("x", F.lit(1.0))
    assert {r.status for r in fitting.fit_least_squares(flat, events, ["x"]).collect()} == {"undefined"}
    holes = frame.withColumn("x", F.when(F.col("x") > 5, F.col("x")))
    n = {r.asset: r.n for r in fitting.fit_least_squares(holes, events, ["x"]).collect()}
    assert n == {r.asset: r["count"] for r in frame.where("x > 5").groupBy("asset").count().collect()}
    assert fitting.fit_least_squares(frame.limit(0), events, ["x"]).isEmpty()
    for bad in ([("a", day(1), None), ("a", day(2), None)], [("a", day(1), day(1))], [(None, day(1), None)]):
        wrong = spark.createDataFrame(bad, "fit_id string, cutoff timestamp, window_start timestamp")
        with pytest.raises((errors.ConfigurationError, errors.InvalidChronologyError)):
            fitting.fit_least_squares(frame, wrong, ["x"])


def test_forecasts_know_nothing_later(spark):
    _, frame = cases(spark, 100)
    events = spark.createDataFrame([("f20", day(20), None), ("f40", day(40), day(10))], "fit_id string, cutoff timestamp, window_start timestamp")
    decisions = spark.createDataFrame([(day(10),), (day(20),), (day(30),), (day(45),)], "decision_time timestamp")

    def forecasts(rows):
        features = rows.select("asset", F.col("available_time").alias("observation_time"), "available_time", "x", "z")
        found = fitting.latest_forecasts(fitting.fit_least_squares(rows, events, ["x", "z"]), features, decisions, ["x", "z"])
        return {(r.decision_time.replace(tzinfo=UTC), r.asset): r for r in found.collect()}

    first = forecasts(frame)
    assert {at for at, _ in first} == {day(20), day(30), day(45)} and first[day(30), "A"].fit_id == "f20" and first[day(45), "B"].fit_id == "f40"
    assert all(r.produced_at.replace(tzinfo=UTC) <= at for (at, _), r in first.items())
    spoiled = frame.withColumns({c: F.when(F.col("available_time") > F.lit(day(30)), F.rand(1) * 100).otherwise(F.col(c)) for c in "xzy"})
    other = forecasts(spoiled)
    for at in (day(20), day(30)):
        for asset in "AB":
            assert other[at, asset].expected_return == pytest.approx(first[at, asset].expected_return, rel=1e-9)
    assert other[day(45), "A"].expected_return != pytest.approx(first[day(45), "A"].expected_return)


def test_inputs_of_a_thousand_fits(spark):
    events = spark.range(1000).select(F.concat(F.lit("f"), "id").alias("fit_id"), F.timestamp_seconds(F.col("id") * 86400).alias("cutoff"))
    records = events.select("fit_id", F.explode(F.array(*(F.col("cutoff") - F.expr(f"INTERVAL {h} HOURS") for h in range(3)))).alias("available_time"), F.col("cutoff").alias("asserted_cutoff"))
    assert fitting.fit_input_violations(records, events).isEmpty() and fitting.require_fit_inputs(records, events) is records
    late = records.withColumn("available_time", F.when(F.col("fit_id") == "f7", F.col("available_time") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("available_time")))
    assert [tuple(r) for r in fitting.fit_input_violations(late, events).collect()] == [("f7", "late", 1)]
    with pytest.raises(errors.FutureInformationError):
        fitting.require_fit_inputs(late, events)
    other = records.withColumn("asserted_cutoff", F.when(F.col("fit_id") == "f8", F.lit(None)).otherwise(F.col("asserted_cutoff"))).where("fit_id <> 'f9'")
    more = other.unionByName(other.where("fit_id = 'f1'").withColumn("fit_id", F.lit("g")))
    assert {tuple(r) for r in fitting.fit_input_violations(more, events).collect()} == {("f8", "cutoff", 3), ("f9", "empty", 1), ("g", "unknown", 3)}
    with pytest.raises(errors.ExecutionError):
        fitting.require_fit_inputs(more, events)


# Joins on time.


def vintages(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    rows = {(f"s{rng.integers(3)}", day(int(rng.integers(20))), day(int(rng.integers(20, 90)))): float(rng.normal()) for _ in range(n)}
    return spark.createDataFrame([(*k, v) for k, v in rows.items()], "series_id string, observation_time timestamp, available_time timestamp, value double")


@pytest.mark.parametrize("bucket", [1, 3, 256])
def test_vintages_of_many_decisions(spark, few_rows, monkeypatch, bucket):
    monkeypatch.setattr(pit, "INTERVAL_BUCKET", bucket)
    observations = vintages(spark)
    decisions = spark.createDataFrame([(day(i),) for i in (*range(10, 100, 3), 25, 25)], "decision_time timestamp")
    few = pit.vintage_as_of(observations, decisions, few=True)
    many = pit.vintage_as_of(observations, decisions, few=False)
    assert few.columns == many.columns and few.count() == many.count() and few.exceptAll(many).isEmpty()
    assert pit.vintage_as_of(observations.limit(0), decisions, few=False).isEmpty() and pit.vintage_as_of(observations, decisions.limit(0), few=False).isEmpty()


def test_no_nested_loop_for_many_decisions(spark):
    observations = vintages(spark)
    decisions = spark.range(50_000).select(F.timestamp_seconds(F.col("id") * 60 + int(day(20).timestamp())).alias("decision_time"))
    found = pit.vintage_as_of(observations, decisions)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    latest = found.where(F.col("decision_time") == F.lit(day(30)))
    one = pit.vintage_as_of(observations, spark.createDataFrame([(day(30),)], "decision_time timestamp"))
    assert latest.exceptAll(one).isEmpty() and one.exceptAll(latest).isEmpty()


def test_windows_of_late_publications(spark, few_rows):
    rng = np.random.default_rng(8)
    rows = [(a, day(i), day(i + int(rng.integers(1, 15))), float(i)) for a in "ABC" for i in range(60)]
    returns = spark.createDataFrame(rows, "asset string, t timestamp, available_time timestamp, r double")
    at = [day(i) for i in (0, 3, 20, 41, 80)]
    decisions = spark.createDataFrame([(d,) for d in at], "decision_time timestamp")
    got = allocate.decision_windows(returns, decisions, 6, checked=False)
    want = {(d, a, t) for d in at for a in "ABC" for t in sorted((t for b, t, v, _ in rows if b == a and v <= d), reverse=True)[:6]}
    assert {(r.decision_time.replace(tzinfo=UTC), r.asset, r.t.replace(tzinfo=UTC)) for r in got.collect()} == want
    prompt = returns.withColumn("available_time", F.col("t"))
    asked = spark.createDataFrame([(day(i),) for i in range(10, 60)], "decision_time timestamp")
    assert allocate.published_last(prompt, asked, 6).count() == 50 * 3 * 6  # no more than the windows


# Running totals and long paths.


def test_every_fold_over_buckets(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [("a" if i % 3 else None, i, float(rng.uniform(0.9, 1.1)) if i % 7 else None) for i in range(500)]
    frame = spark.createDataFrame(rows, "k string, i int, v double").repartition(5)
    totals = {f: (f, F.col("v")) for f in ("sum", "product", "max", "min", "count")}
    for inclusive in (True, False):
        monkeypatch.setattr(buckets, "BUCKET_ROWS", 10**6)
        whole = buckets.running(frame, ["k"], ["i"], totals, inclusive=inclusive)
        monkeypatch.setattr(buckets, "BUCKET_ROWS", 30)
        parts = buckets.running(frame, ["k"], ["i"], totals, inclusive=inclusive)
        one, other = ({r.i: r for r in x.collect()} for x in (whole, parts))
        assert one.keys() == other.keys() == set(range(500))
        for i in one:
            for name in totals:
                a, b = one[i][name], other[i][name]
                # A count before the first row is 0 in one bucket and null where none was before.
                assert (a or 0) == pytest.approx(b or 0), (i, name)


def test_one_long_path_over_buckets(spark, monkeypatch):
    n = 3000
    rng = np.random.default_rng(6)
    growth = rng.uniform(0.97, 1.03, n)
    factors = spark.createDataFrame([(day(i), a, float(g)) for i, g in enumerate(growth) for a in "A"], "instant timestamp, asset string, g double")
    initial = spark.createDataFrame([("s", "A", 1.0)], "strategy_id string, asset string, weight double")
    instants = spark.createDataFrame([("s", day(i)) for i in range(n)], "strategy_id string, instant timestamp")
    trades = spark.createDataFrame([("s", day(i), "A", 1.0) for i in range(500, n - 1, 500)], "strategy_id string, execution_time timestamp, asset string, weight double")
    monkeypatch.setattr(buckets, "BUCKET_ROWS", 200)
    paths = ledger.build_ledger(initial, instants, trades, factors, initial_wealth=10.0)
    wealth = 10 * np.cumprod(growth[:-1])
    got = [(r.period, r.wealth_open, r.wealth_close) for r in paths.orderBy("period").collect()]
    assert [p for p, _, _ in got] == list(range(n - 1))
    assert [c for _, _, c in got] == pytest.approx(wealth.tolist()) and [o for _, o, _ in got] == pytest.approx([10.0, *wealth[:-1].tolist()])
    peak = np.maximum(10.0, np.maximum.accumulate(wealth))
    assert metrics.max_drawdown(paths).first()["max_drawdown"] == pytest.approx((wealth / peak - 1).min())
    assert metrics.max_drawdown(paths, "gross").first()["max_drawdown"] == pytest.approx((wealth / peak - 1).min())
    realized = {r.execution_time.replace(tzinfo=UTC): r.realized_return for r in ledger.realized_returns(factors, trades).collect()}
    assert realized == {day(i): pytest.approx(np.prod(growth[i : i + 500]) - 1) for i in range(500, n - 501, 500)}


def test_a_cost_that_nobody_knows_is_rejected(spark):
    universe, outcomes, opening, _ = world(spark, 4)
    half = lambda c: holdings.Decision({"A": 0.3, "B": 0.7})
    for costs in (lambda trades: trades.groupBy("strategy_id", "execution_time").agg(F.lit(1.5).alias("q")), lambda trades: trades.selectExpr("strategy_id", "execution_time", "0.0 AS q").limit(0)):
        with pytest.raises(errors.ExecutionError, match="costs"):
            holdings.HoldingRun({"s": half}, costs=costs).run(universe, outcomes, opening)


def test_alignment_of_repeated_requests(spark):
    rows = [("s", day(1), day(2), 1.0), ("s", day(1), day(4), 2.0), ("t", day(1), day(2), 3.0)]
    observations = spark.createDataFrame(rows, "series_id string, observation_time timestamp, available_time timestamp, value double")
    requests = spark.createDataFrame([("s", day(1), n) for n in (5, 1, 7)] + [("t", day(1), 2)], "series_id string, observation_time timestamp, ord long")
    decisions = spark.createDataFrame([(day(3),), (day(5),)], "decision_time timestamp")
    for few in (True, False):
        found = pit.align(observations, decisions, requests.coalesce(1), few)
        assert sorted((r.series_id, r.value, r.ord) for r in found.collect()) == [("s", 1.0, 1), ("s", 2.0, 1), ("t", 3.0, 2), ("t", 3.0, 2)]


def test_few_decisions_see_what_many_do(spark, few_rows):
    observations = vintages(spark).unionByName(vintages(spark, seed=3).withColumn("available_time", F.lit(day(50))))
    decisions = spark.createDataFrame([(day(i),) for i in (*range(10, 100, 7), 50, 50)], "decision_time timestamp")
    for latest in (("observation_time", "available_time"), ("available_time", "observation_time")):
        few, many = (pit.as_of(observations, decisions, latest, few=few) for few in (True, False))
        assert few.count() > 0 and few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()
    # No row is repeated for all decisions that admit it.
    seen = observations.where(F.col("available_time") <= F.lit(day(94)))
    assert pit._admitted(observations, pit._places(decisions.distinct())).count() == seen.count()


def test_decisions_are_no_key_of_a_sorted_join(spark, few_rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = pit.vintage_as_of(vintages(spark), spark.createDataFrame([(day(30),), (day(40),)], "decision_time timestamp"), few=False)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_digests_of_members_that_come_and_go():
    import hashlib

    from vintara.plans import results

    def joined(ds):
        return hashlib.sha256(",".join(ds).encode()).hexdigest()

    rng = np.random.default_rng(5)
    members = []
    for i in range(60):
        first, end = sorted(rng.choice(12, 2, replace=False))
        members.append((f"{i % 7:03x}" + hashlib.sha256(str(i).encode()).hexdigest()[3:], int(first), int(end)))
    members.append((members[0][0][:-1] + "x", 14, 16))  # nobody is there at 12 and 13
    expected = []
    for place in range(16):
        there = sorted(h for h, first, end in members if first <= place < end)
        starts = sorted({h[:3] for h in there})
        if there:
            expected.append((place, len(there), joined(joined(h for h in there if h[:3] == s) for s in starts)))
    assert list(results._digests_over_time(members, 3)) == expected
    assert list(results._digests_over_time([], 3)) == []
