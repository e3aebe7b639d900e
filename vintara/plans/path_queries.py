"""Queries over paths: strategies that see their book, opening books, forecasters fitted on events."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Window
from pyspark.sql import functions as F

from vintara.operators import allocate as alloc
from vintara.operators import fitting as fit
from vintara.plans import holdings, views
from vintara.plans.backtest_queries import _BASE, RATE, _r, _rounded, _windows
from vintara.plans.registry import query
from vintara.plans.views import MONTHS, PANEL
from vintara.storage import saved

#: Deviation from equal weights beyond which the band strategy trades; days between decisions; wealth at the opening.
BAND, DAYS, WEALTH = 0.01, 80, 100.0


def equal(context: holdings.Context) -> holdings.Decision:
    return holdings.Decision({a: 1.0 / len(context.universe) for a in context.universe})


def hold(context: holdings.Context) -> None:
    return None


def within_band(context: holdings.Context) -> holdings.Decision | None:
    """Equal weights again, once any weight has drifted out of the band."""
    aim = 1.0 / len(context.universe)
    far = max(abs(context.book[a] - aim) for a in context.universe) > BAND
    return equal(context) if far else None


def _held(market):
    """Universe and outcomes of every month, and an opening book that isn't of equal weights."""
    universe = market.panel.select(F.col("month").cast("timestamp").alias("decision_time"), "asset")
    outcomes = market.panel.select(F.col("month").cast("timestamp").alias("decision_time"), "asset", "g")
    assets = universe.select("asset").distinct()
    place = F.row_number().over(Window.orderBy("asset"))  # a universe of six
    weights = assets.withColumn("_place", place).select("asset", (F.col("_place") / 21).alias("weight"))
    return universe, outcomes, holdings.Opening(weights, WEALTH, datetime(1990, 1, 1, tzinfo=timezone.utc))


# The book's path, month by month: aim, whether it trades, and what it drifts to.
_WALK = f"""{PANEL}, {MONTHS},
  flow AS (SELECT m.position, m.instant, list(asset ORDER BY asset) AS assets, list(g ORDER BY asset) AS gs,
           lead(m.instant) OVER (ORDER BY m.position) AS period_end
           FROM panel JOIN months m USING (month) GROUP BY m.position, m.instant),
  arms(strategy_id) AS (VALUES {{arms}}),
  walk AS (
    SELECT strategy_id, position, instant, assets, gs, period_end, list_transform(range(1, 7), lambda i: i / 21.0) AS pre, TIMESTAMP '1990-01-01' AS last
    FROM flow CROSS JOIN arms WHERE position = 0
    UNION ALL
    SELECT w.strategy_id, f.position, f.instant, f.assets, f.gs, f.period_end,
           list_transform(list_zip(w.book, w.gs), lambda z: z[1] * z[2] / list_sum(list_transform(list_zip(w.book, w.gs), lambda y: y[1] * y[2]))),
           CASE WHEN w.asked THEN w.instant ELSE w.last END
    FROM (SELECT *, {{asked}} AS asked, CASE WHEN {{trades}} THEN list_transform(pre, lambda x: 1 / 6.0) ELSE pre END AS book FROM walk) w
    JOIN flow f ON f.position = w.position + 1),
  steps AS (SELECT *, {{trades}} AS traded FROM walk)"""
_FAR = f"list_max(list_transform(pre, lambda x: abs(x - 1 / 6.0))) > {BAND}"
_DUE = f"date_diff('day', last, instant) >= {DAYS}"


@query(f"""WITH RECURSIVE {_WALK.format(arms="('band')", asked='TRUE', trades=_FAR)}
    SELECT strategy_id, instant AS decision_time, asset, {_r('weight')} AS pre, {_r('CASE WHEN traded THEN 1 / 6.0 END')} AS target, traded
    FROM (SELECT strategy_id, instant, traded, unnest(assets) AS asset, unnest(pre) AS weight FROM steps)""")
def exp_holdings_band(spark, sf_dir):
    """A strategy that trades only when its drifted book leaves a band."""
    run = holdings.HoldingRun({"band": within_band})
    decided = run.decide(*_held(views.Market(spark, sf_dir)))
    return _rounded(decided, "pre", "target").select("strategy_id", "decision_time", "asset", "pre", "target", "traded")


_ACCOUNTED = f"""{_WALK.format(arms="('equal'), ('hold')", asked=_DUE, trades=f"strategy_id = 'equal' AND {_DUE}")},
  rows AS (SELECT strategy_id, position AS period, instant, period_end,
      CASE WHEN traded THEN 0.5 * list_sum(list_transform(pre, lambda x: abs(x - 1 / 6.0))) ELSE 0.0 END AS turnover,
      list_sum(list_transform(list_zip(CASE WHEN traded THEN list_transform(pre, lambda x: 1 / 6.0) ELSE pre END, gs), lambda z: z[1] * z[2])) AS d
      FROM steps WHERE period_end IS NOT NULL),
  costed AS (SELECT *, {{cost}} AS q FROM rows),
  walked AS (SELECT *, {WEALTH} * product(d * (1 - q)) OVER (PARTITION BY strategy_id ORDER BY period) AS w FROM costed)"""
_LEDGER_ROWS = f"""SELECT strategy_id, CAST(period AS INTEGER) AS period, {_r('d - 1')} AS gross_return, {_r('turnover')} AS turnover, {_r('q')} AS transaction_cost,
    {_r(f'coalesce(lag(w) OVER (PARTITION BY strategy_id ORDER BY period), {WEALTH})', 6)} AS wealth_open, {_r('w', 6)} AS wealth_close FROM walked"""


def _ledger_rows(ledger):
    ledger = _rounded(_rounded(ledger, "gross_return", "turnover", "transaction_cost"), "wealth_open", "wealth_close", places=6)
    return ledger.select("strategy_id", "period", "gross_return", "turnover", "transaction_cost", "wealth_open", "wealth_close")


@query(f"WITH RECURSIVE {_ACCOUNTED.format(cost=f'{RATE} * turnover')} {_LEDGER_ROWS}")
def exp_opening(spark, sf_dir):
    """The ledger of a run that opens with a book and wealth of its own and decides when enough days have passed."""
    run = holdings.HoldingRun({"equal": equal, "hold": hold}, policy=holdings.every(DAYS), rate=RATE)
    _, ledger, _ = run.run(*_held(views.Market(spark, sf_dir)))
    return _ledger_rows(ledger)


def _square_costs(trades):
    """A cost that grows with the square of what is traded of each asset."""
    return trades.groupBy("strategy_id", "execution_time").agg((0.05 * F.sum(F.col("delta") * F.col("delta"))).alias("q"))


@query(f"""WITH RECURSIVE {_ACCOUNTED.format(cost='0.0')}, squares AS (SELECT strategy_id, position AS period,
      CASE WHEN traded THEN 0.05 * list_sum(list_transform(pre, lambda x: (x - 1 / 6.0) * (x - 1 / 6.0))) ELSE 0.0 END AS q FROM steps),
    walked2 AS (SELECT r.* EXCLUDE (q, w), s.q, {WEALTH} * product(d * (1 - s.q)) OVER (PARTITION BY strategy_id ORDER BY period) AS w
      FROM walked r JOIN squares s USING (strategy_id, period)) {_LEDGER_ROWS.replace('walked', 'walked2')}""")
def ptf_cost_model(spark, sf_dir):
    """The same run under a cost model of one's own."""
    run = holdings.HoldingRun({"equal": equal, "hold": hold}, policy=holdings.every(DAYS), costs=_square_costs)
    _, ledger, _ = run.run(*_held(views.Market(spark, sf_dir)))
    return _ledger_rows(ledger)


# Fits: a month's return on the one before; all history, and two years, at each decision.
_FITS = f"""{_BASE}, pairs AS (SELECT asset, month, available_time, r AS y, lag(r) OVER (PARTITION BY asset ORDER BY month) AS x FROM panel),
  events AS (SELECT 'e' || position AS fit_id, decision_time AS cutoff, CAST(NULL AS TIMESTAMP) AS window_start FROM decisions
    UNION ALL SELECT 'r' || position, decision_time, decision_time - INTERVAL 24 MONTH FROM decisions),
  fits AS (SELECT fit_id, cutoff, asset, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept
    FROM events JOIN pairs ON available_time <= cutoff AND (window_start IS NULL OR available_time > window_start)
    WHERE x IS NOT NULL GROUP BY ALL)"""


def _pairs(market):
    before = F.lag("r").over(Window.partitionBy("asset").orderBy("month"))
    return market.panel.select("asset", "month", "month_end", "available_time", F.col("r").alias("y"), before.alias("x"))


def _events(market):
    all_of = market.decisions.select(F.concat(F.lit("e"), "position").alias("fit_id"), F.col("decision_time").alias("cutoff"), F.lit(None).cast("timestamp").alias("window_start"))
    two_years = market.decisions.select(F.concat(F.lit("r"), "position").alias("fit_id"), F.col("decision_time").alias("cutoff"), F.expr("decision_time - INTERVAL 24 MONTHS").alias("window_start"))
    return all_of.unionByName(two_years)


@query(f"WITH {_FITS} SELECT fit_id, asset, n, {_r('slope', 6)} AS slope, {_r('intercept')} AS intercept FROM fits")
def fit_rolling_ols(spark, sf_dir):
    market = views.Market(spark, sf_dir)
    found = fit.fit_least_squares(_pairs(market), _events(market), ["x"])
    found = found.withColumn("slope", F.element_at("coefficients", 1))
    return _rounded(_rounded(found, "slope", places=6), "intercept").select("fit_id", "asset", "n", "slope", "intercept")


_FORECASTS = f"""{_FITS}, forecasts AS (SELECT d.decision_time, f.asset, fit_id, intercept + slope * arg_max(p.r, p.month) AS expected_return,
      greatest(cutoff, max(p.available_time)) AS produced_at
    FROM decisions d JOIN fits f ON f.cutoff = d.decision_time AND f.fit_id LIKE 'e%' JOIN panel p ON p.asset = f.asset AND p.available_time <= d.decision_time
    GROUP BY d.decision_time, f.asset, fit_id, intercept, slope, cutoff)"""


def _model_forecasts(market):
    events = _events(market).where("window_start IS NULL")
    models = saved(fit.fit_least_squares(_pairs(market), events, ["x"]))
    features = market.panel.select("asset", F.col("month_end").alias("observation_time"), "available_time", F.col("r").alias("x"))
    return fit.latest_forecasts(models, features, market.decisions, ["x"])


@query(f"WITH {_FORECASTS} SELECT decision_time, asset, fit_id, produced_at, {_r('expected_return')} AS expected_return FROM forecasts")
def fit_forecasts(spark, sf_dir):
    return _rounded(_model_forecasts(views.Market(spark, sf_dir)), "expected_return")


@query(f"""WITH {_FORECASTS}, two AS (SELECT * FROM windows WHERE asset IN ('AF', 'NO')),
    s AS (SELECT x.decision_time, var_samp(x.r) AS s11, var_samp(y.r) AS s22, covar_samp(x.r, y.r) AS s12
          FROM two x JOIN two y ON x.decision_time = y.decision_time AND x.month = y.month AND x.asset = 'AF' AND y.asset = 'NO' GROUP BY ALL),
    w AS (SELECT s.decision_time, least(1, greatest(0, (4 * (s22 - s12) + a.expected_return - b.expected_return) / (4 * (s11 + s22 - 2 * s12)))) AS w
          FROM s JOIN forecasts a ON a.decision_time = s.decision_time AND a.asset = 'AF' JOIN forecasts b ON b.decision_time = s.decision_time AND b.asset = 'NO')
    SELECT 'model' AS strategy_id, decision_time, 'AF' AS asset, {_r('w', 6)} AS weight FROM w UNION ALL SELECT 'model', decision_time, 'NO', {_r('1 - w', 6)} FROM w""")
def exp_forecast_mean_variance(spark, sf_dir):
    """Forecasts of the fitted models as what a run's mean-variance strategy expects."""
    from vintara.plans import experiment

    market = views.Market(spark, sf_dir)
    two = F.col("asset").isin("AF", "NO")
    windows = saved(_windows(market).where(two))
    forecasts = saved(_model_forecasts(market).where(two))
    targets = experiment.targets_of(windows, {"model": lambda w: alloc.mean_variance(w, forecasts.select("decision_time", "asset", "expected_return"), 4.0)})
    return _rounded(targets, "weight", places=6)


@query(f"""WITH {_FITS}, given AS (SELECT fit_id, asset, available_time FROM events JOIN pairs ON available_time <= cutoff + INTERVAL 20 DAY WHERE fit_id NOT IN ('e18', 'r21'))
    SELECT fit_id, 'late' AS kind, count(*) AS n FROM given JOIN events USING (fit_id) WHERE available_time > cutoff GROUP BY ALL
    UNION ALL SELECT fit_id, 'empty', 1 FROM events WHERE fit_id IN ('e18', 'r21')""")
def fit_input_violations(spark, sf_dir):
    """Records given to fits of all events, some of them too early: what is wrong with each fit, in one plan."""
    market = views.Market(spark, sf_dir)
    events = saved(_events(market))
    late = F.col("available_time") <= F.col("cutoff") + F.expr("INTERVAL 20 DAYS")
    given = events.join(market.panel, late).where(~F.col("fit_id").isin("e18", "r21")).select("fit_id", "asset", "available_time")
    return fit.fit_input_violations(given, events)


@query(f"""WITH {PANEL}, first AS (SELECT min(month) AS month FROM panel)
    SELECT 'FRED/' || asset AS series_id, month_end AS observation_time, greatest(month_end + INTERVAL 45 DAY, TIMESTAMP '1998-06-30' + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND) AS available_time,
    round(r, 9) + 0.0 AS value FROM panel WHERE NOT (asset = 'AF' AND month = (SELECT month FROM first))""")
def src_answers(spark, sf_dir):
    """The panel as answers of the series service, one JSON text a series, decoded in one plan."""
    from vintara.sources import archives
    from vintara.sources.tables import Availability

    market = views.Market(spark, sf_dir)
    first = market.panel.agg(F.min("month").alias("_first"))
    cell = F.when((F.col("asset") == "AF") & (F.col("month") == F.col("_first")), ".").otherwise(F.col("r").cast("string"))
    rows = market.panel.join(F.broadcast(first), F.lit(True)).select(
        F.col("asset").alias("series_id"), F.struct(F.col("month").cast("date").cast("string").alias("date"), cell.alias("value")).alias("o")
    )
    # A series is one answer, as the service gives it.
    answer = F.struct(F.lit("1998-06-30").alias("realtime_start"), F.lit("1998-06-30").alias("realtime_end"), F.array_sort(F.collect_list("o")).alias("observations"))
    answers = rows.groupBy("series_id").agg(F.to_json(answer).alias("text")).withColumn("frequency", F.lit("Monthly"))
    lag = Availability.fixed_lag(timedelta(days=45), justification="published 45 days after the month")
    return _rounded(archives.decode_answers(answers, lag, "UTC"), "value", places=9)
