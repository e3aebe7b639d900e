"""Queries over books: portfolio arithmetic, ledger, allocation, metrics, experiments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from vintara.operators import allocate as alloc
from vintara.operators import ledger as led
from vintara.operators import metrics as met
from vintara.operators import portfolio as ptf
from vintara.plans import views
from vintara.plans.registry import query
from vintara.plans.views import DECISIONS, INVERSE_VOL, MONTHS, PANEL, WINDOWS
from vintara.storage import saved, small

RATE = 0.001
STRATEGIES = ("equal_weight", "inverse_vol")
_BASE = f"{PANEL}, {MONTHS}, {DECISIONS}, {WINDOWS}, {INVERSE_VOL}"

# Targets of both strategies at every decision.
_TARGETS = """targets AS (
    SELECT 'inverse_vol' AS strategy_id, decision_time, asset, weight FROM inverse_vol
    UNION ALL SELECT 'equal_weight', decision_time, asset, 1.0 / count(*) OVER (PARTITION BY decision_time) FROM inverse_vol)"""


def _windows(market):
    returns = market.panel.select("asset", F.col("month").alias("t"), "available_time", "r")
    return alloc.decision_windows(returns, market.decisions, views.WINDOW, checked=False)


def _targets(market):
    inverse = alloc.inverse_volatility(_windows(market))
    equal = alloc.equal_weight(inverse.select("decision_time", "asset"))
    named = lambda df, name: df.select(F.lit(name).alias("strategy_id"), "decision_time", "asset", "weight")
    return saved(named(inverse, "inverse_vol").unionByName(named(equal, "equal_weight")))


def _rounded(df, *names, places=8):
    return df.withColumns({n: F.round(n, places) + F.lit(0.0) for n in names})


def _r(x, places=8):
    return f"round({x}, {places}) + 0.0"


# Books of customers: weights are shares of what they spent by priority.
_BOOKS = """spent AS (SELECT o_custkey AS book_id, o_orderpriority AS asset, sum(o_totalprice) AS spent FROM orders GROUP BY ALL),
  books AS (SELECT book_id, asset, spent / sum(spent) OVER (PARTITION BY book_id) AS weight FROM spent)"""


def _books(spark, sf_dir):
    spent = (
        views.table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("book_id"), F.col("o_orderpriority").alias("asset"))
        .agg(F.sum("o_totalprice").alias("spent"))
    )
    return spent.select("book_id", "asset", (F.col("spent") / F.sum("spent").over(Window.partitionBy("book_id"))).alias("weight"))


def _growth(spark):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return spark.createDataFrame([(n, 0.9 + 0.05 * i) for i, n in enumerate(names)], "asset string, g double")


_GROWTH = """growth(asset, g) AS (VALUES ('1-URGENT', 0.9), ('2-HIGH', 0.95), ('3-MEDIUM', 1.0), ('4-NOT SPECIFIED', 1.05), ('5-LOW', 1.1))"""


@query(f"""WITH {_BOOKS} SELECT book_id, {_r('sum(abs(weight))')} AS gross, {_r('sum(weight)')} AS net, count(*) AS n_assets FROM books GROUP BY ALL""")
def ptf_exposure(spark, sf_dir):
    found = ptf.exposures(_books(spark, sf_dir), ["book_id"])
    return _rounded(found, "gross", "net").select("book_id", "gross", "net", "n_assets")


@query(f"""WITH {_BOOKS}, short AS (SELECT book_id, asset, CASE WHEN book_id % 3 = 0 THEN weight - 0.3 ELSE weight END AS weight FROM books)
    SELECT book_id, {_r('sum(weight)')} AS net, count(*) AS n_assets FROM short GROUP BY ALL HAVING abs(sum(weight) - 1) > 1e-9 OR min(weight) < 0""")
def ptf_validate_target(spark, sf_dir):
    short = _books(spark, sf_dir).withColumn("weight", F.when(F.col("book_id") % 3 == 0, F.col("weight") - 0.3).otherwise(F.col("weight")))
    found = ptf.target_violations(short, ["book_id"])
    return _rounded(found, "net").select("book_id", "net", "n_assets")


@query(f"""WITH {_BOOKS}, {_GROWTH} SELECT book_id, asset, {_r('weight * g / sum(weight * g) OVER (PARTITION BY book_id)')} AS weight
    FROM books JOIN growth USING (asset)""")
def ptf_drift(spark, sf_dir):
    found = ptf.drift(_books(spark, sf_dir), _growth(spark), ["book_id"], [])
    return _rounded(found, "weight").select("book_id", "asset", "weight")


_TRADES = f"""{_BOOKS}, pre AS (SELECT book_id, asset, weight FROM books),
    aim AS (SELECT book_id, asset, 1.0 / count(*) OVER (PARTITION BY book_id) AS weight FROM books WHERE asset <> '5-LOW'),
    trades AS (SELECT coalesce(p.book_id, a.book_id) AS book_id, coalesce(p.asset, a.asset) AS asset,
        coalesce(a.weight, 0) - coalesce(p.weight, 0) AS delta
        FROM pre p FULL JOIN aim a ON p.book_id = a.book_id AND p.asset = a.asset)"""


def _trades(spark, sf_dir):
    books = _books(spark, sf_dir)
    n = F.count(F.lit(1)).over(Window.partitionBy("book_id"))
    aim = books.where("asset <> '5-LOW'").withColumn("weight", F.lit(1.0) / n)
    return books, aim


@query(f"WITH {_TRADES} SELECT book_id, asset, {_r('delta')} AS delta FROM trades")
def ptf_trade_delta(spark, sf_dir):
    return _rounded(ptf.trade_deltas(*_trades(spark, sf_dir), ["book_id"]), "delta").select("book_id", "asset", "delta")


@query(f"WITH {_TRADES} SELECT book_id, {_r('0.5 * sum(abs(delta))')} AS turnover FROM trades GROUP BY ALL")
def ptf_turnover_one_way(spark, sf_dir):
    deltas = ptf.trade_deltas(*_trades(spark, sf_dir), ["book_id"])
    return _rounded(ptf.turnover(deltas, ["book_id"], "one_way"), "turnover")


@query(f"WITH {_TRADES} SELECT book_id, {_r('sum(abs(delta))')} AS turnover FROM trades GROUP BY ALL")
def ptf_turnover_two_sided(spark, sf_dir):
    deltas = ptf.trade_deltas(*_trades(spark, sf_dir), ["book_id"])
    return _rounded(ptf.turnover(deltas, ["book_id"], "two_sided"), "turnover")


@query(f"""WITH {_TRADES} SELECT book_id, {_r('0.5 * sum(abs(delta))')} AS turnover, {_r('0.005 * sum(abs(delta))')} AS q,
    {_r('1 - 0.005 * sum(abs(delta))')} AS f_cost FROM trades GROUP BY ALL""")
def ptf_cost(spark, sf_dir):
    found = ptf.trade_costs(*_trades(spark, sf_dir), ["book_id"], 0.01, "one_way")
    return _rounded(found, "turnover", "q", "f_cost")


@query(f"""WITH {_BOOKS}, short AS (SELECT book_id, asset, weight * 0.999 AS weight FROM books), x AS (
    SELECT *, 1 - sum(weight) OVER (PARTITION BY book_id) AS rest, row_number() OVER (PARTITION BY book_id ORDER BY asset) AS k FROM short)
    SELECT book_id, asset, {_r('CASE WHEN k = 1 THEN weight + rest ELSE weight END')} AS weight FROM x""")
def ptf_exact_unit_books(spark, sf_dir):
    short = _books(spark, sf_dir).withColumn("weight", F.col("weight") * 0.999)
    return _rounded(ptf.exact_unit_books(short, ["book_id"]), "weight")


# The ledger of both strategies: the recursion, month by month, as the reference.
_FIRST = "(SELECT min(position) FROM decisions)"
_LEDGER = f"""{_BASE}, {_TARGETS},
  steps AS (SELECT m.position, m.instant, lead(m.instant) OVER (ORDER BY m.position) AS period_end FROM months m WHERE m.position >= {_FIRST}),
  aims AS (SELECT strategy_id, d.position, map(list(asset ORDER BY asset), list(weight ORDER BY asset)) AS aim
           FROM targets t JOIN decisions d USING (decision_time) GROUP BY ALL),
  grows AS (SELECT position, list(asset ORDER BY asset) AS assets, list(g ORDER BY asset) AS gs FROM panel JOIN months USING (month) GROUP BY ALL),
  flow AS (
    SELECT s.strategy_id, p.position, p.instant, p.period_end, g.assets, g.gs,
           CASE WHEN a.aim IS NULL THEN NULL ELSE list_transform(g.assets, lambda x: a.aim[x]) END AS aim
    FROM (SELECT DISTINCT strategy_id FROM targets) s CROSS JOIN steps p JOIN grows g USING (position)
    LEFT JOIN aims a ON a.strategy_id = s.strategy_id AND a.position = p.position
    WHERE p.period_end IS NOT NULL)"""
_PATH = f"""WITH RECURSIVE {_LEDGER},
  path AS (
    SELECT strategy_id, position, instant, period_end, 0.0::DOUBLE AS turnover, list_sum(list_transform(list_zip(aim, gs), lambda z: z[1] * z[2])) AS d,
           list_transform(list_zip(aim, gs), lambda z: z[1] * z[2] / list_sum(list_transform(list_zip(aim, gs), lambda y: y[1] * y[2]))) AS book
    FROM flow WHERE position = {_FIRST}
    UNION ALL
    SELECT f.strategy_id, f.position, f.instant, f.period_end,
           CASE WHEN f.aim IS NULL THEN 0.0 ELSE 0.5 * list_sum(list_transform(list_zip(f.aim, p.book), lambda z: abs(z[1] - z[2]))) END,
           list_sum(list_transform(list_zip(coalesce(f.aim, p.book), f.gs), lambda z: z[1] * z[2])),
           list_transform(list_zip(coalesce(f.aim, p.book), f.gs),
             lambda z: z[1] * z[2] / list_sum(list_transform(list_zip(coalesce(f.aim, p.book), f.gs), lambda y: y[1] * y[2])))
    FROM path p JOIN flow f ON f.strategy_id = p.strategy_id AND f.position = p.position + 1),
  ledger AS (
    SELECT strategy_id, CAST(position - {_FIRST} AS INTEGER) AS period, instant AS period_start, period_end, turnover, d - 1 AS gross_return,
           d * (1 - {RATE} * turnover) - 1 AS net_return, {RATE} * turnover AS transaction_cost FROM path)"""


def ledger_inputs(market, targets=None):
    """Initial books, instants, decisions and factors of the strategies' path.

    The path opens with the first decision's targets as the initial book.
    """
    targets = _targets(market) if targets is None else targets
    months = market.months
    first = market.decisions.agg(F.min("decision_time").alias("first"))
    last = months.agg(F.max("instant").alias("last"))
    # Decisions at the last instant aren't executed on the path.
    begun = targets.join(F.broadcast(first), F.col("decision_time") >= F.col("first")).join(
        F.broadcast(last), F.col("decision_time") < F.col("last")
    )
    initial = begun.where("decision_time = first").select("strategy_id", "asset", "weight")
    decisions = begun.where("decision_time > first").select("strategy_id", F.col("decision_time").alias("execution_time"), "asset", "weight")
    at = months.join(F.broadcast(first), F.col("instant") >= F.col("first")).select("instant")
    instants = targets.select("strategy_id").distinct().join(small(at), F.lit(True))
    return initial, instants, decisions, market.factors


def strategy_ledger(spark, sf_dir, targets=None, checked=False):
    return saved(led.build_ledger(*ledger_inputs(views.Market(spark, sf_dir), targets), rate=RATE, checked=checked))


@query(f"""{_PATH}, wealth AS (SELECT *, product(1 + net_return) OVER (PARTITION BY strategy_id ORDER BY period) AS w FROM ledger)
    SELECT strategy_id, period, period_start, period_end, {_r('gross_return')} AS gross_return, {_r('net_return')} AS net_return,
           {_r('turnover')} AS turnover, {_r('transaction_cost')} AS transaction_cost,
           {_r('coalesce(lag(w) OVER (PARTITION BY strategy_id ORDER BY period), 1)')} AS wealth_open, {_r('w')} AS wealth_close FROM wealth""")
def ptf_ledger(spark, sf_dir):
    found = strategy_ledger(spark, sf_dir)
    return _rounded(found, "gross_return", "net_return", "turnover", "transaction_cost", "wealth_open", "wealth_close")


@query(f"""{_PATH}, books AS (SELECT p.strategy_id, p.instant, unnest(f.assets) AS asset, unnest(p.book) AS closing
    FROM path p JOIN flow f ON f.strategy_id = p.strategy_id AND f.position = p.position)
    SELECT strategy_id, instant, asset, {_r('closing')} AS closing FROM books""")
def ptf_ledger_weights(spark, sf_dir):
    found = led.ledger_weights(*ledger_inputs(views.Market(spark, sf_dir)))
    return _rounded(found, "closing").select("strategy_id", "instant", "asset", "closing")


@query(f"""WITH {_BASE}, spans AS (SELECT decision_time AS execution_time, lead(decision_time) OVER (ORDER BY decision_time) AS until FROM decisions)
    SELECT 'all' AS strategy_id, execution_time, asset, {_r('product(g) - 1')} AS realized_return
    FROM spans JOIN months ON instant >= execution_time AND instant < until JOIN panel USING (month) GROUP BY ALL""")
def ptf_realized_interval(spark, sf_dir):
    market = views.Market(spark, sf_dir)
    executions = market.decisions.select(F.lit("all").alias("strategy_id"), F.col("decision_time").alias("execution_time"))
    return _rounded(led.realized_returns(market.factors, executions), "realized_return")


# Allocation.


@query(f"WITH {_BASE}, {_TARGETS} SELECT decision_time, asset, {_r('weight')} AS weight FROM targets WHERE strategy_id = 'equal_weight'")
def str_equal_weight(spark, sf_dir):
    found = alloc.equal_weight(_windows(views.Market(spark, sf_dir)).select("decision_time", "asset").distinct())
    return _rounded(found, "weight").select("decision_time", "asset", "weight")


@query(f"WITH {_BASE} SELECT decision_time, asset, {_r('weight')} AS weight FROM inverse_vol")
def str_inverse_vol(spark, sf_dir):
    return _rounded(alloc.inverse_volatility(_windows(views.Market(spark, sf_dir))), "weight")


@query(f"""WITH {_BASE} SELECT x.decision_time, x.asset AS a, y.asset AS b, {_r('covar_samp(x.r, y.r)')} AS covariance
    FROM windows x JOIN windows y ON x.decision_time = y.decision_time AND x.month = y.month AND x.asset <= y.asset GROUP BY ALL""")
def str_covariance(spark, sf_dir):
    return _rounded(alloc.sample_covariance(_windows(views.Market(spark, sf_dir))), "covariance")


@query(f"""WITH {_BASE}, two AS (SELECT * FROM windows WHERE asset IN ('AF', 'NO')),
    s AS (SELECT x.decision_time, var_samp(x.r) AS s11, var_samp(y.r) AS s22, covar_samp(x.r, y.r) AS s12
          FROM two x JOIN two y ON x.decision_time = y.decision_time AND x.month = y.month AND x.asset = 'AF' AND y.asset = 'NO' GROUP BY ALL),
    w AS (SELECT decision_time, least(1, greatest(0, (s22 - s12) / (s11 + s22 - 2 * s12))) AS w FROM s)
    SELECT decision_time, 'AF' AS asset, {_r('w', 6)} AS weight FROM w UNION ALL SELECT decision_time, 'NO', {_r('1 - w', 6)} FROM w""")
def str_min_var_2asset(spark, sf_dir):
    found = alloc.minimum_variance(_windows(views.Market(spark, sf_dir)).where(F.col("asset").isin("AF", "NO")))
    return _rounded(found, "weight", places=6).select("decision_time", "asset", "weight")


@query()
def str_min_var(spark, sf_dir):
    return alloc.minimum_variance(_windows(views.Market(spark, sf_dir)))


def _forecasts(windows):
    return windows.groupBy("decision_time", "asset").agg(F.avg("r").alias("expected_return"))


@query()
def str_mean_var(spark, sf_dir):
    windows = _windows(views.Market(spark, sf_dir))
    return alloc.mean_variance(windows, _forecasts(windows), 4.0)


@query(f"""WITH {_BASE} SELECT decision_time, count(DISTINCT asset) AS n_assets, count(*) AS n_rows, count(DISTINCT month) AS n_months
    FROM windows GROUP BY ALL""")
def str_windows(spark, sf_dir):
    return _windows(views.Market(spark, sf_dir)).groupBy("decision_time").agg(
        F.count_distinct("asset").alias("n_assets"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("t").alias("n_months")
    )


# Metrics.


def _metric(name, sql):
    return f"{_PATH} SELECT strategy_id, {_r(sql, 6)} AS {name} FROM ledger GROUP BY ALL"


def _measure(spark, sf_dir, name, column):
    rows = met.with_risk_free(strategy_ledger(spark, sf_dir), 0.001)
    return _rounded(rows.groupBy("strategy_id").agg(column.alias(name)), name, places=6)


@query(_metric("cumulative_return", "product(1 + net_return) - 1"))
def met_cumulative(spark, sf_dir):
    return _measure(spark, sf_dir, "cumulative_return", met.cumulative_return())


@query(_metric("annualized_mean_return", "avg(net_return) * 12"))
def met_ann_mean(spark, sf_dir):
    return _measure(spark, sf_dir, "annualized_mean_return", met.annualized_mean_return(12))


@query(_metric("annualized_volatility", "stddev_samp(net_return) * sqrt(12)"))
def met_ann_vol(spark, sf_dir):
    return _measure(spark, sf_dir, "annualized_volatility", met.annualized_volatility(12))


_SHARPE = "avg(net_return - 0.001) / stddev_samp(net_return - 0.001) * sqrt(12)"


@query(_metric("sharpe_ratio", _SHARPE))
def met_sharpe(spark, sf_dir):
    return _measure(spark, sf_dir, "sharpe_ratio", met.sharpe_ratio(12))


_DRAWDOWN = """walks AS (SELECT strategy_id, period, product(1 + net_return) OVER (PARTITION BY strategy_id ORDER BY period) AS w FROM ledger),
    peaks AS (SELECT strategy_id, w, greatest(1, max(w) OVER (PARTITION BY strategy_id ORDER BY period)) AS peak FROM walks),
    falls AS (SELECT strategy_id, least(0, min(w / peak - 1)) AS max_drawdown FROM peaks GROUP BY ALL)"""


@query(f"{_PATH}, {_DRAWDOWN} SELECT strategy_id, {_r('max_drawdown', 6)} AS max_drawdown FROM falls")
def met_max_drawdown(spark, sf_dir):
    return _rounded(met.max_drawdown(strategy_ledger(spark, sf_dir)), "max_drawdown", places=6)


@query(_metric("certainty_equivalent_return", "pow(exp(avg(ln(1 + net_return))), 12) - 1"))
def met_cer_log(spark, sf_dir):
    return _measure(spark, sf_dir, "certainty_equivalent_return", met.certainty_equivalent(1, periods_per_year=12))


@query(_metric("certainty_equivalent_return", "pow(pow(avg(pow(1 + net_return, -2)), -0.5), 12) - 1"))
def met_cer_power(spark, sf_dir):
    return _measure(spark, sf_dir, "certainty_equivalent_return", met.certainty_equivalent(3, periods_per_year=12))


_CORE = f"""measures AS (SELECT strategy_id, count(*) AS n_periods, product(1 + net_return) - 1 AS cumulative_return,
    avg(net_return) * 12 AS annualized_mean_return, stddev_samp(net_return) * sqrt(12) AS annualized_volatility,
    {_SHARPE} AS sharpe_ratio, pow(pow(avg(pow(1 + net_return, -2)), -0.5), 12) - 1 AS certainty_equivalent_return FROM ledger GROUP BY ALL)"""
_CORE_SQL = f"""{_PATH}, {_DRAWDOWN}, {_CORE} SELECT strategy_id, n_periods, """ + ", ".join(f"{_r(m, 6)} AS {m}" for m in met.METRICS) + (
    ", 'ok' AS metric_status FROM measures JOIN falls USING (strategy_id)"
)


@query(_CORE_SQL)
def met_core(spark, sf_dir):
    found = met.core_metrics(strategy_ledger(spark, sf_dir), 12, 3.0, 0.001)
    return _rounded(found, *met.METRICS, places=6)


@query(f"""{_PATH}, {_DRAWDOWN.replace('net_return', 'gross_return')} SELECT strategy_id, {_r('product(1 + gross_return) - 1', 6)} AS cumulative_return,
    {_r('avg(gross_return) * 12', 6)} AS annualized_mean_return, {_r('any_value(max_drawdown)', 6)} AS max_drawdown FROM ledger JOIN falls USING (strategy_id) GROUP BY strategy_id""")
def met_gross(spark, sf_dir):
    found = met.core_metrics(strategy_ledger(spark, sf_dir), 12, 3.0, 0.0, basis="gross")
    return _rounded(found.select("strategy_id", "cumulative_return", "annualized_mean_return", "max_drawdown"), "cumulative_return", "annualized_mean_return", "max_drawdown", places=6)


_EXCESS = "net_return - (0.001 + 0.0001 * (period % 5))"


@query(_metric("sharpe_ratio", f"avg({_EXCESS}) / stddev_samp({_EXCESS}) * sqrt(12)"))
def met_risk_free_series(spark, sf_dir):
    """The ratio over a rate of its own for each period."""
    ledger = strategy_ledger(spark, sf_dir)
    rates = ledger.select("period", (0.001 + 0.0001 * (F.col("period") % 5)).alias("risk_free")).distinct()
    rows = met.with_risk_free(ledger, rates)
    return _rounded(rows.groupBy("strategy_id").agg(met.sharpe_ratio(12).alias("sharpe_ratio")), "sharpe_ratio", places=6)


def longest_loss(batches):
    """The most periods in a row that lost: a measure that needs a path's order."""
    longest = now = 0
    for batch in batches:
        for r in batch.column("net_return").to_pylist():
            now = now + 1 if r < 0 else 0
            longest = max(longest, now)
    return float(longest)


@query(f"""{_PATH}, runs AS (SELECT strategy_id, net_return, period - row_number() OVER (PARTITION BY strategy_id, net_return < 0 ORDER BY period) AS run FROM ledger),
    losses AS (SELECT strategy_id, max(n) AS longest FROM (SELECT strategy_id, run, count(*) AS n FROM runs WHERE net_return < 0 GROUP BY ALL) GROUP BY ALL)
    SELECT l.strategy_id, {_r('avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END)', 6)} AS hit_rate, CAST(any_value(longest) AS DOUBLE) AS longest_loss
    FROM ledger l LEFT JOIN losses USING (strategy_id) GROUP BY l.strategy_id""")
def met_evaluators(spark, sf_dir):
    """Measures of one's own beside the six: an aggregate, and a function of the path."""
    hit_rate = F.avg(F.when(F.col("net_return") > 0, 1.0).otherwise(0.0))
    found = met.evaluate(strategy_ledger(spark, sf_dir), {"hit_rate": hit_rate, "longest_loss": longest_loss})
    return _rounded(found, "hit_rate", places=6)


@query(f"""{_PATH}, {_DRAWDOWN}, {_CORE} SELECT strategy_id, n_periods, {_r('sharpe_ratio', 6)} AS sharpe_ratio, {_r('max_drawdown', 6)} AS max_drawdown,
    'run-1' AS experiment_id, TRUE AS same_again FROM measures JOIN falls USING (strategy_id)""")
def res_records(spark, sf_dir):
    """Records of a run as rows: composed, written as text, parsed again, and read by field."""
    from vintara.plans import results

    ledger = strategy_ledger(spark, sf_dir)
    measured = met.core_metrics(ledger, 12, 3.0, 0.001)
    manifest = results.RunManifest("run-1", "0" * 64, "1", 0, "2026-01-01T00:00:00Z", "spark")
    settings = results.verdicts(spark, {"rate": str(RATE)}, {"rate": str(RATE)}, set())
    texts = results.records_to_json(results.run_records(ledger, measured, manifest, settings, {"periods_per_year": 12, "gamma": 3.0}))
    again = results.records_from_json(saved(texts))
    get = lambda path, kind: F.try_variant_get("record", path, kind)
    found = again.join(texts, "strategy_id").select(
        "strategy_id", get("$.path.n_periods", "bigint").alias("n_periods"), get("$.metrics.sharpe_ratio", "double").alias("sharpe_ratio"),
        get("$.metrics.max_drawdown", "double").alias("max_drawdown"), get("$.manifest.experiment_id", "string").alias("experiment_id"),
        (F.to_json("record") == F.col("text")).alias("same_again"),
    )
    return _rounded(found, "sharpe_ratio", "max_drawdown", places=6)


@query(f"""WITH {_BASE} SELECT x.decision_time, x.asset AS a, y.asset AS b, count(*) AS n, {_r('covar_samp(x.r, y.r)')} AS covariance
    FROM windows x JOIN windows y ON x.decision_time = y.decision_time AND x.month = y.month AND x.asset <= y.asset GROUP BY ALL""")
def str_covariance_blocks(spark, sf_dir):
    from vintara.operators import gram

    return _rounded(gram.block_covariance(_windows(views.Market(spark, sf_dir))), "covariance")


@query(f"WITH {_BASE} SELECT strategy, decision_time, TRUE AS optimal FROM (SELECT DISTINCT decision_time FROM windows), (VALUES ('mean_variance'), ('min_variance')) v(strategy)")
def str_optimality(spark, sf_dir):
    """The conditions of the optimum, by SQL over weights, covariances and forecasts: held assets have one marginal value, the others none better."""
    windows = saved(_windows(views.Market(spark, sf_dir)))
    half = alloc.sample_covariance(windows)
    both = half.unionByName(half.where("a < b").select("decision_time", F.col("b").alias("a"), F.col("a").alias("b"), "covariance"))
    expected = _forecasts(windows)
    parts = []
    for name, books, scale, tilt in (("min_variance", alloc.minimum_variance(windows), 1.0, 0.0), ("mean_variance", alloc.mean_variance(windows, expected, 4.0), 4.0, 1.0)):
        weights = books.select("decision_time", "asset", "weight")
        risk = both.join(weights.withColumnRenamed("asset", "b"), ["decision_time", "b"]).groupBy("decision_time", F.col("a").alias("asset")).agg(F.sum(F.col("covariance") * F.col("weight")).alias("risk"))
        rows = weights.join(risk, ["decision_time", "asset"]).join(expected, ["decision_time", "asset"])
        marginal = scale * F.col("risk") - tilt * F.col("expected_return")
        rows = rows.withColumn("marginal", marginal)
        least = F.min("marginal")
        held = F.max(F.when(F.col("weight") > 0, F.col("marginal")))
        size = F.max(F.abs("marginal"))
        lawful = (F.min("weight") >= 0) & (F.abs(F.sum("weight") - 1) < 1e-9) & (held - least <= 1e-6 * size)
        parts.append(rows.groupBy("decision_time").agg(lawful.alias("optimal")).select(F.lit(name).alias("strategy"), "decision_time", "optimal"))
    return parts[0].unionByName(parts[1])


def _declared(spark, sf_dir, every=1):
    """Ledger, metrics and records of both strategies by a declared run over the panel."""
    from vintara.plans import declared, experiment, protocol

    market = views.Market(spark, sf_dir)
    windows = saved(_windows(market))
    strategies = {
        "inverse_vol": alloc.inverse_volatility,
        "equal_weight": lambda w: alloc.equal_weight(w.select("decision_time", "asset").distinct()),
    }
    config = experiment.Configuration("inverse_vol", ("equal_weight",))
    conditions = declared.Conditions(
        windows, market.months.select("instant"), market.factors, constraints=ptf.WeightConstraints(), rate=RATE,
        turnover="one_way", periods_per_year=12, risk_aversion=3.0, risk_free=0.001,
    )
    # Neither strategy fits anything, and both say so.
    nothing = {name: protocol.Protocol((), ()) for name in strategies}
    return declared.run_declared(config, strategies, conditions, nothing, {name: () for name in strategies}, rebalance_every=every)


@query(_CORE_SQL)
def exp_backtest_inverse_vol(spark, sf_dir):
    """The flagship: targets, ledger and metrics of both strategies in a declared run, with all inputs checked."""
    _, measured, _ = _declared(spark, sf_dir)
    return _rounded(measured, *met.METRICS, places=6)


@query(f"""{_PATH}, wealth AS (SELECT *, product(1 + net_return) OVER (PARTITION BY strategy_id ORDER BY period) AS w FROM ledger)
    SELECT strategy_id, count(*) AS n_periods, min(period_start) AS period_start, max(period_end) AS period_end, 1.0::DOUBLE AS wealth_open,
           {_r('arg_max(w, period)', 6)} AS wealth_close FROM wealth GROUP BY ALL""")
def exp_record(spark, sf_dir):
    _, _, records = _declared(spark, sf_dir)
    found = records.select("strategy_id", "n_periods", "period_start", "period_end", "wealth_open", "wealth_close")
    return _rounded(found, "wealth_open", "wealth_close", places=6)


@query(f"""WITH {_BASE}, {_TARGETS} SELECT strategy_id, decision_time, {_r('sum(weight)')} AS net, count(*) AS n_assets,
    decision_time AS execution_time FROM targets GROUP BY ALL""")
def exp_targets(spark, sf_dir):
    from vintara.plans import experiment

    windows = saved(_windows(views.Market(spark, sf_dir)))
    equal = lambda w: alloc.equal_weight(w.select("decision_time", "asset").distinct())
    books = experiment.targets_of(windows, {"inverse_vol": alloc.inverse_volatility, "equal_weight": equal})
    found = ptf.exposures(books, ["strategy_id", "decision_time"])
    return _rounded(found, "net").select("strategy_id", "decision_time", "net", "n_assets", F.col("decision_time").alias("execution_time"))


@query(f"""WITH {_BASE}, {_TARGETS}, placed AS (SELECT strategy_id, decision_time, dense_rank() OVER (PARTITION BY strategy_id ORDER BY decision_time) - 1 AS p FROM targets)
    SELECT DISTINCT strategy_id, decision_time FROM placed WHERE p % 2 = 0""")
def exp_hold_cadence(spark, sf_dir):
    from vintara.plans import experiment

    return experiment.held(_targets(views.Market(spark, sf_dir)), 2).select("strategy_id", "decision_time").distinct()


# Comparison.

_CELLS = " UNION ALL ".join(f"SELECT strategy_id, '{m}' AS metric, {m} AS value FROM measures JOIN falls USING (strategy_id)" for m in met.METRICS)
_TABLE = f"""{_PATH}, {_DRAWDOWN}, {_CORE}, found AS ({_CELLS}),
    arms(strategy_id) AS (VALUES ('equal_weight'), ('inverse_vol'), ('unrecorded')),
    asked AS (SELECT a.strategy_id, m.metric FROM arms a, (SELECT DISTINCT metric FROM found) m),
    cells AS (SELECT a.strategy_id, a.metric, value, CASE WHEN f.strategy_id IS NULL THEN 'missing_record' WHEN value IS NULL THEN 'missing_metric' ELSE 'ok' END AS status
      FROM asked a LEFT JOIN found f ON a.strategy_id = f.strategy_id AND a.metric = f.metric)"""


def _table(spark, sf_dir):
    from vintara.plans import compare

    measured = met.core_metrics(strategy_ledger(spark, sf_dir), 12, 3.0, 0.001)
    records = compare.observations(measured, basis="net", periods_per_year=12, gamma=3.0, risk_free=0.001)
    arms = spark.createDataFrame([(s,) for s in (*STRATEGIES, "unrecorded")], "strategy_id string")
    return compare.cells(arms, list(met.METRICS), records)


@query(f"{_TABLE} SELECT strategy_id, metric, {_r('value', 6)} AS value, status FROM cells")
def cmp_table(spark, sf_dir):
    found = _table(spark, sf_dir).select("strategy_id", "metric", "status", F.explode_outer("observations").alias("o"))
    return _rounded(found.withColumn("value", F.col("o.value")), "value", places=6).select("strategy_id", "metric", "value", "status")


# Declarations of the comparability query: one, two that differ between the arms, two of one arm.
_DECLARED = ("one", "differ", "several", "missing")


@query(f"""{_PATH}, {_DRAWDOWN}, {_CORE}, found AS ({_CELLS}),
    declared(kind, strategy_id, gamma) AS (VALUES ('one', 'equal_weight', 3), ('one', 'inverse_vol', 3), ('differ', 'equal_weight', 3),
        ('differ', 'inverse_vol', 5), ('several', 'equal_weight', 3), ('several', 'inverse_vol', 3), ('several', 'inverse_vol', 5), ('missing', 'equal_weight', 3)),
    cells AS (SELECT kind, k.strategy_id, metric, count(d.gamma) AS n, max(d.gamma) AS gamma FROM (SELECT DISTINCT d.kind, f.strategy_id, f.metric FROM declared d, found f) k
        LEFT JOIN declared d USING (kind, strategy_id) GROUP BY ALL)
    SELECT kind, metric, CASE WHEN min(n) = 0 THEN 'missing_values' WHEN max(n) > 1 THEN 'multiple_declaration_sets'
        WHEN count(DISTINCT gamma) = 1 THEN 'comparable' ELSE 'declaration_mismatch' END AS comparability FROM cells GROUP BY ALL""")
def cmp_comparability(spark, sf_dir):
    from vintara.plans import compare

    measured = saved(met.core_metrics(strategy_ledger(spark, sf_dir), 12, 3.0, 0.001))
    arms = spark.createDataFrame([(s,) for s in STRATEGIES], "strategy_id string")
    under = lambda gamma: compare.observations(measured, basis="net", periods_per_year=12, gamma=gamma, risk_free=0.001)
    equal, inverse = F.col("strategy_id") == "equal_weight", F.col("strategy_id") == "inverse_vol"
    records = {
        "one": under(3.0),
        "differ": under(3.0).where(equal).unionByName(under(5.0).where(inverse)),
        "several": under(3.0).unionByName(under(5.0).where(inverse)),
        "missing": under(3.0).where(equal),
    }
    parts = [
        compare.comparability(compare.cells(arms, list(met.METRICS), records[kind])).select(F.lit(kind).alias("kind"), "metric", "comparability")
        for kind in _DECLARED
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("""WITH declared(field, value) AS (VALUES ('statuses', '3'), ('priorities', '5'), ('rate', '0.001'), ('customers', '10')),
    effective(field, value) AS (SELECT 'statuses', CAST(count(DISTINCT o_orderstatus) AS VARCHAR) FROM orders UNION ALL SELECT 'priorities', CAST(count(DISTINCT o_orderpriority) AS VARCHAR) FROM orders
      UNION ALL SELECT 'customers', CAST(count(DISTINCT o_custkey) AS VARCHAR) FROM orders UNION ALL SELECT * FROM (VALUES ('rate', '0.002'), ('zone', 'UTC'))),
    sanctioned(field) AS (VALUES ('rate')), x AS (
    SELECT coalesce(d.field, e.field) AS field, d.value AS declared, e.value AS effective FROM declared d FULL JOIN effective e ON d.field = e.field)
    SELECT x.field, declared, effective, CASE WHEN declared IS NOT DISTINCT FROM effective THEN 'consistent'
        WHEN s.field IS NOT NULL THEN 'sanctioned_deviation' ELSE 'reject' END AS verdict FROM x LEFT JOIN sanctioned s ON x.field = s.field""")
def res_conformance_verdict(spark, sf_dir):
    """What was declared of the orders beside what they have."""
    from vintara.plans import results

    orders = views.table(spark, sf_dir, "orders")
    counted = {"statuses": "o_orderstatus", "priorities": "o_orderpriority", "customers": "o_custkey"}
    have = orders.agg(*(F.count_distinct(c).cast("string").alias(n) for n, c in counted.items())).first().asDict()
    declared = {"statuses": "3", "priorities": "5", "rate": "0.001", "customers": "10"}
    return results.verdicts(spark, declared, have | {"rate": "0.002", "zone": "UTC"}, {"rate"})


def _levels(first):
    """SQL of the digests of ``first`` (``decision_time, n, h, d``), level by level."""
    from vintara.plans.results import MEMBER_LEVELS

    parts, before = [], first
    for k, digits in enumerate(MEMBER_LEVELS):
        parts.append(f"""level{k} AS (SELECT decision_time, substr(h, 1, {digits}) AS h, sum(n) AS n, sha256(string_agg(d, ',' ORDER BY h, d)) AS d
            FROM {before} GROUP BY decision_time, substr(h, 1, {digits}))""")
        before = f"level{k}"
    return ", ".join(parts) + f" SELECT decision_time, CAST(n AS BIGINT) AS n_members, d AS digest FROM {before}"


_MEMBERS = f"""WITH {views.OBS}, {views.GRID}, ranked AS (SELECT decision_time, series_id, observation_time, available_time,
      row_number() OVER (PARTITION BY decision_time, series_id, observation_time ORDER BY available_time DESC) AS k FROM obs JOIN grid ON available_time <= decision_time),
    hashed AS (SELECT decision_time, sha256('["' || series_id || '","' || epoch_us(observation_time) || '","' || epoch_us(available_time) || '"]') AS d FROM ranked WHERE k = 1),
    members AS (SELECT decision_time, 1 AS n, d AS h, d FROM hashed)"""


@query(f"{_MEMBERS}, {_levels('members')}")
def res_membership_digest(spark, sf_dir):
    from vintara.operators import pit
    from vintara.plans import results

    return results.membership_digests(*pit.valid_vintages(views.obs(spark, sf_dir), views.grid(spark), ()))
