"""Declared runs: what a run needs, the contexts of its decisions, and the one call that runs it.

Everything that can be checked about a run is a query for the rows that break it, over the
decisions of all strategies at once; a run starts only if none is found.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintara.checks import require_none, require_unique
from vintara.errors import ConfigurationError, ExecutionError, FutureInformationError
from vintara.operators.pit import lookahead
from vintara.operators.portfolio import WeightConstraints
from vintara.plans.experiment import Configuration, Experiment, Strategy
from vintara.plans.protocol import FitProvenance, Protocol
from vintara.plans.results import path_results


@dataclass(frozen=True)
class Conditions:
    """What a run is given. Every field must be there when it runs; none is made up.

    ``windows`` are admitted returns of each decision, ``instants`` the accounting instants,
    ``factors`` the growth of assets; the others are the terms of trade and of measurement.
    """

    windows: DataFrame | None = None
    instants: DataFrame | None = None
    factors: DataFrame | None = None
    constraints: WeightConstraints | None = None
    rate: float | None = None
    turnover: str | None = None
    periods_per_year: int | None = None
    risk_aversion: float | None = None
    risk_free: float | None = None

    def require(self) -> Conditions:
        missing = [f.name for f in fields(self) if getattr(self, f.name) is None]
        if missing:
            raise ConfigurationError(f"a run needs {missing}")
        return self


def on_schedule(instants: DataFrame, schedule: DataFrame, instant: str = "instant") -> DataFrame:
    """The ``instants`` that are decisions of the ``schedule`` (``decision_time``)."""
    return instants.join(schedule.select(F.col("decision_time").alias(instant)).distinct(), instant, "left_semi")


def rebalance_violations(timings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of ``decision_time, execution_time`` that decide after they execute, or execute no later than the one before."""
    ordered = Window.partitionBy(*by).orderBy("decision_time", "execution_time")
    before = F.lag("execution_time").over(ordered)
    bad = (F.col("decision_time") > F.col("execution_time")) | (F.col("execution_time") <= before)
    return timings.withColumn("_bad", F.coalesce(bad, F.col("decision_time").isNull() | F.col("execution_time").isNull())).where("_bad").drop("_bad")


def require_factors_available(factors: DataFrame, use: str = "use_time", available: str = "available_time") -> DataFrame:
    """``factors``, if each was available when it was used."""
    require_none(lookahead(factors, use, available), FutureInformationError, "a factor used before it was available")
    return factors


def mapped_assets(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """``df`` (with ``series_id``) under the ``asset`` that a one-to-one ``mapping`` gives each series.

    Series without an asset are left out; an asset or a series that is there twice is rejected.
    """
    for key in ("series_id", "asset"):
        require_unique(mapping, [key], ConfigurationError, f"a mapping has each {key} once")
    require_none(mapping.where("series_id IS NULL OR asset IS NULL"), ConfigurationError, "a mapping without a name")
    return df.join(mapping.select("series_id", "asset"), "series_id")


def require_contexts(
    universe: DataFrame, holdings: DataFrame | None = None, information: DataFrame | None = None, forecasts: DataFrame | None = None
) -> DataFrame:
    """``universe``, if all that its decisions are given fits them.

    ``universe`` has ``decision_time, asset``, each once. ``holdings`` (``decision_time,
    asset, weight, state``) are books before the trade, of decisions that there are.
    ``information`` (``decision_time, as_of``) is no later than its decision, ``forecasts``
    (``decision_time, forecast_time``) are of exactly its instant.
    """
    require_unique(universe, ["decision_time", "asset"], ConfigurationError, "an asset twice in a universe")
    decisions = universe.select("decision_time").distinct()
    if holdings is not None:
        require_none(holdings.where("state IS NULL OR state <> 'PRE_TRADE'"), ExecutionError, "a decision sees books before the trade")
        require_none(holdings.join(decisions, "decision_time", "left_anti"), ExecutionError, "a book of no decision")
    if information is not None:
        late = information.where(~F.coalesce(F.col("as_of") <= F.col("decision_time"), F.lit(False)))
        require_none(late, FutureInformationError, "information later than its decision")
    if forecasts is not None:
        other = forecasts.where(~F.col("forecast_time").eqNullSafe(F.col("decision_time")))
        require_none(other, ExecutionError, "a forecast of another instant than its decision")
    return universe


def require_results(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """``results`` (``strategy_id, decision_time, execution_time``), one for each of the decisions, executed no earlier."""
    keys = ["strategy_id", "decision_time"]
    early = results.where(~F.coalesce(F.col("execution_time") >= F.col("decision_time"), F.lit(False)))
    require_none(early, ExecutionError, "executed before it was decided")
    each = results.select(*keys).distinct()
    due = decisions.select(*keys).distinct()
    apart = each.join(due, keys, "left_anti").unionByName(due.join(each, keys, "left_anti"))
    require_none(apart, ExecutionError, "results and decisions differ")
    return results


def forecast_links(forecasts: DataFrame) -> DataFrame:
    """The distinct ``strategy_id, fit_id`` of ``strategy_id, decision_time, fit_id``; one forecast a decision at most."""
    require_unique(forecasts, ["strategy_id", "decision_time"], ExecutionError, "two forecasts of one decision")
    return forecasts.select("strategy_id", "fit_id").distinct()


#: How a parameter of one strategy stands to that of another.
RELATIONS = ("identical", "distinct")


def relation_violations(parameters: DataFrame, relations: DataFrame) -> DataFrame:
    """Declared relations that don't hold, and parameters of several strategies without one.

    ``parameters`` has ``strategy_id, name, value``; ``relations`` ``name, relation``.
    """
    stated = parameters.groupBy("name").agg(F.count_distinct("value").alias("n_values"), F.count_distinct("strategy_id").alias("n_strategies"))
    both = stated.join(relations, "name", "full")
    holds = F.when(F.col("relation") == "identical", F.col("n_values") == 1).when(F.col("relation") == "distinct", F.col("n_values") > 1)
    needless = F.col("relation").isNull() & (F.col("n_strategies") < 2)
    return both.where(~F.coalesce(holds, needless, F.lit(False))).select("name", "relation", "n_values")


def run_declared(
    config: Configuration,
    strategies: Mapping[str, Strategy],
    conditions: Conditions,
    protocols: Mapping[str, Protocol],
    fits: Mapping[str, Sequence[FitProvenance]],
    wanted: str | Sequence[str] = "all",
    rebalance_every: int = 1,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ledger, the metrics and the path records of a run whose every part is declared.

    Before any decision, ``protocols`` and ``fits`` must cover the strategies exactly (one
    that fits nothing gives an empty sequence), and each strategy's fits must match its
    protocol's events in order, cutoff for cutoff. A path's record is composed of its bounds and measures.
    """
    if protocols is None or fits is None:
        raise TypeError("protocols and fits are given, not inferred")
    names = set(config.strategies)
    if set(protocols) != names or set(fits) != names:
        raise ExecutionError("protocols and fits are those of the configured strategies")
    for name in sorted(names):
        due = [e.cutoff for e in protocols[name].events if e.kind != "selection"]
        have = [p.cutoff for p in fits[name]]
        if due != have:
            raise ExecutionError(f"{name}: fits at {have}, events at {due}")
    given = conditions.require()
    experiment = Experiment(
        config, strategies, constraints=given.constraints, rate=given.rate, turnover=given.turnover, periods_per_year=given.periods_per_year,
        risk_aversion=given.risk_aversion, risk_free=given.risk_free, rebalance_every=rebalance_every,
    )
    ledger, measured = experiment.run(given.windows, given.instants, given.factors, wanted)
    return ledger, measured, path_results(ledger).join(measured.drop("n_periods"), "strategy_id")
