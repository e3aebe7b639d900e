"""Performance statistics of ledgers, one row for each strategy."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintara.checks import require_none
from vintara.errors import ExecutionError
from vintara.operators.buckets import running
from vintara.storage import small

BASES = ("net", "gross")
METRICS = (
    "cumulative_return", "annualized_mean_return", "annualized_volatility", "sharpe_ratio", "max_drawdown",
    "certainty_equivalent_return",
)


def _return(basis: str) -> Column:
    if basis not in BASES:
        raise ExecutionError(f"a basis is of {BASES}")
    return F.col(f"{basis}_return")


def with_risk_free(ledger: DataFrame, risk_free: float | DataFrame = 0.0) -> DataFrame:
    """The ledger with ``risk_free`` for each period: one number, or ``period, risk_free`` rows."""
    if not isinstance(risk_free, DataFrame):
        return ledger.withColumn("risk_free", F.lit(float(risk_free)))
    joined = ledger.join(risk_free.select("period", "risk_free"), "period", "left")
    require_none(joined.where("risk_free IS NULL"), ExecutionError, "no risk-free rate for a period")
    require_none(risk_free.join(ledger, "period", "left_anti"), ExecutionError, "a risk-free rate for no period")
    return joined


def cumulative_return(basis: str = "net") -> Column:
    return F.product(1 + _return(basis)) - 1


def annualized_mean_return(periods_per_year: int, basis: str = "net") -> Column:
    return F.avg(_return(basis)) * periods_per_year


def annualized_volatility(periods_per_year: int, basis: str = "net") -> Column:
    """Of the sample deviation; null for fewer than two periods."""
    return F.when(F.count(F.lit(1)) > 1, F.stddev_samp(_return(basis)) * periods_per_year**0.5)


def sharpe_ratio(periods_per_year: int, basis: str = "net") -> Column:
    """Of excess returns over ``risk_free``; null without spread."""
    excess = _return(basis) - F.col("risk_free")
    flat = (F.count(F.lit(1)) < 2) | (F.max(excess) == F.min(excess))
    return F.when(~flat, F.try_divide(F.avg(excess), F.stddev_samp(excess)) * periods_per_year**0.5)


def certainty_equivalent(gamma: float, basis: str = "net", periods_per_year: int | None = None) -> Column:
    """Of constant relative risk aversion, compounded to a year if periods are given.

    Null if any growth isn't positive.
    """
    growth = 1 + _return(basis)
    if gamma <= 0:
        raise ExecutionError("risk aversion is positive")
    safe = F.when(growth > 0, growth)
    if gamma == 1:
        value = F.exp(F.avg(F.ln(safe)))
    else:
        value = F.pow(F.avg(F.pow(safe, F.lit(1.0 - gamma))), F.lit(1.0 / (1.0 - gamma)))
    if periods_per_year:
        value = F.pow(value, F.lit(float(periods_per_year)))
    return F.when(F.min(growth) > 0, value - 1)


def wealth_paths(ledger: DataFrame, basis: str = "net") -> DataFrame:
    """``strategy_id, period, wealth, peak``; net wealth is the ledger's, gross starts where it starts."""
    first = ledger.groupBy("strategy_id").agg(F.min_by("wealth_open", "period").alias("_first"))
    rows = ledger.join(small(first), "strategy_id")
    if basis == "net":
        rows = rows.withColumn("wealth", F.col("wealth_close"))
    else:
        rows = running(rows, ["strategy_id"], ["period"], {"_growth": ("product", 1 + _return(basis))})
        rows = rows.withColumn("wealth", F.col("_first") * F.col("_growth"))
    peaked = running(rows.select("strategy_id", "period", "_first", "wealth"), ["strategy_id"], ["period"], {"_peak": ("max", F.col("wealth"))})
    return peaked.select("strategy_id", "period", "wealth", F.greatest("_first", "_peak").alias("peak"))


def max_drawdown(ledger: DataFrame, basis: str = "net") -> DataFrame:
    """The least of wealth over its peak, less 1; at most 0."""
    worst = F.least(F.lit(0.0), F.min(F.col("wealth") / F.col("peak") - 1))
    return wealth_paths(ledger, basis).groupBy("strategy_id").agg(worst.alias("max_drawdown"))


def core_metrics(
    ledger: DataFrame, periods_per_year: int, gamma: float, risk_free: float | DataFrame = 0.0, basis: str = "net"
) -> DataFrame:
    """All six, with ``metric_status``: ``ok``, or ``undefined`` where one has no value."""
    rows = with_risk_free(ledger, risk_free)
    found = rows.groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("n_periods"),
        cumulative_return(basis).alias("cumulative_return"),
        annualized_mean_return(periods_per_year, basis).alias("annualized_mean_return"),
        annualized_volatility(periods_per_year, basis).alias("annualized_volatility"),
        sharpe_ratio(periods_per_year, basis).alias("sharpe_ratio"),
        certainty_equivalent(gamma, basis, periods_per_year).alias("certainty_equivalent_return"),
    )
    joined = found.join(max_drawdown(ledger, basis), "strategy_id")
    missing = F.array_contains(F.array(*(F.col(m).isNull() for m in METRICS)), True)
    return joined.select("strategy_id", "n_periods", *METRICS, F.when(missing, "undefined").otherwise("ok").alias("metric_status"))


#: A measure of one's own: an aggregate, or a function of a path's batches in order of periods.
Evaluator = Column | Callable[[Iterator[pa.RecordBatch]], float]


def evaluate(ledger: DataFrame, evaluators: Mapping[str, Evaluator], by: str = "strategy_id") -> DataFrame:
    """``by`` and a column for each evaluator, one row for each path of the ledger.

    Aggregates are combined over parts of a path; a function is given one path after the other,
    of which a task holds one batch at a time. A function that returns None has no value there.
    """
    if not evaluators:
        raise ExecutionError("nothing to evaluate")
    sums = {n: e for n, e in evaluators.items() if isinstance(e, Column)}
    found = ledger.groupBy(by).agg(*(e.alias(n) for n, e in sums.items())) if sums else ledger.select(by).distinct()
    ordered = ledger.repartition(by).sortWithinPartitions(by, "period")
    for name, function in evaluators.items():
        if name not in sums:
            found = found.join(ordered.groupBy(by).applyInArrow(_measured(function, by, name), f"`{by}` {dict(ledger.dtypes)[by]}, `{name}` double"), by)
    return found.select(by, *evaluators)


def _measured(function: Callable[[Iterator[pa.RecordBatch]], float], by: str, name: str):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches)

        def all_of() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        value = function(all_of())
        yield pa.RecordBatch.from_arrays([first.column(by)[:1], pa.array([value], pa.float64())], names=[by, name])

    return measure
