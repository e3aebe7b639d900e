"""The wealth path of rebalanced books, in closed form.

Trades reset a book, so between trades everything is a product. With the executions of a
strategy numbered into spells (spell 0 holds the initial book) and segments beginning at
accounting and execution instants, for base weights ``w`` of a spell and cumulated growth
``C`` of an asset within it, a spell's value is ``V = sum(w C)``; a segment grows by ``V`` over
the ``V`` before, a drifted weight is ``w C / V``. A period's gross growth is the product of its
segments, its cost factor the product of ``1 - q`` of its executions, and wealth the running
product of both. All of it is joins and running totals in range buckets, whatever the number of
periods: one path is spread over as many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.checks import require_none
from vintara.errors import ExecutionError
from vintara.operators.buckets import running
from vintara.operators.portfolio import TURNOVERS
from vintara.storage import saved, small

#: What trades cost: ``strategy_id, execution_time, asset, pre, target, delta`` of all trades to ``strategy_id,
#: execution_time, q``, the share of wealth that each costs.
CostModel = Callable[[DataFrame], DataFrame]


def periods_of(instants: DataFrame, by: tuple[str, ...] = ("strategy_id",)) -> DataFrame:
    """``period, period_start, period_end`` between successive instants."""
    placed = running(instants.select(*by, "instant").distinct(), by, ["instant"], {"_place": ("count", F.lit(1))})
    start = placed.select(*by, F.col("instant").alias("period_start"), (F.col("_place") - 1).cast("int").alias("period"))
    end = placed.select(*by, F.col("instant").alias("period_end"), (F.col("_place") - 2).cast("int").alias("period"))
    return start.join(end, [*by, "period"]).select(*by, "period_start", "period_end", "period")


def _segments(instants: DataFrame, decisions: DataFrame) -> DataFrame:
    """Segments of each strategy with their spell, their period and whether an execution opens them.

    ``instants`` has each strategy's accounting instants, the last of which closes the path;
    each opens a segment, so their running number is the period that a segment belongs to.
    """
    executions = decisions.select("strategy_id", F.col("execution_time").alias("instant")).distinct().withColumn("trade", F.lit(1))
    last = instants.groupBy("strategy_id").agg(F.max("instant").alias("_end"))
    starts = (
        instants.select("strategy_id", "instant", F.lit(1).alias("point"))
        .distinct()
        .join(executions, ["strategy_id", "instant"], "full")
        .join(last, "strategy_id")
        .where(F.col("instant") < F.col("_end"))
        .select("strategy_id", "instant", F.coalesce("trade", F.lit(0)).alias("trade"), F.coalesce("point", F.lit(0)).alias("point"))
    )
    counts = {"spell": ("sum", F.col("trade")), "segment": ("count", F.lit(1)), "_points": ("sum", F.col("point"))}
    placed = running(starts, ["strategy_id"], ["instant"], counts)
    return placed.select("strategy_id", "instant", "trade", "spell", F.col("segment").cast("int").alias("segment"), (F.col("_points") - 1).alias("period"))


def ledger_weights(initial: DataFrame, instants: DataFrame, decisions: DataFrame, factors: DataFrame) -> DataFrame:
    """``strategy_id, spell, segment, period, instant, asset, base, opening, closing, value``.

    ``initial`` has ``strategy_id, asset, weight``; ``instants`` ``strategy_id, instant``;
    ``decisions`` ``strategy_id, execution_time, asset, weight``; ``factors`` ``instant,
    asset, g`` with the growth of the segment that begins there. ``opening`` and ``closing``
    are the drifted weights at a segment's ends, ``value`` the spell's value at its end.
    """
    segments = _segments(instants, decisions)
    spells = segments.where("trade = 1").select("strategy_id", "spell", F.col("instant").alias("execution_time"))
    base = (
        initial.select("strategy_id", F.lit(0).cast("long").alias("spell"), "asset", "weight")
        .unionByName(decisions.join(spells, ["strategy_id", "execution_time"]).select("strategy_id", "spell", "asset", "weight"))
        .withColumnRenamed("weight", "base")
    )
    rows = segments.join(base, ["strategy_id", "spell"]).join(factors, ["instant", "asset"], "left")
    before = running(rows, ["strategy_id", "spell", "asset"], ["segment"], {"_grown": ("product", F.col("g"))}, inclusive=False)
    grown = before.withColumn("_open", F.coalesce("_grown", F.lit(1.0))).withColumn("_c", F.col("_open") * F.coalesce("g", F.lit(1.0)))
    book = Window.partitionBy("strategy_id", "segment")
    return grown.withColumn("value", F.sum(F.col("base") * F.col("_c")).over(book)).withColumn(
        "value_before", F.sum(F.col("base") * F.col("_open")).over(book)
    ).select(
        "strategy_id", "spell", "segment", "period", "instant", "trade", "asset", "base", "g", "value_before", "value",
        F.try_divide(F.col("base") * F.col("_open"), F.col("value_before")).alias("opening"),
        F.try_divide(F.col("base") * F.col("_c"), F.col("value")).alias("closing"),
    )


def executions(
    weights: DataFrame, rate: float, measure: str = "one_way", initial: DataFrame | None = None, costs: CostModel | None = None
) -> DataFrame:
    """``strategy_id, execution_time, segment, period, turnover, q`` of each execution.

    The book before a trade is the one that the segment before closes with; a trade that
    opens the path meets the ``initial`` book. A trade costs ``rate`` times its turnover, or what ``costs`` says.
    """
    half = 0.5 if measure == "one_way" else 1.0
    opened = weights.where("trade = 1").select("strategy_id", "segment", "period", "instant", "asset", F.col("base").alias("target"))
    closed = weights.select("strategy_id", (F.col("segment") + 1).alias("segment"), "asset", F.col("closing").alias("pre"))
    if initial is not None:
        closed = closed.unionByName(
            initial.select("strategy_id", F.lit(1).alias("segment"), "asset", F.col("weight").alias("pre"))
        )
    times = opened.select("strategy_id", "segment", "period", "instant").distinct()
    closed = closed.join(times.select("strategy_id", "segment"), ["strategy_id", "segment"], "left_semi")
    zero = F.lit(0.0)
    trades = (
        opened.drop("instant", "period")
        .join(closed, ["strategy_id", "segment", "asset"], "full")
        .withColumn("delta", F.coalesce("target", zero) - F.coalesce("pre", zero))
    )
    found = (
        trades.groupBy("strategy_id", "segment")
        .agg((half * F.sum(F.abs("delta"))).alias("turnover"))
        .join(times, ["strategy_id", "segment"])
        .select("strategy_id", F.col("instant").alias("execution_time"), "segment", "period", "turnover")
    )
    if costs is None:
        return found.withColumn("q", rate * F.col("turnover"))
    named = trades.join(times, ["strategy_id", "segment"]).select(
        "strategy_id", F.col("instant").alias("execution_time"), "asset",
        F.coalesce("pre", zero).alias("pre"), F.coalesce("target", zero).alias("target"), "delta",
    )
    return found.join(costs(named).select("strategy_id", "execution_time", "q"), ["strategy_id", "execution_time"], "left")


def build_ledger(
    initial: DataFrame,
    instants: DataFrame,
    decisions: DataFrame,
    factors: DataFrame,
    rate: float = 0.0,
    measure: str = "one_way",
    initial_wealth: float = 1.0,
    checked: bool = True,
    strict_budget: bool = False,
    costs: CostModel | None = None,
) -> DataFrame:
    """One row for each period: ``gross_return, net_return, turnover, transaction_cost,
    wealth_open, wealth_close`` and its bounds.

    ``transaction_cost`` is ``1 - prod(1 - q)``; a model of ``costs`` takes the place of the rate. With ``checked`` the inputs are validated
    first: unit books, factors for every asset and segment, executions on the path,
    positive values, costs below 1. A unit book sums to 1 within 1e-9, or with
    ``strict_budget`` exactly, as a compensated sum in order of assets gives it.
    """
    if measure not in TURNOVERS or rate < 0 or not 0 < initial_wealth < float("inf"):
        raise ExecutionError("a ledger needs a turnover measure, a rate and a positive wealth")
    # Both are read several times below.
    weights = saved(ledger_weights(initial, instants, decisions, factors))
    trades = saved(executions(weights, rate, measure, initial, costs))
    if checked:
        _require_lawful(initial, instants, decisions, weights, trades, strict_budget)
    periods = periods_of(instants)
    values = weights.select("strategy_id", "period", "segment", F.try_divide("value", "value_before").alias("d")).distinct()
    gross = values.groupBy("strategy_id", "period").agg(F.product("d").alias("_gross"))
    cost = trades.groupBy("strategy_id", "period").agg(F.product(1 - F.col("q")).alias("_cost"), F.sum("turnover").alias("turnover"))
    rows = periods.join(gross, ["strategy_id", "period"]).join(cost, ["strategy_id", "period"], "left")
    factor = F.coalesce("_cost", F.lit(1.0))
    rows = rows.withColumn("_net", F.col("_gross") * factor)
    rows = running(rows, ["strategy_id"], ["period"], {"_before": ("product", F.col("_net"))}, inclusive=False)
    wealth = F.coalesce("_before", F.lit(1.0)) * initial_wealth
    return rows.select(
        "strategy_id", "period", "period_start", "period_end",
        (F.col("_gross") - 1).alias("gross_return"),
        (F.col("_net") - 1).alias("net_return"),
        F.coalesce("turnover", F.lit(0.0)).alias("turnover"),
        (1 - factor).alias("transaction_cost"),
        wealth.alias("wealth_open"),
        (wealth * F.col("_net")).alias("wealth_close"),
    )


def compensated_sum(values: Column) -> Column:
    """The sum of an array of doubles in its order, with what each addition loses added at the end."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("lost"))

    def add(acc: Column, x: Column) -> Column:
        total = acc["sum"] + x
        lost = F.when(F.abs(acc["sum"]) >= F.abs(x), (acc["sum"] - total) + x).otherwise((x - total) + acc["sum"])
        return F.struct(total.alias("sum"), (acc["lost"] + lost).alias("lost"))

    return F.aggregate(values, start, add, lambda acc: acc["sum"] + acc["lost"])


def _require_lawful(initial: DataFrame, instants: DataFrame, decisions: DataFrame, weights: DataFrame, trades: DataFrame, strict_budget: bool = False) -> None:
    books = initial.select("strategy_id", F.lit(None).cast("timestamp").alias("execution_time"), "asset", "weight").unionByName(
        decisions.select("strategy_id", "execution_time", "asset", "weight")
    )
    if strict_budget:
        held = F.transform(F.array_sort(F.collect_list(F.struct("asset", "weight"))), lambda x: x["weight"])
        exact = books.groupBy("strategy_id", "execution_time").agg(compensated_sum(held).alias("total"))
        require_none(exact.where("total IS NULL OR total <> 1"), ExecutionError, "not exactly a unit book")
    sums = books.groupBy("strategy_id", "execution_time").agg(F.sum("weight").alias("total"))
    require_none(sums.where("total IS NULL OR abs(total - 1) > 1e-9"), ExecutionError, "not a unit book")
    span = instants.groupBy("strategy_id").agg(F.min("instant").alias("_from"), F.max("instant").alias("_to"))
    off = decisions.join(span, "strategy_id", "left").where(
        "_from IS NULL OR execution_time < _from OR execution_time >= _to"
    )
    require_none(off, ExecutionError, "an execution outside the path")
    require_none(weights.where("g IS NULL OR g < 0"), ExecutionError, "no growth factor for an asset of the book")
    require_none(weights.where("NOT value > 0"), ExecutionError, "a book lost all its value")
    require_none(trades.where("q IS NULL OR NOT (q >= 0 AND q < 1)"), ExecutionError, "a trade costs all there is, or nobody knows what")


def realized_returns(factors: DataFrame, executions_: DataFrame) -> DataFrame:
    """Return of each asset from each execution to the next of its strategy.

    ``executions_`` has ``strategy_id, execution_time``; the last one's interval is open.
    """
    trades = executions_.select("strategy_id", "execution_time").distinct()
    last = trades.groupBy("strategy_id").agg(F.max("execution_time").alias("_last"))
    # Which execution an instant follows is a running maximum over both, by buckets of time.
    at = factors.select("instant").distinct().join(small(last.select("strategy_id")), F.lit(True))
    points = at.withColumn("_trade", F.lit(None).cast("timestamp")).unionByName(
        trades.select(F.col("execution_time").alias("instant"), "strategy_id", F.col("execution_time").alias("_trade"))
    )
    held = running(points, ["strategy_id"], ["instant"], {"execution_time": ("max", F.col("_trade"))})
    # An execution at an instant of a factor would give that instant twice.
    held = held.where("execution_time IS NOT NULL").select("strategy_id", "instant", "execution_time").distinct()
    return (
        held.join(last, "strategy_id")
        .where(F.col("execution_time") < F.col("_last"))
        .join(factors, "instant")
        .groupBy("strategy_id", "execution_time", "asset")
        .agg((F.product("g") - 1).alias("realized_return"))
    )
