"""Portfolio books: exposures, validation, drift, trades, turnover and cost.

Books are long: a book's identity in one or more columns, ``asset``, ``weight``. An asset that
isn't there has weight 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.checks import require_none
from vintara.errors import ConfigurationError, ExecutionError
from vintara.storage import saved

STATES = ("TARGET", "PRE_TRADE", "POST_TRADE")
TURNOVERS = ("one_way", "two_sided")


@dataclass(frozen=True)
class WeightConstraints:
    """What a target book must satisfy."""

    allow_short: bool = False
    max_gross: float | None = None
    max_net: float | None = None
    budget: float = 1.0
    tolerance: float = 1e-9

    def __post_init__(self) -> None:
        if self.tolerance < 0 or self.budget != self.budget:
            raise ConfigurationError("a tolerance isn't negative and a budget is a number")
        for cap in (self.max_gross, self.max_net):
            if cap is not None and cap < abs(self.budget) - self.tolerance:
                raise ConfigurationError("no book of this budget keeps to the cap")


def exposures(books: DataFrame, by: Sequence[str]) -> DataFrame:
    """``gross, net`` and the number of assets of each book."""
    return books.groupBy(*by).agg(
        F.sum(F.abs("weight")).alias("gross"),
        (F.sum("weight") + F.lit(0.0)).alias("net"),
        F.count(F.lit(1)).alias("n_assets"),
        F.min("weight").alias("least"),
    )


def target_violations(books: DataFrame, by: Sequence[str], rules: WeightConstraints = WeightConstraints()) -> DataFrame:
    """The books that break a rule, with the rules they break in ``broken``."""
    e = exposures(books, by)
    tests = {
        "budget": F.abs(F.col("net") - rules.budget) > rules.tolerance,
        "short": F.lit(not rules.allow_short) & (F.col("least") < 0),
        "gross": F.lit(False) if rules.max_gross is None else F.col("gross") > rules.max_gross,
        "net": F.lit(False) if rules.max_net is None else F.col("net") > rules.max_net,
        "not_finite": F.isnan("gross") | (F.col("gross") == float("inf")) | F.col("gross").isNull(),
    }
    broken = F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))
    return e.withColumn("broken", broken).where(F.size("broken") > 0)


def require_targets(books: DataFrame, by: Sequence[str], rules: WeightConstraints = WeightConstraints()) -> DataFrame:
    require_none(target_violations(books, by, rules), ExecutionError, "not a lawful target")
    return books


def drift(books: DataFrame, factors: DataFrame, by: Sequence[str], factor_by: Sequence[str] | None = None) -> DataFrame:
    """Books after growth ``g`` of their assets: ``w g / sum(w g)``; and the book's growth.

    Universes of books and factors must be the same; a book must keep a positive value. What drifts is
    held: a book whose ``state`` is ``TARGET`` is rejected.
    """
    if "state" in books.columns:
        require_none(books.where("state = 'TARGET'"), ExecutionError, "a target isn't held, so it doesn't drift")
    keys = [*(factor_by if factor_by is not None else by), "asset"]
    # One pass, read back: what is checked isn't computed again for the result.
    held, grows = F.col("weight").isNotNull(), F.col("g").isNotNull()
    both = books.select(*books.columns, F.lit(True).alias("_held")).join(factors.withColumn("_grown", F.lit(True)), keys, "full")
    total = F.sum(F.col("weight") * F.col("g")).over(Window.partitionBy(*by))
    grown = saved(both.withColumn("growth", total))
    apart = F.col("_held").isNull() | F.col("_grown").isNull()
    require_none(grown.where(apart | ~held | ~grows), ExecutionError, "books and factors hold different assets")
    require_none(grown.where(~F.coalesce(F.col("growth") > 0, F.lit(False))), ExecutionError, "a book lost all its value")
    weight = F.try_divide(F.col("weight") * F.col("g"), F.col("growth")) + F.lit(0.0)
    return grown.drop("_held", "_grown").withColumn("weight", weight)


def book_violations(books: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows that no book may hold, with what is wrong in ``broken``: a blank asset, a weight that is no number, an asset twice, an unknown state."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by, "asset"))
    state = ~F.coalesce(F.col("state").isin(*STATES), F.lit(False)) if "state" in books.columns else F.lit(False)
    tests = {
        "blank_asset": F.coalesce(F.trim("asset"), F.lit("")) == "",
        "not_finite": F.col("weight").isNull() | F.isnan("weight") | (F.abs("weight") == float("inf")),
        "repeated": n > 1,
        "state": state,
    }
    broken = F.array_compact(F.array(*(F.when(t, F.lit(name)) for name, t in tests.items())))
    return books.withColumn("broken", broken).where(F.size("broken") > 0)


def require_books(books: DataFrame, by: Sequence[str]) -> DataFrame:
    require_none(book_violations(books, by), ExecutionError, "not a book")
    return books


def execute(targets: DataFrame) -> DataFrame:
    """Targets as filled exactly."""
    return targets.withColumn("state", F.lit("POST_TRADE"))


def trade_deltas(pre: DataFrame, target: DataFrame, by: Sequence[str]) -> DataFrame:
    """``delta`` of each asset that either book holds."""
    keys = [*by, "asset"]
    both = pre.select(*keys, F.col("weight").alias("pre")).join(
        target.select(*keys, F.col("weight").alias("target")), keys, "full"
    )
    zero = F.lit(0.0)
    delta = F.coalesce("target", zero) - F.coalesce("pre", zero) + 0.0
    return both.select(*keys, F.coalesce("pre", zero).alias("pre"), F.coalesce("target", zero).alias("target"), delta.alias("delta"))


def turnover(trades: DataFrame, by: Sequence[str], measure: str = "one_way") -> DataFrame:
    """The sum of absolute deltas of each book, or half of it."""
    if measure not in TURNOVERS:
        raise ConfigurationError(f"a turnover is of {TURNOVERS}")
    half = 0.5 if measure == "one_way" else 1.0
    return trades.groupBy(*by).agg((F.lit(half) * F.sum(F.abs("delta"))).alias("turnover"))


def cost_fraction(turnover_: Column, rate: float) -> Column:
    """The share of wealth that a trade costs."""
    if not 0 <= rate < float("inf"):
        raise ConfigurationError("a rate isn't negative")
    return F.lit(rate) * turnover_


def trade_costs(pre: DataFrame, target: DataFrame, by: Sequence[str], rate: float, measure: str = "one_way") -> DataFrame:
    """``turnover, q, f_cost`` of each trade; ``q`` must be below 1."""
    out = turnover(trade_deltas(pre, target, by), by, measure)
    out = out.withColumn("q", cost_fraction(F.col("turnover"), rate)).withColumn("f_cost", 1 - F.col("q"))
    require_none(out.where("q >= 1 OR q < 0"), ExecutionError, "a trade costs all there is")
    return out


def exact_unit_books(books: DataFrame, by: Sequence[str]) -> DataFrame:
    """Books with what they lack of 1 added to their first asset."""
    whole = Window.partitionBy(*by)
    rest = F.lit(1.0) - F.sum("weight").over(whole)
    first = F.row_number().over(whole.orderBy("asset")) == 1
    return books.withColumn("weight", F.when(first, F.col("weight") + rest).otherwise(F.col("weight")))
