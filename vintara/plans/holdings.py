"""Runs of strategies that see what they hold.

A strategy that decides by its book can't be one query over all decisions: what it holds
before a trade is what its trades so far have drifted to. Such a path is sequential, but a
task needs one decision at a time: each strategy's decisions are streamed in order, and between
two batches only the book and the strategy's state are kept. Strategies run side by side. All that
doesn't depend on the book (universes, features, forecasts, growth) is joined before, by Spark.

The targets that come out are accounted by the ledger, which is closed form again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.checks import require_none, require_same_keys, require_unique
from vintara.errors import LEAKAGE_ERRORS, ConfigurationError, ExecutionError
from vintara.operators.ledger import CostModel, build_ledger
from vintara.operators.metrics import core_metrics
from vintara.operators.portfolio import WeightConstraints, require_targets
from vintara.storage import saved, small

#: What Spark gives of a time zone's instants in Arrow.
_UTC = "UTC"


@dataclass(frozen=True)
class Context:
    """What a strategy decides from: all of it is known at ``decision_time``.

    ``book`` is what is held before the trade, ``rows`` has the decision's columns by name, one
    value for each asset of ``universe``, forecasts among them. ``state`` is what the strategy returned before.
    """

    strategy_id: str
    decision_time: datetime
    universe: tuple[str, ...]
    book: Mapping[str, float]
    rows: Mapping[str, list]
    state: object
    last_rebalance: datetime


@dataclass(frozen=True)
class Decision:
    """The target of each asset of the universe, and the state for the next decision."""

    weights: Mapping[str, float]
    state: object = None


#: A strategy. None holds the book as it is, and leaves the state.
Decide = Callable[[Context], "Decision | None"]
#: Whether to decide at an instant, given that of the last decision that was executed.
Policy = Callable[[datetime, datetime], bool]
#: The book after a trade, from the context and the target.
Engine = Callable[[Context, Mapping[str, float]], Mapping[str, float]]


def exact_fill(context: Context, target: Mapping[str, float]) -> Mapping[str, float]:
    """The target, as it is."""
    return target


def every(days: float) -> Policy:
    """A decision whenever so many days have passed since the last."""
    return lambda now, last: now - last >= timedelta(days=days)


@dataclass(frozen=True)
class Opening:
    """What is held, and what it is worth, before the first decision: ``weights`` has ``asset, weight``."""

    weights: DataFrame
    wealth: float = 1.0
    last_rebalance: datetime | None = None


def require_opening(opening: Opening, universe: DataFrame) -> Opening:
    """``opening``, if it covers the first universe exactly, sums to 1 and isn't later than its decision."""
    if not 0 < opening.wealth < float("inf"):
        raise ExecutionError("an opening wealth is positive")
    first = universe.agg(F.min("decision_time").alias("decision_time"))
    require_unique(opening.weights, ["asset"], ExecutionError, "an asset twice in the opening book")
    of_first = universe.join(F.broadcast(first), "decision_time", "left_semi").select("asset")
    require_same_keys(opening.weights, of_first, ["asset"], ExecutionError, "the opening book isn't that of the first universe")
    total = opening.weights.agg(F.sum("weight").alias("total"))
    require_none(total.where("total IS NULL OR NOT abs(total - 1) <= 1e-9"), ExecutionError, "the opening book isn't a unit book")
    if opening.last_rebalance is not None:
        late = first.where(F.lit(opening.last_rebalance) > F.col("decision_time"))
        require_none(late, ExecutionError, "the last trade before the opening is later than the first decision")
    return opening


def require_outcomes(outcomes: DataFrame, universe: DataFrame) -> DataFrame:
    """``outcomes`` (``decision_time, asset, g``), if they cover each universe but the last exactly, each asset once, no ``g`` negative."""
    require_unique(outcomes, ["decision_time", "asset"], ExecutionError, "an outcome twice")
    last = universe.agg(F.max("decision_time").alias("_last"))
    due = universe.join(F.broadcast(last), F.col("decision_time") < F.col("_last")).select("decision_time", "asset")
    have = outcomes.join(F.broadcast(last), F.col("decision_time") < F.col("_last")).select("decision_time", "asset")
    require_same_keys(have, due, ["decision_time", "asset"], ExecutionError, "outcomes and universes differ")
    unlawful = "g IS NULL OR isnan(g) OR g < 0 OR g = double('infinity')"
    require_none(outcomes.where(unlawful), ExecutionError, "growth is a number that isn't negative")
    return outcomes


@dataclass(frozen=True)
class HoldingRun:
    """Strategies that see their book, and what they are run under.

    ``delay`` is the time from a decision to its execution, the same for all. ``policy`` is asked once a date
    and binds all strategies alike; without one every date is a decision.
    """

    strategies: Mapping[str, Decide]
    constraints: WeightConstraints = WeightConstraints()
    policy: Policy | None = None
    engine: Engine = exact_fill
    delay: timedelta = timedelta(0)
    rate: float = 0.0
    turnover: str = "one_way"
    costs: CostModel | None = None
    settings: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.strategies or any(not s.strip() for s in self.strategies):
            raise ConfigurationError("a run has strategies with names")
        if self.delay < timedelta(0):
            raise ConfigurationError("an execution isn't before its decision")

    def decide(self, universe: DataFrame, outcomes: DataFrame, opening: Opening, features: Sequence[DataFrame] = ()) -> DataFrame:
        """``strategy_id, decision_time, execution_time, asset, pre, target, post, traded`` of all dates.

        ``universe`` has ``decision_time, asset``; ``outcomes`` ``decision_time, asset, g``, growth from a date to the
        next; each of ``features`` ``decision_time, asset`` and columns that the strategies read. ``pre`` is the drifted book, ``target`` null
        where a book is held. The first error ends the run.
        """
        require_unique(universe, ["decision_time", "asset"], ConfigurationError, "an asset twice in a universe")
        require_opening(opening, universe)
        require_outcomes(outcomes, universe)
        rows = universe.select("decision_time", "asset").join(outcomes.select("decision_time", "asset", "g"), ["decision_time", "asset"], "left")
        for more in features:
            require_unique(more, ["decision_time", "asset"], ConfigurationError, "a feature twice for an asset")
            rows = rows.join(more, ["decision_time", "asset"], "left")
        rows = rows.join(opening.weights.select("asset", F.col("weight").alias("_opening")), "asset", "left")
        names = sorted(self.strategies)
        rows = rows.withColumn("strategy_id", F.explode(F.array(*map(F.lit, names))))
        ordered = rows.repartition(len(names), "strategy_id").sortWithinPartitions("strategy_id", "decision_time", "asset")
        found = saved(ordered.mapInArrow(_walk(self, opening.last_rebalance), _SCHEMA))
        _raise_first(found)
        apart = "target IS NOT NULL AND NOT target <=> post"
        require_none(found.where(apart), ExecutionError, "an accounting engine that doesn't fill the target exactly")
        targets = found.where("traded").select("strategy_id", "decision_time", "asset", F.col("target").alias("weight"))
        require_targets(targets, ["strategy_id", "decision_time"], self.constraints)
        return found.drop("problem", "kind")

    def run(
        self, universe: DataFrame, outcomes: DataFrame, opening: Opening, features: Sequence[DataFrame] = (),
        periods_per_year: int = 12, risk_aversion: float = 1.0, risk_free: float = 0.0,
    ) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The decisions, the ledger from the opening book and wealth on, and its measures.

        What is decided at the last date isn't executed on the path.
        """
        decided = self.decide(universe, outcomes, opening, features)
        dates = universe.select(F.col("decision_time").alias("instant")).distinct()
        strategies = decided.select("strategy_id").distinct()
        last = dates.agg(F.max("instant").alias("_last"))
        traded = decided.where("traded").join(F.broadcast(last), F.col("execution_time") < F.col("_last"))
        traded = traded.select("strategy_id", "execution_time", "asset", F.col("target").alias("weight"))
        ledger = saved(
            build_ledger(
                strategies.join(small(opening.weights.select("asset", "weight")), F.lit(True)),
                strategies.join(small(dates), F.lit(True)),
                traded,
                outcomes.select(F.col("decision_time").alias("instant"), "asset", "g"),
                self.rate,
                self.turnover,
                opening.wealth,
                costs=self.costs,
            )
        )
        return decided, ledger, core_metrics(ledger, periods_per_year, risk_aversion, risk_free)


_SCHEMA = (
    "strategy_id string, decision_time timestamp, execution_time timestamp, asset string, pre double, target double, post double, "
    "traded boolean, problem string, kind string"
)
_INSTANT = pa.timestamp("us", tz=_UTC)
_ARROW = pa.schema(
    [
        ("strategy_id", pa.string()), ("decision_time", _INSTANT), ("execution_time", _INSTANT), ("asset", pa.string()),
        ("pre", pa.float64()), ("target", pa.float64()), ("post", pa.float64()), ("traded", pa.bool_()), ("problem", pa.string()), ("kind", pa.string()),
    ]
)
#: Rows of one block of results, about.
_BLOCK = 10_000


def _dates(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, datetime, dict[str, list]]]:
    """One strategy's columns at one date after the other; a date may span batches."""
    key, held = None, {}
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        strategies, dates = columns.pop("strategy_id"), columns.pop("decision_time")
        start, n = 0, batch.num_rows
        while start < n:
            end = start
            now = (strategies[start], dates[start])
            while end < n and (strategies[end], dates[end]) == now:
                end += 1
            part = {name: values[start:end] for name, values in columns.items()}
            if now == key:
                held = {name: held[name] + values for name, values in part.items()}
            else:
                if key:
                    yield *key, held
                key, held = now, part
            start = end
    if key:
        yield *key, held


class _Path:
    """One strategy on its way: its book, its state, and when it traded last."""

    def __init__(self, run: HoldingRun, strategy_id: str, book: dict[str, float], last: datetime):
        self.run, self.strategy_id, self.book, self.last = run, strategy_id, book, last
        self.state: object = None

    def step(self, at: datetime, columns: dict[str, list]) -> Iterator[tuple]:
        """The rows of one date; the book is drifted to the next."""
        assets, growth = columns["asset"], columns["g"]
        pre, decided, post = self.book, None, self.book
        if self.run.policy is None or self.run.policy(at, self.last):
            rows = {k: v for k, v in columns.items() if k not in ("g", "_opening")}
            context = Context(self.strategy_id, at, tuple(assets), dict(pre), rows, self.state, self.last)
            decided = self.run.strategies[self.strategy_id](context)
            self.last = at + self.run.delay  # as the policy's answer binds all strategies, so does its instant
            if decided is not None:
                if set(decided.weights) != set(assets):
                    raise ExecutionError("a target has a weight for each asset of the universe")
                post = dict(self.run.engine(context, decided.weights))
                self.state = decided.state
        for asset in sorted({*pre, *post}):
            target = None if decided is None else float(decided.weights.get(asset, 0.0))
            yield (self.strategy_id, at, at + self.run.delay, asset, pre.get(asset, 0.0), target, post.get(asset, 0.0), decided is not None, None, None)
        if all(g is None for g in growth):  # the last date
            return
        if set(post) != set(assets):
            raise ExecutionError("books and factors hold different assets")
        values = {a: post[a] * g for a, g in zip(assets, growth)}
        total = sum(values.values())
        if not total > 0:
            raise ExecutionError("a book lost all its value")
        self.book = {a: v / total for a, v in values.items()}


def _walk(run: HoldingRun, last: datetime | None):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, failed = None, None
        out: list[tuple] = []
        for strategy_id, at, columns in _dates(batches):
            if strategy_id == failed:
                continue
            if path is None or path.strategy_id != strategy_id:
                book = {a: w for a, w in zip(columns["asset"], columns["_opening"])}
                path = _Path(run, strategy_id, book, at if last is None else last.astimezone(at.tzinfo))
            try:
                out.extend(path.step(at, columns))
            except Exception as error:  # the driver raises it
                out.append((strategy_id, at, at, None, None, None, None, False, str(error)[:500], type(error).__name__))
                failed = strategy_id
            if len(out) >= _BLOCK:
                yield _block(out)
                out = []
        yield _block(out)

    return walk


def _block(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _raise_first(found: DataFrame) -> None:
    """Raises a run's first error: a leakage error as itself, any other as an :class:`ExecutionError`."""
    first = found.where("problem IS NOT NULL").orderBy("decision_time", "strategy_id").first()
    if first:
        kinds = {kind.__name__: kind for kind in LEAKAGE_ERRORS}
        message = f"{first['strategy_id']} at {first['decision_time']}: {first['problem']}"
        raise kinds.get(first["kind"], ExecutionError)(message)
