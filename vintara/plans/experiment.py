"""Declared experiments: strategies over the same decisions, accounted and measured.

The built-in strategies don't read holdings, so the targets of all decisions are one
query. A strategy that carries state runs once per strategy over its decisions in order,
in a grouped task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintara.checks import require_none, require_same_keys, require_unique
from vintara.errors import LEAKAGE_ERRORS, ConfigurationError, ExecutionError, FutureInformationError
from vintara.operators.ledger import build_ledger
from vintara.operators.metrics import core_metrics
from vintara.operators.portfolio import WeightConstraints, require_targets
from vintara.plans.results import canonical_json, freeze, strict_json
from vintara.storage import saved, small

#: A strategy: windows of returns (``decision_time, asset, t, r``) to ``decision_time, asset, weight``.
Strategy = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Configuration:
    """One target, its comparators, and variants; benchmarks are comparators."""

    target: str
    comparators: tuple[str, ...] = ()
    ablations: tuple[str, ...] = ()
    robustness: tuple[str, ...] = ()
    benchmarks: tuple[str, ...] = ()
    conditions: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        ids = [self.target, *self.comparators, *self.ablations, *self.robustness]
        if len(set(ids)) != len(ids) or any(not i.strip() for i in ids):
            raise ConfigurationError("a strategy has one role")
        if not set(self.benchmarks) <= set(self.comparators):
            raise ConfigurationError("benchmarks are comparators")
        freeze(dict(self.conditions))

    @property
    def strategies(self) -> tuple[str, ...]:
        return tuple(sorted({self.target, *self.comparators, *self.ablations, *self.robustness}))

    def ready_for_comparison(self) -> bool:
        return bool(self.comparators)

    def canonical_text(self) -> str:
        return canonical_json(
            {
                "target": self.target, "comparators": sorted(self.comparators), "ablations": sorted(self.ablations),
                "robustness": sorted(self.robustness), "benchmarks": sorted(self.benchmarks), "conditions": freeze(dict(self.conditions)),
            }
        )

    @classmethod
    def from_canonical_text(cls, text: str) -> Configuration:
        data = strict_json(text)
        made = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})
        if made.canonical_text() != text:
            raise ConfigurationError("not a canonical text")
        return made


def select(config: Configuration, wanted: str | Iterable[str] = "all") -> tuple[str, ...]:
    """All strategies, none, one, or a subset."""
    if wanted == "all":
        return config.strategies
    if wanted == "none":
        return ()
    chosen = (wanted,) if isinstance(wanted, str) else tuple(wanted)
    if not set(chosen) <= set(config.strategies):
        raise ConfigurationError(f"not declared: {sorted(set(chosen) - set(config.strategies))}")
    return tuple(sorted(chosen))


def schedule_violations(schedule: DataFrame) -> DataFrame:
    """Rows of ``decision_time, asset, screening_time, membership_available_time`` out of order."""
    lawful = (F.col("membership_available_time") <= F.col("screening_time")) & (F.col("screening_time") <= F.col("decision_time"))
    return schedule.where(~F.coalesce(lawful, F.lit(False)))


def require_schedule(schedule: DataFrame) -> DataFrame:
    """A schedule whose members are distinct and known at their decision."""
    require_unique(schedule, ["decision_time", "asset"], ConfigurationError, "an asset twice in a universe")
    if "screening_time" in schedule.columns:
        require_none(schedule_violations(schedule), FutureInformationError, "a universe screened late")
    return schedule


def run_stateful(windows: DataFrame, strategy_id: str, step: Callable[[pd.DataFrame, dict], tuple[pd.DataFrame, dict]]) -> DataFrame:
    """A strategy that carries state from decision to decision.

    ``step`` gets one decision's window and the state and returns ``asset, weight`` and the
    next state. One task sees one strategy's windows, in order; a path is sequential.
    """
    schema = "strategy_id string, decision_time timestamp, asset string, weight double"

    def path(frame: pd.DataFrame) -> pd.DataFrame:
        state: dict = {}
        parts = []
        for at, rows in frame.sort_values(["decision_time", "asset", "t"]).groupby("decision_time", sort=True):
            book, state = step(rows, state)
            parts.append(book.assign(strategy_id=strategy_id, decision_time=at))
        found = pd.concat(parts) if parts else pd.DataFrame(columns=["strategy_id", "decision_time", "asset", "weight"])
        return found[["strategy_id", "decision_time", "asset", "weight"]]

    return windows.groupBy(F.lit(strategy_id).alias("_s")).applyInPandas(path, schema)


def targets_of(windows: DataFrame, strategies: Mapping[str, Strategy]) -> DataFrame:
    """The targets of all strategies at all decisions, long."""
    parts = [
        make(windows).select(F.lit(name).alias("strategy_id"), "decision_time", "asset", "weight")
        for name, make in sorted(strategies.items())
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def held(targets: DataFrame, every: int) -> DataFrame:
    """The targets of every ``every``-th decision; between them a book is held."""
    place = F.dense_rank().over(Window.partitionBy("strategy_id").orderBy("decision_time")) - 1
    return targets.withColumn("_p", place).where(F.col("_p") % every == 0).drop("_p")


@dataclass(frozen=True)
class Experiment:
    """Strategies bound to a configuration, and what they are run under."""

    config: Configuration
    strategies: Mapping[str, Strategy]
    constraints: WeightConstraints = WeightConstraints()
    rate: float = 0.0
    turnover: str = "one_way"
    initial_wealth: float = 1.0
    periods_per_year: int = 12
    risk_aversion: float = 1.0
    risk_free: float = 0.0
    rebalance_every: int = 1

    def __post_init__(self) -> None:
        if set(self.strategies) != set(self.config.strategies):
            raise ConfigurationError("strategies aren't those of the configuration")

    def run(self, windows: DataFrame, instants: DataFrame, factors: DataFrame, wanted: str | Sequence[str] = "all") -> tuple[DataFrame, DataFrame]:
        """The ledger and the metrics of the selected strategies.

        ``windows`` are admitted returns of each decision; ``instants`` the accounting
        instants (``instant``), the last of which closes the path; ``factors`` has ``instant,
        asset, g``. The first decision's targets are the opening books.
        """
        names = select(self.config, wanted)
        if not names:
            raise ExecutionError("no strategy is selected")
        targets = saved(targets_of(windows, {n: self.strategies[n] for n in names}))
        require_targets(targets, ["strategy_id", "decision_time"], self.constraints)
        require_same_keys(targets, windows, ["decision_time", "asset"], ExecutionError, "targets and universes differ")
        targets = held(targets, self.rebalance_every)
        bounds = instants.agg(F.max("instant").alias("_last"))
        first = targets.agg(F.min("decision_time").alias("_first"))
        rows = targets.join(F.broadcast(bounds), F.col("decision_time") < F.col("_last")).join(F.broadcast(first), F.lit(True))
        initial = rows.where("decision_time = _first").select("strategy_id", "asset", "weight")
        decisions = rows.where("decision_time > _first").select("strategy_id", F.col("decision_time").alias("execution_time"), "asset", "weight")
        at = instants.join(F.broadcast(first), F.col("instant") >= F.col("_first")).select("instant")
        paths = targets.select("strategy_id").distinct().join(small(at), F.lit(True))
        ledger = saved(build_ledger(initial, paths, decisions, factors, self.rate, self.turnover, self.initial_wealth))
        return ledger, core_metrics(ledger, self.periods_per_year, self.risk_aversion, self.risk_free)


@dataclass(frozen=True)
class LeakageFinding:
    name: str
    blocked: bool
    error_type: str
    detail: str


def run_leakage_cases(cases: Mapping[str, tuple[Callable[[], object], type[Exception]]]) -> list[LeakageFinding]:
    """Attempts that must fail with one of the leakage errors, and how they ended."""
    found = []
    for name, (attempt, expected) in cases.items():
        if expected not in LEAKAGE_ERRORS:
            raise ConfigurationError(f"{expected.__name__} is no leakage error")
        try:
            attempt()
            found.append(LeakageFinding(name, False, "", "nothing was raised"))
        except Exception as error:  # every outcome is a finding
            found.append(LeakageFinding(name, type(error) is expected, type(error).__name__, str(error)[:200]))
    return found
