"""Temporal protocols: partitions, histories, refits; fitting plans and their provenance.

Declarations are small and live on the driver; what they resolve to are a few instants. The
instants of records may be many: those are DataFrames.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.checks import require_none
from vintara.errors import (
    FutureInformationError,
    PlanStructureError,
    ProtocolStructureError,
    ProtocolVocabularyError,
    ProvenanceStructureError,
    ScheduleStructureError,
)
from vintara.functions.calendar import evaluation_span, require_instant

# Closed vocabularies.
ROLES = ("development", "selection", "evaluation")
KINDS = ("initial_fit", "refit", "selection")
MODES, BASES = ("ROLLING", "EXPANDING"), ("CALENDAR", "OBSERVATIONS")
LEARNING = ("FIXED_ORIGIN", "WALK_FORWARD")
DETERMINISM = ("deterministic", "seeded", "nondeterministic")
CADENCES = {"monthly": 1, "quarterly": 3, "annual": 12, "none": 0}


def _one_of(value: str, allowed: Sequence[str], what: str) -> None:
    if value not in allowed:
        raise ProtocolVocabularyError(f"{what} is of {tuple(allowed)}; got {value!r}")


@dataclass(frozen=True)
class Window:
    """How much history a fit may use."""

    basis: str
    length: int
    mode: str

    def __post_init__(self) -> None:
        _one_of(self.basis, BASES, "a basis")
        _one_of(self.mode, MODES, "a mode")
        if not isinstance(self.length, int) or isinstance(self.length, bool) or self.length < 1:
            raise ProtocolStructureError("a window's length is a positive whole number")

    def start(self, cutoff: datetime, instants: Sequence[datetime] = ()) -> datetime | None:
        """Where the window begins: months before the cutoff, or the n-th latest instant."""
        if self.basis == "CALENDAR":
            return shift_months(cutoff, -self.length)
        seen = sorted(t for t in instants if t <= cutoff)
        return seen[-self.length] if len(seen) >= self.length else None


def window(*, years: int = 0, months: int = 0, observations: int = 0, mode: str = "ROLLING") -> Window:
    """A window of exactly one kind of length."""
    given = [x for x in (years, months, observations) if x]
    if len(given) != 1:
        raise ProtocolStructureError("give one of years, months, observations")
    if observations:
        return Window("OBSERVATIONS", observations, mode)
    return Window("CALENDAR", years * 12 + months, mode)


def shift_months(moment: datetime, months: int) -> datetime:
    """Months later, the day clamped to the month's last."""
    year, month = divmod(moment.year * 12 + moment.month - 1 + months, 12)
    following = datetime(year + (month == 11), (month + 1) % 12 + 1, 1)
    last = (following - timedelta(days=1)).day
    return moment.replace(year=year, month=month + 1, day=min(moment.day, last))


def month_end_before(span_start: datetime, months: int, tz: str) -> datetime:
    """The month end just before a span's start moved by months."""
    local = shift_months(span_start.astimezone(ZoneInfo(tz)), months) - timedelta(microseconds=1)
    first = shift_months(local.replace(day=1, hour=0, minute=0, second=0, microsecond=0), 1)
    return (first - timedelta(microseconds=1)).astimezone(ZoneInfo("UTC"))


@dataclass(frozen=True)
class Partition:
    role: str
    start: datetime
    end: datetime

    def __post_init__(self) -> None:
        _one_of(self.role, ROLES, "a role")
        if require_instant(self.start, "start") >= require_instant(self.end, "end"):
            raise ProtocolStructureError("a partition ends after it starts")


@dataclass(frozen=True)
class FitEvent:
    kind: str
    role: str
    cutoff: datetime

    def __post_init__(self) -> None:
        _one_of(self.kind, KINDS, "a kind")
        _one_of(self.role, ROLES, "a role")
        require_instant(self.cutoff, "cutoff")


@dataclass(frozen=True)
class Protocol:
    """Partitions in order, and the fits within them."""

    partitions: tuple[Partition, ...]
    events: tuple[FitEvent, ...]
    estimation: Window | None = None
    selection: Window | None = None
    learning: str = "WALK_FORWARD"

    def __post_init__(self) -> None:
        _one_of(self.learning, LEARNING, "learning")
        for a, b in zip(self.partitions, self.partitions[1:]):
            if b.start < a.end:
                raise ProtocolStructureError("partitions overlap or aren't in order")
        keys = [(e.cutoff, e.kind, e.role) for e in self.events]
        if keys != sorted(set(keys)):
            raise ProtocolStructureError("fit events are sorted and distinct")
        spans = [p for p in self.partitions if p.role == "evaluation"]
        for e in self.events:
            if not any(p.start <= e.cutoff <= p.end for p in self.partitions):
                raise ProtocolStructureError(f"a fit event in no partition: {e.cutoff}")
            if e.kind == "refit" and self.learning == "FIXED_ORIGIN" and any(p.start <= e.cutoff <= p.end for p in spans):
                raise ProtocolStructureError("a fixed origin has no refits in its evaluation")


@dataclass(frozen=True)
class Design:
    """The ordinary declaration: an evaluation span and a cadence of refits."""

    evaluation: str
    estimation: Window | None = None
    selection: Window | None = None
    refit: str = "none"
    learning: str = "WALK_FORWARD"
    tz: str = "UTC"

    def __post_init__(self) -> None:
        _one_of(self.refit, tuple(CADENCES), "a cadence")
        if self.learning == "FIXED_ORIGIN" and self.refit != "none":
            raise ProtocolStructureError("a fixed origin isn't refitted")

    def resolve(self) -> Protocol:
        """The initial fit at the last month end before the span, then refits by the cadence."""
        start, end = evaluation_span(self.evaluation, self.tz)
        step = CADENCES[self.refit] or 12
        events = [FitEvent("initial_fit", "development", month_end_before(start, 0, self.tz))]
        if self.selection is not None:
            events.append(FitEvent("selection", "selection", month_end_before(start, 0, self.tz)))
        at = step
        while CADENCES[self.refit] and (cutoff := month_end_before(start, at, self.tz)) <= end.astimezone(ZoneInfo("UTC")):
            events.append(FitEvent("refit", "evaluation", cutoff))
            at += step
        history = max((w.length for w in (self.estimation, self.selection) if w and w.basis == "CALENDAR"), default=12)
        parts = (Partition("development", shift_months(start, -history), start), Partition("evaluation", start, end))
        return Protocol(parts, tuple(sorted(events, key=lambda e: (e.cutoff, e.kind, e.role))), self.estimation, self.selection, self.learning)


@dataclass(frozen=True)
class Override:
    """What one strategy declares otherwise; None keeps the common value."""

    estimation: Window | None = None
    selection: Window | None = None
    refit: str | None = None


def resolve_protocols(common: Design, names: Sequence[str], overrides: Mapping[str, Override] = {}) -> dict[str, Protocol]:
    """Each strategy's protocol; overrides are sparse and of known strategies."""
    unknown = set(overrides) - set(names)
    if unknown or len(set(names)) != len(names):
        raise ProtocolStructureError(f"overrides of no strategy: {sorted(unknown)}, or a strategy twice")
    out = {}
    for name in names:
        own = overrides.get(name, Override())
        changes = {k: v for k, v in (("estimation", own.estimation), ("selection", own.selection), ("refit", own.refit)) if v is not None}
        out[name] = replace(common, **changes).resolve()
    return out


def events_frame(spark, protocols: Mapping[str, Protocol]) -> DataFrame:
    """``strategy_id, kind, role, cutoff`` of all protocols."""
    rows = [(s, e.kind, e.role, e.cutoff) for s, p in protocols.items() for e in p.events]
    return spark.createDataFrame(rows, "strategy_id string, kind string, role string, cutoff timestamp")


def events_outside(events: DataFrame, partitions: DataFrame) -> DataFrame:
    """Events whose cutoff lies in no partition of their strategy (closed intervals)."""
    within = (F.col("e.cutoff") >= F.col("p.start")) & (F.col("e.cutoff") <= F.col("p.end"))
    return events.alias("e").join(partitions.alias("p"), (F.col("e.strategy_id") == F.col("p.strategy_id")) & within, "left_anti")


def require_first_decision(observations: DataFrame, protocol: Protocol) -> None:
    """Enough history before the first fit for the declared estimation window."""
    if protocol.estimation is None or not protocol.events:
        return
    cutoff = F.lit(protocol.events[0].cutoff)
    seen = observations.where(F.col("available_time") <= cutoff)
    if protocol.estimation.basis == "OBSERVATIONS":
        n = seen.select("observation_time").distinct().count()
        if n < protocol.estimation.length:
            raise ProtocolStructureError(f"{n} instants before the first fit; {protocol.estimation.length} are declared")
        return
    first = seen.agg(F.min("observation_time").alias("first")).first()["first"]
    start = protocol.estimation.start(protocol.events[0].cutoff)
    if first is None or first.replace(tzinfo=ZoneInfo("UTC")) > start:
        raise ProtocolStructureError("history begins after the declared window")


# Fitting.


def config_digest(config) -> str:
    """A digest in which values of different types differ."""

    def tagged(value) -> str:
        if value is None:
            return "n"
        if isinstance(value, bool):
            return f"b{int(value)}"
        if isinstance(value, int):
            return f"i{value}"
        if isinstance(value, float):
            if not math.isfinite(value):
                raise PlanStructureError("numbers are finite")
            return f"f{(value + 0.0).hex()}"
        if isinstance(value, str):
            return f"s{len(value)}:{value}"
        if isinstance(value, (list, tuple)):
            return "l(" + ",".join(map(tagged, value)) + ")"
        if isinstance(value, Mapping):
            return "m(" + ",".join(f"{tagged(k)}={tagged(v)}" for k, v in sorted(value.items())) + ")"
        raise PlanStructureError(f"no setting: {value!r}")

    return hashlib.sha256(tagged(config).encode()).hexdigest()


@dataclass(frozen=True)
class FittingPlan:
    """What is fitted, with which settings, and how far it repeats."""

    model: str
    config: Mapping[str, object]
    seed: int | None = None
    determinism: str = "deterministic"

    def __post_init__(self) -> None:
        if self.determinism not in DETERMINISM or not self.model.strip():
            raise PlanStructureError("a plan names its model and how far it repeats")
        if (self.determinism == "seeded") != (self.seed is not None):
            raise PlanStructureError("a seeded plan has a seed, and no other")

    @property
    def digest(self) -> str:
        return config_digest({"model": self.model, "config": dict(self.config), "seed": self.seed, "determinism": self.determinism})


@dataclass(frozen=True)
class RefitSchedule:
    instants: tuple[datetime, ...]

    def __post_init__(self) -> None:
        at = [require_instant(t, "refit") for t in self.instants]
        if any(b <= a for a, b in zip(at, at[1:])):
            raise ScheduleStructureError("refits strictly increase")

    def latest(self, decision: datetime) -> datetime | None:
        return max((t for t in self.instants if t <= decision), default=None)


@dataclass(frozen=True)
class FitProvenance:
    """Which plan was fitted on what was known when."""

    plan_digest: str
    cutoff: datetime
    n_records: int
    wrapped: str = ""
    extra: Mapping[str, str] = field(default_factory=dict)


def fit_provenance(plan: FittingPlan, fit_set: DataFrame, cutoff: datetime, wrapped: str = "") -> FitProvenance:
    """The provenance of a fit; its inputs must have been available at the cutoff."""
    at = require_instant(cutoff, "cutoff")
    require_none(fit_set.where(F.col("available_time") > F.lit(at)), FutureInformationError, "a fit used later information")
    return FitProvenance(plan.digest, at, fit_set.count(), wrapped)


def match_fits(protocols: Mapping[str, Protocol], provenances: Mapping[str, Sequence[FitProvenance]]) -> None:
    """Each strategy's fits one to one with its protocol's fit events, cutoff for cutoff."""
    for name, protocol in protocols.items():
        due = sorted(e.cutoff for e in protocol.events if e.kind != "selection")
        have = sorted(p.cutoff for p in provenances.get(name, ()))
        if provenances.get(name) is not None and due != have:
            raise ProvenanceStructureError(f"{name}: fits at {have}, events at {due}")


def require_reproducible(first: DataFrame, second: DataFrame) -> None:
    """Two runs of a fitted forecaster must give the same rows."""
    other = second.select(*first.columns)
    require_none(first.exceptAll(other).unionByName(other.exceptAll(first)), PlanStructureError, "runs differ")


def require_selection_labels(labels: DataFrame, origin: datetime) -> DataFrame:
    """Labels used for selection must be available at its origin."""
    at = F.lit(require_instant(origin, "origin"))
    require_none(labels.where(F.col("available_time") > at), FutureInformationError, "a label after the origin")
    return labels
