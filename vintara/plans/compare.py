"""Comparison tables of strategies: cells with a status, rows with a comparability."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.checks import require_none
from vintara.errors import ComparisonError
from vintara.operators.metrics import METRICS
from vintara.plans.results import strict_json
from vintara.storage import saved

STATUSES = ("ok", "missing_record", "missing_path", "missing_metric")
COMPARABILITY = ("missing_values", "multiple_declaration_sets", "comparable", "declaration_mismatch")
ROLES = ("target", "comparator", "ablation", "robustness", "benchmark")


#: What a value was measured under, in the order in which declarations are sorted.
DECLARATION = ("basis", "periods_per_year", "gamma", "risk_free")


def observations(measured: DataFrame, *, basis: str, periods_per_year: int, gamma: float, risk_free: float, path: str = "main") -> DataFrame:
    """Metrics of a path as rows, each with the declaration it was measured under."""
    return measured.unpivot(["strategy_id"], list(METRICS), "metric", "value").select(
        "strategy_id",
        F.lit(path).alias("path"),
        "metric",
        "value",
        F.struct(
            F.lit(basis).alias("basis"),
            F.lit(periods_per_year).alias("periods_per_year"),
            F.lit(float(gamma)).alias("gamma"),
            F.lit(float(risk_free)).alias("risk_free"),
        ).alias("declaration"),
    )


def cells(arms: DataFrame, metrics: Sequence[str], records: DataFrame, path: str = "main") -> DataFrame:
    """One cell for each arm and metric: ``strategy_id, metric, status, observations``.

    ``arms`` has one row a strategy; ``records`` has ``strategy_id, path, metric, value,
    declaration``, and a row with a null path for a record without any. A cell carries
    the values of all declarations, in their order; none is chosen. Its status says what
    is missing first: the record, the path in it, or the metric on the path (a null value
    counts as none). Values must be finite.
    """
    unknown = set(metrics) - set(METRICS)
    if unknown or not metrics:
        raise ComparisonError(f"metrics are of {METRICS}")
    require_none(
        records.where(F.isnan("value") | (F.abs("value") == float("inf"))), ComparisonError, "a value that isn't finite"
    )
    on_path = records.where(F.col("path") == path)
    known = records.groupBy("strategy_id").agg(F.coalesce(F.bool_or(F.col("path") == path), F.lit(False)).alias("_path"))
    value = F.struct(*(F.col(f"declaration.{d}") for d in DECLARATION), "value")
    found = on_path.where("value IS NOT NULL").groupBy("strategy_id", "metric").agg(F.array_sort(F.collect_list(value)).alias("observations"))
    asked = arms.select("strategy_id", F.explode(F.array(*map(F.lit, metrics))).alias("metric"))
    status = (
        F.when(F.col("_path").isNull(), "missing_record")
        .when(~F.col("_path"), "missing_path")
        .when(F.col("observations").isNull(), "missing_metric")
        .otherwise("ok")
    )
    none = F.array().cast(found.schema["observations"].dataType)
    return (
        asked.join(known, "strategy_id", "left")
        .join(found, ["strategy_id", "metric"], "left")
        .select("strategy_id", "metric", status.alias("status"), F.coalesce("observations", none).alias("observations"))
    )


def comparability(table: DataFrame) -> DataFrame:
    """One row for each metric: whether its cells can be compared, and if not, why.

    In this order: a cell without a value; a cell with values of several declarations;
    declarations that differ between cells.
    """
    one = F.struct(*(F.col("observations")[0][d].alias(d) for d in DECLARATION))
    rows = table.groupBy("metric").agg(
        F.count_if(F.col("status") != "ok").alias("_missing"),
        F.max(F.size("observations")).alias("_most"),
        F.count_distinct(F.when(F.size("observations") > 0, F.to_json(one))).alias("n_declarations"),
    )
    verdict = (
        F.when(F.col("_missing") > 0, "missing_values")
        .when(F.col("_most") > 1, "multiple_declaration_sets")
        .when(F.col("n_declarations") == 1, "comparable")
        .otherwise("declaration_mismatch")
    )
    return rows.select("metric", "n_declarations", verdict.alias("comparability"))


@dataclass(frozen=True)
class ComparisonSpec:
    """Arms by id with their roles, and metrics in order."""

    arms: dict[str, str]
    metrics: tuple[str, ...] = METRICS
    annotations: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        roles = list(self.arms.values())
        if roles.count("target") != 1 or any(r not in ROLES for r in roles):
            raise ComparisonError("a comparison has one target and roles of the vocabulary")
        if any(self.arms.get(a) not in ("comparator", "benchmark") for a in self.annotations):
            raise ComparisonError("only comparators are annotated")
        if len(set(self.metrics)) != len(self.metrics) or not set(self.metrics) <= set(METRICS):
            raise ComparisonError(f"metrics are distinct and of {METRICS}")


#: A value and its declaration: ``basis, periods_per_year, gamma, risk_free, value``.
Observation = tuple[str, int, float, float, float]


@dataclass(frozen=True)
class Cell:
    """One strategy's values of one metric; there are some if and only if the status is ok."""

    strategy_id: str
    status: str
    observations: tuple[Observation, ...] = ()

    def __post_init__(self) -> None:
        if self.status not in STATUSES or (self.status == "ok") != bool(self.observations):
            raise ComparisonError("a cell has values if and only if it is ok")


@dataclass(frozen=True)
class ComparisonTable:
    """A collected comparison: a few arms by a few metrics.

    ``arms`` are ``strategy_id, role, annotation`` by id, ``rows`` are ``metric,
    comparability, cells`` in the order of the declaration.
    """

    arms: tuple[tuple[str, str, str | None], ...]
    rows: tuple[tuple[str, str, tuple[Cell, ...]], ...]

    @classmethod
    def of(cls, spec: ComparisonSpec, records: DataFrame, path: str = "main") -> ComparisonTable:
        arms = records.sparkSession.createDataFrame([(a,) for a in spec.arms], "strategy_id string")
        table = saved(cells(arms, spec.metrics, records, path))
        found = {
            (r["metric"], r["strategy_id"]): Cell(r["strategy_id"], r["status"], tuple(map(tuple, r["observations"])))
            for r in table.collect()
        }
        verdicts = {r["metric"]: r["comparability"] for r in comparability(table).collect()}
        order = sorted(spec.arms)
        return cls(
            tuple((a, spec.arms[a], spec.annotations.get(a)) for a in order),
            tuple((m, verdicts[m], tuple(found[m, a] for a in order)) for m in spec.metrics),
        )

    def to_json(self) -> str:
        rows = [[m, verdict, [[c.strategy_id, c.status, c.observations] for c in some]] for m, verdict, some in self.rows]
        return json.dumps({"arms": self.arms, "rows": rows}, sort_keys=True, separators=(",", ":"), allow_nan=False)

    @classmethod
    def from_json(cls, text: str) -> ComparisonTable:
        data = strict_json(text)
        if not isinstance(data, dict) or set(data) != {"arms", "rows"}:
            raise ComparisonError("not a comparison table")
        rows = tuple(
            (m, verdict, tuple(Cell(a, status, tuple(map(tuple, values))) for a, status, values in some))
            for m, verdict, some in data["rows"]
        )
        names = [a for a, _, _ in data["arms"]]
        if any(v not in COMPARABILITY for _, v, _ in rows) or any([c.strategy_id for c in some] != names for _, _, some in rows):
            raise ComparisonError("not a comparison table")
        return cls(tuple(map(tuple, data["arms"])), rows)

    def render(self) -> str:
        """Aligned plain text; values of several declarations stand side by side."""
        head = ["metric", *(f"{a} ({role}{', ' + note if note else ''})" for a, role, note in self.arms), "comparability"]
        shown = lambda c: " / ".join(f"{o[-1]:.6f}" for o in c.observations) or c.status
        body = [[m, *map(shown, some), verdict] for m, verdict, some in self.rows]
        widths = [max(len(row[i]) for row in [head, *body]) for i in range(len(head))]
        return "\n".join("  ".join(x.ljust(w) for x, w in zip(row, widths)).rstrip() for row in [head, *body])
