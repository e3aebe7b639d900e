"""Forecasters fitted on events: least squares from sums that add up, for all events in one pass.

A regression needs a few sums of products, and these add up over any parts of the rows. Rows
fall into the intervals between the instants at which events cut off or begin; each interval is summed
once, intervals are run up in order, and an event's sums are those at its cutoff less those at its
beginning. So expanding and rolling fits of all events cost one pass over the rows, whatever their number, and
a series of any length is spread over tasks (:mod:`vintara.operators.buckets`).

Rows are long: one row for each case of a series, with its label and regressors, and
``available_time``, when all of them were known.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.checks import require_none, require_unique
from vintara.errors import ConfigurationError, ExecutionError, FutureInformationError, InvalidChronologyError
from vintara.operators.buckets import running
from vintara.operators.pit import as_of
from vintara.storage import small


def require_events(events: DataFrame) -> DataFrame:
    """``events`` (``fit_id, cutoff, window_start``), each once and beginning before it ends; a null start is that of all rows."""
    require_unique(events, ["fit_id"], ConfigurationError, "a fit twice")
    require_none(events.where("fit_id IS NULL OR cutoff IS NULL"), ConfigurationError, "a fit without a name or a cutoff")
    require_none(events.where("window_start >= cutoff"), InvalidChronologyError, "a fit that begins after its cutoff")
    return events


def fit_input_violations(records: DataFrame, events: DataFrame) -> DataFrame:
    """``fit_id, kind, n``: what fits may not have been given, of all events at once.

    ``records`` has ``fit_id, available_time`` and may have ``asserted_cutoff``. Kinds: ``late``, available after the fit's
    cutoff; ``cutoff``, another cutoff asserted than the event's; ``unknown``, of no event; ``empty``, an event without records.
    """
    both = records.join(small(events.select("fit_id", "cutoff")), "fit_id", "full").withColumn("_known", F.col("cutoff").isNotNull())
    known = F.col("_known") & F.col("available_time").isNotNull()
    tests = {
        "late": known & (F.col("available_time") > F.col("cutoff")),
        "unknown": ~F.col("_known"),
        "empty": F.col("_known") & F.col("available_time").isNull(),
    }
    if "asserted_cutoff" in records.columns:
        tests["cutoff"] = known & ~F.col("asserted_cutoff").eqNullSafe(F.col("cutoff"))
    counted = both.groupBy("fit_id").agg(*(F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()))
    kinds = F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), F.col(n).alias("n")) for n in tests)))
    return counted.select("fit_id", kinds.alias("_k")).select("fit_id", "_k.kind", "_k.n").where("n > 0")


def require_fit_inputs(records: DataFrame, events: DataFrame) -> DataFrame:
    """``records``, if each fit was given only what was available at its cutoff, and all fits something."""
    found = fit_input_violations(records, events)
    require_none(found.where("kind = 'late'"), FutureInformationError, "a fit was given what came after its cutoff")
    require_none(found.where("kind <> 'late'"), ExecutionError, "records and fit events differ")
    return records


def fit_sums(rows: DataFrame, events: DataFrame, regressors: Sequence[str], label: str = "y", by: str = "asset") -> DataFrame:
    """``fit_id, cutoff, by, n`` and sums of the rows available in ``(window_start, cutoff]``, for each event and series.

    Values are taken from the series' means first, ``_mean_...``, so that differences of sums keep their digits;
    a regression doesn't depend on it. Rows with a null in any column used are left out. Series without rows in an event have none.
    """
    names = [*regressors, label]
    known = rows.select(F.col(by), F.col("available_time").alias("_at"), *(F.col(c).cast("double").alias(c) for c in names)).dropna()
    means = known.groupBy(by).agg(*(F.avg(c).alias(f"_mean_{c}") for c in names))
    known = known.join(small(means), by)
    parts = {"n": F.lit(1.0)}
    parts |= {f"_s_{c}": F.col(c) - F.col(f"_mean_{c}") for c in names}
    parts |= {f"_p_{a}_{b}": (F.col(a) - F.col(f"_mean_{a}")) * (F.col(b) - F.col(f"_mean_{b}")) for a, b in combinations_with_replacement(names, 2)}
    bounds = events.select(F.explode(F.array("cutoff", "window_start")).alias("_at")).dropna().distinct()
    # As many rows as the answer has at most: a bound of each series.
    asked = bounds.join(small(means.select(by)), F.lit(True)).select(by, "_at")
    none = {c: F.lit(None).cast("double") for c in parts}
    points = known.select(by, "_at", F.lit(0).alias("_asks"), *(c.alias(n) for n, c in parts.items())).unionByName(
        asked.select(by, "_at", F.lit(1).alias("_asks"), *(c.alias(n) for n, c in none.items()))
    )
    # A row's interval is the number of bounds before it; at the same instant rows come first.
    placed = running(points, [by], ["_at", "_asks"], {"_interval": ("count", F.when(F.col("_asks") == 1, 1))})
    intervals = placed.where("_asks = 0").groupBy(by, "_interval").agg(*(F.sum(n).alias(n) for n in parts))
    steps = intervals.select(by, "_interval", F.lit(1).alias("_asks"), F.lit(None).cast("timestamp").alias("_at"), *parts).unionByName(
        placed.where("_asks = 1").select(by, "_interval", F.lit(0).alias("_asks"), "_at", *parts)
    )
    upto = running(steps, [by], ["_interval", "_asks"], {f"_upto_{n}": ("sum", F.col(n)) for n in parts})
    upto = upto.where("_asks = 0").select(by, "_at", *(F.coalesce(f"_upto_{n}", F.lit(0.0)).alias(n) for n in parts))
    end = events.select("fit_id", F.col("cutoff").alias("_at"), "window_start").join(upto, "_at")
    start = upto.select(by, F.col("_at").alias("window_start"), *(F.col(n).alias(f"_less_{n}") for n in parts))
    both = end.join(start, ["window_start", by], "left")
    found = both.select(
        "fit_id", F.col("_at").alias("cutoff"), by, *((F.col(n) - F.coalesce(f"_less_{n}", F.lit(0.0))).alias(n) for n in parts)
    ).withColumn("n", F.round("n").cast("long"))
    return found.where("n > 0").join(small(means), by)


#: How far a system's determinant may fall, its regressors scaled to 1, before it counts as singular.
SINGULAR = 1e-12


def fit_least_squares(rows: DataFrame, events: DataFrame, regressors: Sequence[str], label: str = "y", by: str = "asset") -> DataFrame:
    """``fit_id, cutoff, by, n, intercept, coefficients, residual_variance, status`` of each event and series.

    Least squares with an intercept over the rows of :func:`fit_sums`. ``status`` is ``ok``, or ``undefined`` where there are too few rows
    or the regressors depend on each other; then there are no coefficients. ``residual_variance`` is of ``n - p - 1`` degrees of freedom, null if none.
    """
    require_events(events)
    sums = fit_sums(rows, events, regressors, label, by)
    p, names = len(regressors), [*regressors, label]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
            n = number("n")
            s = np.stack([number(f"_s_{c}") for c in names], axis=1) if len(n) else np.empty((0, p + 1))
            centred = np.empty((len(n), p + 1, p + 1))
            for (i, a), (j, b) in combinations_with_replacement(enumerate(names), 2):
                centred[:, i, j] = centred[:, j, i] = number(f"_p_{a}_{b}") - s[:, i] * s[:, j] / n
            scale = np.sqrt(np.clip(np.einsum("kii->ki", centred)[:, :p], 0, None))
            with np.errstate(divide="ignore", invalid="ignore"):
                unit = centred[:, :p, :p] / (scale[:, :, None] * scale[:, None, :])
            # Rows without spread have no scale; a fit with as many rows as coefficients is exact.
            fine = (n > p) & (scale > 0).all(axis=1)
            fine[fine] = np.linalg.det(unit[fine]) > SINGULAR
            slopes = np.full((len(n), p), np.nan)
            slopes[fine] = np.linalg.solve(centred[fine, :p, :p], centred[fine, :p, p][:, :, None])[:, :, 0]
            means = np.stack([number(f"_mean_{c}") for c in names], axis=1) + s / n[:, None] if len(n) else s
            intercept = means[:, p] - (slopes * means[:, :p]).sum(axis=1)
            left = centred[:, p, p] - (slopes * centred[:, :p, p]).sum(axis=1)
            free = n - p - 1
            variance = np.where(free > 0, np.clip(left, 0, None) / np.where(free > 0, free, 1), np.nan)
            plain = lambda x: pa.array(x, pa.float64(), from_pandas=True)
            listed = pa.array([list(row) if ok else None for row, ok in zip(slopes, fine)], pa.list_(pa.float64()))
            status = pa.array(np.where(fine, "ok", "undefined").tolist(), pa.string())
            kept = [batch.column(c) for c in ("fit_id", "cutoff", by, "n")]
            names_out = ["fit_id", "cutoff", by, "n", "intercept", "coefficients", "residual_variance", "status"]
            yield pa.RecordBatch.from_arrays([*kept, plain(intercept), listed, plain(np.where(fine, variance, np.nan)), status], names=names_out)

    types = dict(sums.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in ("fit_id", "cutoff", by, "n"))
    return sums.mapInArrow(solve, f"{schema}, intercept double, coefficients array<double>, residual_variance double, status string")


def latest_forecasts(models: DataFrame, features: DataFrame, decisions: DataFrame, regressors: Sequence[str], by: str = "asset") -> DataFrame:
    """``decision_time, by, fit_id, produced_at, expected_return``: each decision's forecasts by its latest fit.

    ``features`` has ``by, observation_time, available_time`` and the regressors; a decision takes the newest period
    that it may know. A forecast is produced when its fit and its features are there, which is never after the
    decision. Series without a defined fit or without features have none.
    """
    fits = models.where("status = 'ok'").select(
        F.col(by).alias("series_id"), F.col("cutoff").alias("observation_time"), F.col("cutoff").alias("available_time"), "fit_id", "intercept", "coefficients"
    )
    seen = features.select(F.col(by).alias("series_id"), "observation_time", "available_time", *regressors).dropna()
    fit = as_of(fits, decisions, value=("fit_id", "intercept", "coefficients")).withColumnRenamed("available_time", "_fitted").drop("observation_time")
    now = as_of(seen, decisions, value=tuple(regressors)).withColumnRenamed("available_time", "_seen").drop("observation_time")
    sums = [F.element_at("coefficients", i + 1) * F.col(c) for i, c in enumerate(regressors)]
    value = F.col("intercept")
    for part in sums:
        value = value + part
    return fit.join(now, ["decision_time", "series_id"]).select(
        "decision_time", F.col("series_id").alias(by), "fit_id", F.greatest("_fitted", "_seen").alias("produced_at"), value.alias("expected_return")
    )
