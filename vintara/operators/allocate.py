"""Allocation: equal weight, inverse volatility, minimum variance, mean variance.

The first two are windows. The others solve one small quadratic program for each decision,
over a window of a universe's returns, in grouped Arrow tasks; decisions are independent,
so they spread over the cluster.

Returns are long: ``decision_time, asset, t, r`` with the balanced window of each decision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintara.checks import repeated, require_none
from vintara.errors import ExecutionError, InsufficientWindowError, OptimizationFailureError
from vintara.operators.buckets import running
from vintara.operators.features import latest_window, unbalanced
from vintara.operators.portfolio import WeightConstraints
from vintara.storage import small

#: Tolerances of an accepted vector: stationarity, budget.
KKT_TOLERANCE, BUDGET_TOLERANCE = 1e-8, 1e-12
#: Shifts of weight between two assets that must not improve an accepted vector.
TRANSFERS = (1e-6, 1e-4, 1e-2)


def decision_windows(returns: DataFrame, decisions: DataFrame, window: int, checked: bool = True) -> DataFrame:
    """The last ``window`` returns of each asset that each decision may know.

    ``returns`` has ``asset, t, available_time, r``. All assets must have the same instants.
    """
    rows = latest_window(published_last(returns, decisions, window), window, ("decision_time", "asset"), "t")
    if checked:
        short = rows.groupBy("decision_time", "asset").count().where(F.col("count") < window)
        require_none(short, InsufficientWindowError, "fewer returns than the window")
        require_none(unbalanced(rows, window, series="asset", time="t"), InsufficientWindowError, "windows of different instants")
    return rows


def published_last(returns: DataFrame, decisions: DataFrame, window: int) -> DataFrame:
    """What the last ``window`` returns that each decision may know are among, without multiplying histories.

    Rows are ranked by ``t`` in their asset. A decision that knows ``v`` rows, the last of them of rank ``k``, misses
    ``k - v`` of those up to it, so its window lies within the ranks above ``v - window``: it is met by equal ranks. With
    returns published in order that is ``window`` rows a decision and asset; each one late adds one.
    """
    ranked = running(returns, ["asset"], ["t"], {"_rank": ("count", F.lit(1))})
    known = ranked.select("asset", F.col("available_time").alias("_at"), F.lit(0).alias("_asks"), "_rank")
    asked = decisions.select(F.col("decision_time").alias("_at")).distinct().join(small(returns.select("asset").distinct()), F.lit(True))
    points = known.unionByName(asked.select("asset", "_at", F.lit(1).alias("_asks"), F.lit(None).cast("long").alias("_rank")))
    seen = running(points, ["asset"], ["_at", "_asks"], {"_known": ("count", F.col("_rank")), "_last": ("max", F.col("_rank"))})
    first = F.greatest(F.col("_known") - window + 1, F.lit(1))
    spans = seen.where("_asks = 1 AND _known > 0").select("asset", F.col("_at").alias("decision_time"), F.explode(F.sequence(first, F.col("_last"))).alias("_rank"))
    return spans.join(ranked, ["asset", "_rank"]).where("available_time <= decision_time").select("decision_time", *returns.columns)


def equal_weight(universe: DataFrame) -> DataFrame:
    """``weight`` of one over the number of assets of each ``decision_time``."""
    n = F.count(F.lit(1)).over(Window.partitionBy("decision_time"))
    return universe.withColumn("weight", F.lit(1.0) / n)


def inverse_volatility(windows: DataFrame) -> DataFrame:
    """Weights in proportion to one over the root of the sum of squared deviations."""
    spread = windows.groupBy("decision_time", "asset").agg((F.var_pop("r") * F.count("r")).alias("_d"))
    score = F.when(F.col("_d") > 0, 1 / F.sqrt("_d"))
    scored = spread.withColumn("_score", score)
    total = F.sum("_score").over(Window.partitionBy("decision_time"))
    return scored.select("decision_time", "asset", (F.col("_score") / total).alias("weight"))


def sample_covariance(windows: DataFrame) -> DataFrame:
    """``decision_time, a, b, covariance`` (ddof 1) of each pair, by a join on instants."""
    a = windows.select("decision_time", "t", F.col("asset").alias("a"), F.col("r").alias("x"))
    b = windows.select("decision_time", "t", F.col("asset").alias("b"), F.col("r").alias("y"))
    return (
        a.join(b, ["decision_time", "t"])
        .where("a <= b")
        .groupBy("decision_time", "a", "b")
        .agg(F.covar_samp("x", "y").alias("covariance"))
    )


def exact_rank(panel: np.ndarray) -> int:
    """The rank of a panel less its column means, exactly.

    Floats are whole numbers over a power of two, so one scale makes all of them whole, and
    elimination without fractions (Bareiss) keeps them so.
    """
    ratios = [[float(x).as_integer_ratio() for x in row] for row in panel]
    scale = max((d for row in ratios for _, d in row), default=1)
    whole = [[n * (scale // d) for n, d in row] for row in ratios]
    sums = [sum(column) for column in zip(*whole)]
    rows = [[len(whole) * x - s for x, s in zip(row, sums)] for row in whole]
    rank, before = 0, 1
    for column in range(len(sums)):
        lead = max(range(rank, len(rows)), key=lambda i: abs(rows[i][column]), default=None)
        if lead is None or not rows[lead][column]:
            continue
        rows[rank], rows[lead] = rows[lead], rows[rank]
        top = rows[rank]
        for i in range(rank + 1, len(rows)):
            factor = rows[i][column]
            rows[i] = [(x * top[column] - factor * y) // before for x, y in zip(rows[i], top)]
        rank, before = rank + 1, top[column]
    return rank


def project_to_simplex(v: np.ndarray) -> np.ndarray:
    """The nearest vector without negatives that sums to 1."""
    u = np.sort(v)[::-1]
    excess = np.cumsum(u) - 1
    k = np.nonzero(u - excess / np.arange(1, len(v) + 1) > 0)[0][-1]
    return np.maximum(v - excess[k] / (k + 1), 0)


def residuals(q: np.ndarray, c: np.ndarray, w: np.ndarray) -> dict[str, float]:
    """How far ``w`` is from the conditions of the long-only optimum."""
    gradient = q @ w - c
    held = w > 0
    level = float(gradient[held].mean()) if held.any() else 0.0
    return {
        "budget": abs(float(w.sum()) - 1),
        "stationarity": float(np.abs(gradient[held] - level).max(initial=0.0)),
        "dual": float(max(0.0, (level - gradient[~held]).max(initial=0.0))),
        "level": level,
    }


def solve_long_only(q: np.ndarray, c: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """The vector that minimises ``w'qw/2 - c'w`` with no negatives and a sum of 1.

    Solves for the weights on a support; drops the asset that first becomes negative on
    the way there, adds the one that would improve most, until neither happens.
    """
    n = len(c)
    support = [int(np.argmin(np.diag(q) / 2 - c))]
    w = np.zeros(n)
    w[support] = 1.0
    scale = max(1.0, float(np.abs(q).max()), float(np.abs(c).max()))
    for _ in range(rounds):
        k = len(support)
        system = np.zeros((k + 1, k + 1))
        system[:k, :k] = q[np.ix_(support, support)]
        system[:k, k] = system[k, :k] = 1.0
        solved = np.linalg.solve(system, np.append(c[support], 1.0))
        aim = solved[:k]
        if (aim < 0).any():
            now = w[support]
            falling = aim < 0
            steps = now[falling] / (now[falling] - aim[falling])
            w[support] = now + steps.min() * (aim - now)
            gone = np.array(support)[falling][int(np.argmin(steps))]
            w[gone] = 0.0
            support.remove(int(gone))
            continue
        w[:] = 0.0
        w[support] = aim
        slack = q @ w - c + solved[k]
        slack[support] = 0.0
        worst = int(np.argmin(slack))
        if slack[worst] >= -1e-14 * scale:
            return w
        support.append(worst)
    raise OptimizationFailureError("the active set didn't settle")


def require_accepted(q: np.ndarray, c: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``w`` if it is long only, of budget 1, optimal, and no transfer improves it."""
    if not np.isfinite(w).all() or (w < 0).any():
        raise OptimizationFailureError("a weight is negative or no number")
    r = residuals(q, c, w)
    bound = KKT_TOLERANCE * max(1.0, abs(r["level"]))
    if r["budget"] > BUDGET_TOLERANCE * len(w) or r["stationarity"] > bound or r["dual"] > bound:
        raise OptimizationFailureError(f"not optimal: {r}")
    # At the optimum a step down the gradient leads back to the same vector.
    if np.abs(w - project_to_simplex(w - (q @ w - c))).max() > bound * len(w):
        raise OptimizationFailureError("a projected step leads elsewhere")
    value = w @ q @ w / 2 - c @ w
    gradient = q @ w - c
    for size in TRANSFERS:
        # What a transfer of ``size`` from i to j changes, for all pairs at once.
        give = np.minimum(size, w)
        change = (
            give[:, None] * (gradient[None, :] - gradient[:, None])
            + give[:, None] ** 2 * (np.diag(q)[:, None] + np.diag(q)[None, :] - 2 * q) / 2
        )
        np.fill_diagonal(change, 0.0)
        if change.min() < -KKT_TOLERANCE * max(1.0, abs(value)):
            raise OptimizationFailureError("a transfer improves the vector")
    return w


_OUT = "decision_time timestamp, asset string, weight double, budget double, stationarity double, dual double"


def _solve_table(table: pa.Table, risk_aversion: float | None) -> pa.Table:
    frame = table.select(["decision_time", "asset", "t", "r"]).to_pandas()
    panel = frame.pivot(index="t", columns="asset", values="r").sort_index()
    assets, x = list(panel.columns), panel.to_numpy(float)
    n = len(assets)
    if n < 2 or len(x) < n + 1 or not np.isfinite(x).all():
        raise InsufficientWindowError("a covariance needs two assets and more instants than assets")
    if exact_rank(x) < n:
        raise ExecutionError("the window's returns aren't of full rank")
    q, c = np.cov(x, rowvar=False, ddof=1), np.zeros(n)
    if risk_aversion is not None:
        expected = dict(zip(table["asset"].to_pylist(), table["expected_return"].to_pylist()))
        mu = np.array([expected[a] for a in assets], float)
        q, c = risk_aversion * q, mu - mu.mean()
    # Only the ratio of the two terms matters; a unit scale keeps the tolerances meaningful.
    unit = float(np.abs(q).max()) or 1.0
    w = require_accepted(q / unit, c / unit, solve_long_only(q / unit, c / unit))
    r = residuals(q / unit, c / unit, w)
    at = table["decision_time"][:1].to_pylist() * n
    return pa.table(
        {
            "decision_time": pa.array(at, table.schema.field("decision_time").type),
            "asset": assets,
            "weight": w,
            **{k: [r[k]] * n for k in ("budget", "stationarity", "dual")},
        }
    )


#: The one declaration that the programs below solve: long only, fully invested, no caps.
CANONICAL = WeightConstraints()


def require_canonical(constraints: WeightConstraints) -> None:
    """Reject a declaration that the solver wouldn't keep to, before anything is solved."""
    if constraints.allow_short or constraints.budget != 1.0 or constraints.max_gross is not None or constraints.max_net is not None:
        raise ExecutionError(f"only long-only books of budget 1 without caps are solved; got {constraints}")


def require_real_returns(windows: DataFrame) -> DataFrame:
    """``windows``, if each return is a finite number and each asset has each instant once."""
    require_none(windows.where("r IS NULL OR isnan(r) OR abs(r) = double('infinity')"), ExecutionError, "a return is a finite number")
    require_none(repeated(windows, ["decision_time", "asset", "t"]), ExecutionError, "a return twice")
    return windows


def minimum_variance(windows: DataFrame, constraints: WeightConstraints = CANONICAL, checked: bool = False) -> DataFrame:
    """Long-only weights of least variance, with the solution's residuals.

    With ``checked`` the windows are validated first, by queries.
    """
    require_canonical(constraints)
    if checked:
        require_real_returns(windows)
    rows = windows.select("decision_time", "asset", "t", "r")
    return rows.groupBy("decision_time").applyInArrow(lambda t: _solve_table(t, None), _OUT)


def mean_variance(
    windows: DataFrame, forecasts: DataFrame, risk_aversion: float, constraints: WeightConstraints = CANONICAL, checked: bool = False
) -> DataFrame:
    """Long-only weights that trade expected return against variance.

    ``forecasts`` has ``decision_time, asset, expected_return``; the mean is taken off. With ``checked`` the
    windows are validated first, by queries.
    """
    require_canonical(constraints)
    if checked:
        require_real_returns(windows)
    if not risk_aversion > 0:
        raise ExecutionError("risk aversion is positive")
    rows = windows.join(forecasts, ["decision_time", "asset"], "left")
    require_none(rows.where("expected_return IS NULL"), ExecutionError, "no forecast for an asset")
    rows = rows.select("decision_time", "asset", "t", "r", "expected_return")
    return rows.groupBy("decision_time").applyInArrow(lambda t: _solve_table(t, risk_aversion), _OUT)
