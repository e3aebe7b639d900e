"""Diagnostics of datasets: describe, coverage, missingness, correlation, plot data.

Datasets have ``series_id``, a key column (``observation_time`` or ``period_key``), ``value``
and may have ``value_kind`` (number, bool, str or null); without it a value is a number
or null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintara.checks import repeated, require_none
from vintara.errors import AmbiguousObservationError, GridDeclarationError
from vintara.operators.buckets import running
from vintara.storage import saved

METHODS, DELETIONS, LEAST_OVERLAP = ("pearson", "spearman"), ("listwise", "pairwise"), 3


def local_id(series: Column) -> Column:
    """What stands after the last slash."""
    return F.element_at(F.split(series, "/"), -1)


def _kind(df: DataFrame) -> Column:
    if "value_kind" in df.columns:
        return F.col("value_kind")
    return F.when(F.col("value").isNull(), "null").otherwise("number")


def require_local_ids(df: DataFrame) -> DataFrame:
    """``df``, unless two of its series have one local id: a report names series by it."""
    names = df.select("series_id").distinct().groupBy(local_id(F.col("series_id")).alias("local")).count()
    require_none(names.where("count > 1"), AmbiguousObservationError, "two series of one local id")
    return df


def describe(df: DataFrame, key: str = "observation_time") -> DataFrame:
    """One row for each series: counts by kind, moments, quantiles (type 7) and number of keys.

    ``undefined`` names the measures that too few numbers leave undefined. Quantiles are
    read off the running counts of distinct values, which are taken in range buckets, so a
    series of any length is spread over tasks. The keys themselves are :func:`described_keys`.
    """
    rows = require_local_ids(df).withColumn("_kind", _kind(df))
    number = F.when(F.col("_kind") == "number", F.col("value"))
    counts = rows.groupBy("series_id").agg(
        F.count(number).alias("n"),
        F.avg(number).alias("mean"),
        F.stddev_samp(number).alias("std"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        *(F.count_if(F.col("_kind") == k).alias(f"n_{k}") for k in ("bool", "str", "null")),
    )
    keys = described_keys(df, key).groupBy(F.col("series_id").alias("_local")).agg(F.count(F.lit(1)).alias("n_keys"))
    local = local_id(F.col("series_id"))
    shares = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    found = counts.join(keys, local == F.col("_local")).join(_quantiles(rows.where("_kind = 'number'"), shares), "series_id", "left")
    undefined = F.when(F.col("n") == 0, F.array(F.lit("insufficient_n"), F.lit("no_numeric_values"))).when(
        F.col("n") == 1, F.array(F.lit("insufficient_n"))
    ).otherwise(F.array().cast("array<string>"))
    return found.select(
        local.alias("series_id"), "n", "mean", "std", "min", "max", *shares,
        "n_bool", "n_str", "n_null", "n_keys", undefined.alias("undefined"),
    )


def described_keys(df: DataFrame, key: str = "observation_time") -> DataFrame:
    """``series_id`` (local) and key: the distinct keys of each series."""
    return df.select(local_id(F.col("series_id")).alias("series_id"), key).distinct()


def _quantiles(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of ``value`` for each series: between the two ranks that ``h = (n - 1) p`` lies between."""
    counts = rows.groupBy("series_id", "value").agg(F.count(F.lit(1)).alias("_c"))
    placed = running(counts, ["series_id"], ["value"], {"_upto": ("sum", F.col("_c"))})
    n = rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n"))
    placed = placed.join(n, "series_id")
    first, last = F.col("_upto") - F.col("_c"), F.col("_upto") - 1  # ranks from 0 that the value takes
    aggregates = []
    for name, p in shares.items():
        h = (F.col("_n") - 1) * p
        for side, rank in (("low", F.floor(h)), ("high", F.ceil(h))):
            aggregates.append(F.max(F.when(rank.between(first, last), F.col("value"))).alias(f"_{name}_{side}"))
    found = placed.groupBy("series_id", "_n").agg(*aggregates)
    columns = []
    for name, p in shares.items():
        h = (F.col("_n") - 1) * p
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        columns.append((low + (h - F.floor(h)) * (high - low)).alias(name))
    return found.select("series_id", *columns)


def coverage(df: DataFrame, key: str = "observation_time") -> DataFrame:
    """One row for each series: records, distinct keys, keys held twice, kinds.

    Two levels of aggregation, so that nothing distinct is collected.
    """
    kind = F.col("_kind")
    cells = (
        df.withColumn("_kind", _kind(df))
        .groupBy("series_id", key)
        .agg(F.count(F.lit(1)).alias("n"), *(F.count_if(kind == k).alias(f"n_{k}") for k in ("null", "bool", "str")))
    )
    out = cells.groupBy("series_id").agg(
        F.sum("n").alias("n_records"),
        F.count(F.lit(1)).alias("n_distinct_keys"),
        F.count_if(F.col("n") > 1).alias("n_duplicate_cells"),
        *(F.sum(f"n_{k}").alias(f"n_{k}") for k in ("null", "bool", "str")),
    )
    return out.withColumn("n_numeric", F.col("n_records") - F.col("n_null") - F.col("n_bool") - F.col("n_str"))


def missingness(df: DataFrame, expected: DataFrame, key: str = "observation_time") -> DataFrame:
    """Observed against expected keys of each series.

    ``expected`` has ``series_id`` and the key. The fraction is null where no key is expected.
    """
    require_none(repeated(df, ["series_id", key]), AmbiguousObservationError, "a key is there more than once")
    there = df.select("series_id", key, F.col("value").isNull().alias("_null"), F.lit(True).alias("_seen"))
    grid = expected.select("series_id", key).distinct().withColumn("_due", F.lit(True))
    due, seen = F.coalesce("_due", F.lit(False)), F.coalesce("_seen", F.lit(False))
    out = there.join(grid, ["series_id", key], "full").groupBy("series_id").agg(
        F.count_if(due).alias("expected_n"),
        F.count_if(seen).alias("observed_n"),
        F.count_if(due & ~seen).alias("absent_expected_n"),
        F.count_if(seen & F.coalesce("_null", F.lit(False))).alias("null_value_n"),
        F.count_if(seen & ~due).alias("unexpected_observed_n"),
    )
    met = F.col("expected_n") - F.col("absent_expected_n")
    return out.withColumn("observed_fraction_of_expected", F.try_divide(met, F.col("expected_n")))


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ranks from 1 within ``by``; equal values share their mean rank.

    Ranks come from running counts of distinct values, taken in range buckets.
    """
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = running(counts, by, [value], {"_upto": ("sum", F.col("_c"))})
    rank = F.col("_upto") - (F.col("_c") - 1) / 2.0
    return rows.join(upto.select(*by, value, rank.alias(name)), [*by, value])


def correlation(
    df: DataFrame, method: str = "pearson", deletion: str = "pairwise", min_overlap: int = LEAST_OVERLAP, key: str = "observation_time"
) -> DataFrame:
    """``first, second, n, coefficient, reasons`` for each pair of series and each with itself.

    Pairs meet by an equality join on the key, so the work is that of the keys they share.
    ``listwise`` uses keys that all series have. Ranks are taken after alignment. A pair
    with too few keys or without spread has no coefficient but a reason.
    """
    if method not in METHODS or deletion not in DELETIONS:
        raise GridDeclarationError(f"method is of {METHODS} and deletion of {DELETIONS}")
    if min_overlap < LEAST_OVERLAP:
        raise GridDeclarationError(f"an overlap is of at least {LEAST_OVERLAP}")
    require_none(repeated(df, ["series_id", key]), AmbiguousObservationError, "a key is there more than once")
    require_local_ids(df)
    rows = df.where(F.col("value").isNotNull()).select(local_id(F.col("series_id")).alias("s"), F.col(key).alias("k"), F.col("value").alias("v"))
    series = rows.select("s").distinct()
    if deletion == "listwise":
        n = series.count()
        full = rows.groupBy("k").agg(F.count_distinct("s").alias("n")).where(F.col("n") == n)
        rows = rows.join(full.select("k"), "k", "left_semi")
    a = rows.select(F.col("s").alias("first"), "k", F.col("v").alias("x"))
    b = rows.select(F.col("s").alias("second"), "k", F.col("v").alias("y"))
    pairs = a.join(b, "k").where("first <= second")
    if method == "spearman":
        pairs = average_ranks(average_ranks(saved(pairs), ["first", "second"], "x", "_x"), ["first", "second"], "y", "_y")
        pairs = pairs.select("first", "second", "k", F.col("_x").alias("x"), F.col("_y").alias("y"))
    stats = pairs.groupBy("first", "second").agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_pop("x", "y").alias("_xy"),
        F.stddev_pop("x").alias("_sx"),
        F.stddev_pop("y").alias("_sy"),
        ((F.min("x") == F.max("x")) | (F.min("y") == F.max("y"))).alias("_flat"),
    )
    every = series.select(F.col("s").alias("first")).join(series.select(F.col("s").alias("second")), F.col("first") <= F.col("second"))
    found = every.join(stats, ["first", "second"], "left")
    n = F.coalesce("n", F.lit(0))
    few, flat = n < min_overlap, F.coalesce("_flat", F.lit(False))
    value = F.when(~few & ~flat, F.try_divide(F.col("_xy"), F.col("_sx") * F.col("_sy")))
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))
    reason = F.when(few, "insufficient_overlap").when(flat, "constant_series")
    return found.select("first", "second", n.alias("n"), F.when(value.isNotNull(), clipped).alias("coefficient"), reason.alias("reason"))


def series_table(df: DataFrame, series: list[str] | None = None, key: str = "observation_time") -> DataFrame:
    """Keys as rows, series as columns in order of their names."""
    named = require_local_ids(df).withColumn("_s", local_id(F.col("series_id")))
    pivot = named.groupBy(key)
    pivot = pivot.pivot("_s", series) if series else pivot.pivot("_s")
    return pivot.agg(F.first("value")).orderBy(key)


@dataclass(frozen=True)
class PlotSpec:
    """What a figure shows: labels and named series of numbers."""

    kind: str
    title: str
    labels: list[str]
    series: dict[str, list[float | None]] = field(default_factory=dict)
    footnote: str = ""

    def render(self):
        """A matplotlib figure; the library is imported here only."""
        import matplotlib.pyplot as plt

        figure, axes = plt.subplots()
        for name, values in self.series.items():
            axes.plot(self.labels, [float("nan") if v is None else v for v in values], label=name)
        axes.set_title(self.title)
        axes.legend()
        return figure


#: Reports are small (one row a series or pair); points of a series plot are up to this.
PLOT_ROWS = 10_000


def plot(df: DataFrame, kind: str, key: str = "observation_time", **options) -> PlotSpec:
    """A plot of a report; ``kind`` is describe, coverage, missingness, correlation or series."""
    if kind == "series":
        rows = series_table(df, options.get("series"), key).limit(PLOT_ROWS + 1).collect()
        if len(rows) > PLOT_ROWS:
            raise GridDeclarationError(f"a series plot has at most {PLOT_ROWS} points")
        names = [c for c in (rows[0].asDict() if rows else {}) if c != key]
        return PlotSpec(kind, "Series", [str(r[key]) for r in rows], {n: [r[n] for r in rows] for n in names})
    makers = {"describe": describe, "coverage": coverage}
    if kind in makers:
        report, label = makers[kind](df, key), "series_id"
    elif kind == "missingness":
        report, label = missingness(df, options["expected"], key), "series_id"
    elif kind == "correlation":
        report = correlation(df, key=key, **options).withColumn("pair", F.concat_ws(" ~ ", "first", "second"))
        label = "pair"
    else:
        raise GridDeclarationError(f"no plot of kind {kind!r}")
    numbers = [f.name for f in report.schema if f.dataType.typeName() in ("long", "double", "integer")]
    rows = report.orderBy(label).collect()
    return PlotSpec(kind, kind.title(), [r[label] for r in rows], {n: [r[n] for r in rows] for n in numbers})
