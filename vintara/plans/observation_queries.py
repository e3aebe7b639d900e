"""Queries over observations: sources, calendar, point in time, features, diagnostics."""

from __future__ import annotations

from datetime import timedelta, timezone

from pyspark.sql import Window
from pyspark.sql import functions as F

from vintara.checks import repeated
from vintara.functions import calendar as cal
from vintara.operators import diagnostics as dia
from vintara.operators import features as trf
from vintara.operators import pit
from vintara.operators.buckets import running
from vintara.plans import views
from vintara.plans.registry import query
from vintara.plans.views import GRID, OBS
from vintara.sources import tables
from vintara.storage import shared_path

# Sources.


def _schema(policy):
    return tables.DeclaredTable("series_id", "observation_time", policy, "value", units="units", frequency="irregular")


def _raw(spark, sf_dir):
    return views.obs(spark, sf_dir)


@query(f"WITH {OBS} SELECT series_id, observation_time, available_time, value FROM obs")
def src_parquet_obs(spark, sf_dir):
    path = shared_path(spark, "observations")
    _raw(spark, sf_dir).write.parquet(path)
    declared = _schema(tables.Availability.explicit_column("available_time"))
    return tables.from_parquet(spark, path, declared, checked=False).select("series_id", "observation_time", "available_time", "value")


# Orders as observations: when they were placed, known when the last line was shipped.
_PLACED = """placed AS (SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, CAST(o.o_orderdate AS TIMESTAMP) AS placed_at,
    CAST(max(l.l_shipdate) AS TIMESTAMP) AS shipped_at FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY ALL)"""


@query(f"WITH {_PLACED} SELECT o_orderkey AS series_id, placed_at AS observation_time, shipped_at AS available_time, round(o_totalprice, 6) + 0.0 AS value FROM placed")
def src_explicit_column(spark, sf_dir):
    shipped = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").cast("timestamp").alias("shipped_at"))
    placed = views.table(spark, sf_dir, "orders").join(shipped, "o_orderkey").withColumn("placed_at", F.col("o_orderdate").cast("timestamp"))
    declared = tables.DeclaredTable("o_orderkey", "placed_at", tables.Availability.explicit_column("shipped_at"), "o_totalprice", "money", "irregular")
    found = tables.from_dataframe(placed, declared)
    return found.select(F.col("series_id").cast("long").alias("series_id"), "observation_time", "available_time", F.round("value", 6).alias("value"))


@query("""SELECT 'EV/' || event_type AS series_id, ts AS observation_time, ts + INTERVAL 2 DAYS AS available_time, value FROM events""")
def src_fixed_lag(spark, sf_dir):
    policy = tables.Availability.fixed_lag(timedelta(days=2), justification="published two days later")
    first = views.table(spark, sf_dir, "events").select(
        F.concat(F.lit("EV/"), "event_type").alias("series_id"), F.col("ts").alias("observation_time"), "value"
    )
    return tables.from_dataframe(first, _schema(policy)).select("series_id", "observation_time", "available_time", "value")


@query("""SELECT 'EV/' || event_type AS series_id, ts AS observation_time, ts AS available_time, value FROM events""")
def src_same_instant(spark, sf_dir):
    first = views.table(spark, sf_dir, "events").select(
        F.concat(F.lit("EV/"), "event_type").alias("series_id"), F.col("ts").alias("observation_time"), "value"
    )
    return tables.from_dataframe(first, _schema(tables.Availability.same_instant())).select(
        "series_id", "observation_time", "available_time", "value"
    )


@query(f"""WITH {OBS} SELECT series_id, observation_time, count(*) AS n FROM obs GROUP BY ALL HAVING count(*) > 1""")
def src_duplicate_identity(spark, sf_dir):
    found = repeated(_raw(spark, sf_dir), ["series_id", "observation_time"])
    return found.select("series_id", "observation_time", F.col("count").alias("n"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def src_json_props_decode(spark, sf_dir):
    decoded = F.from_json("props", "k BIGINT")
    return views.table(spark, sf_dir, "events").select("event_id", decoded["k"].alias("k"))


@query(
    """SELECT CAST(event_id AS VARCHAR) AS cell,
       CASE WHEN event_id % 4 = 0 THEN 'int' WHEN event_id % 4 = 1 THEN 'float' WHEN event_id % 4 = 2 THEN 'str' ELSE 'null' END AS value_kind,
       CASE WHEN event_id % 4 = 0 THEN CAST(event_id AS DOUBLE) WHEN event_id % 4 = 1 THEN event_id + 0.5 END AS value
       FROM events"""
)
def src_csv_decode(spark, sf_dir):
    events = views.table(spark, sf_dir, "events").select("event_id")
    text = F.col("event_id").cast("string")
    cell = (
        F.when(F.col("event_id") % 4 == 0, text)
        .when(F.col("event_id") % 4 == 1, F.concat(text, F.lit(".5")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("x"), text))
        .otherwise(F.lit("  "))
    )
    decoded = tables.decode_cell(cell)
    return events.select(text.alias("cell"), decoded["value_kind"].alias("value_kind"), decoded["value"].alias("value"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS series_id, CAST(o_orderdate AS TIMESTAMP) AS observation_time, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 2 DAY AS available_time,
    CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice, 2) + 0.0 END AS value, CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE 'number' END AS value_kind FROM orders""")
def src_csv_read(spark, sf_dir):
    """Orders written as CSV, with blank cells and quoted text, and read under a declaration."""
    path = shared_path(spark, "orders-csv")
    cell = F.when(F.col("o_orderkey") % 5 != 0, F.format_string("%.2f", "o_totalprice")).otherwise("")
    rows = views.table(spark, sf_dir, "orders").select(
        F.concat(F.lit('a "quoted", '), "o_orderpriority").alias("note"),
        F.col("o_custkey").alias("customer"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("placed"),
        cell.alias("price"),
    )
    rows.write.options(header="true", escape='"').csv(path)
    lag = tables.Availability.fixed_lag(timedelta(days=2), justification="orders are booked two days later")
    declared = tables.DeclaredTable("customer", "placed", lag, "price", units="money", frequency="irregular")
    found = tables.from_csv(spark, path, declared, checked=False)
    return found.select("series_id", "observation_time", "available_time", F.round("value", 2).alias("value"), "value_kind")


@query(f"""WITH {OBS}, {GRID}, asked AS (SELECT series_id, observation_time, available_time, value, decision_time,
      row_number() OVER (PARTITION BY decision_time, series_id, observation_time ORDER BY available_time DESC) AS k FROM obs JOIN grid ON available_time <= decision_time)
    SELECT decision_time, series_id, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM asked WHERE k = 1 GROUP BY ALL""")
def pit_information_set_many(spark, sf_dir):
    """What each decision may know, by the intervals in which vintages are valid."""
    found = pit.information_set(views.obs(spark, sf_dir), views.grid(spark), few=False)
    return found.groupBy("decision_time", "series_id").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("value"), 6) + 0.0).alias("total"))


# Calendar.


@query(
    """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND AS month_end
       FROM orders"""
)
def cal_month_end(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", cal.month_end(F.year("o_orderdate"), F.month("o_orderdate")).alias("month_end"))


@query(
    """SELECT o_orderkey, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) + INTERVAL 3 MONTH - INTERVAL 1 MICROSECOND AS quarter_end
       FROM orders"""
)
def cal_quarter_end(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", cal.quarter_end(F.year("o_orderdate"), F.quarter("o_orderdate")).alias("quarter_end"))


def _grid_counts(grid, spark, sf_dir, months):
    """The grid's instants with the orders placed in the period that ends there."""
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("at"))
    month = F.year("at") * 12 + F.month("at") - 1
    # Periods are numbered as the grid is: by months since its first.
    first = grid.where("ord = 0").select((F.year("instant") * 12 + F.month("instant") - 1).alias("_first"))
    placed = orders.select(month.alias("_m")).join(F.broadcast(first), F.lit(True))
    counted = placed.groupBy(F.ceil((F.col("_m") - F.col("_first")) / months).cast("int").alias("ord")).agg(F.count(F.lit(1)).alias("n_orders"))
    return grid.join(counted, "ord", "left").select("ord", "instant", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


def _first_order(spark, sf_dir):
    """The first order's year and month, and how many months there are to the last's."""
    at = views.table(spark, sf_dir, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")).first()
    return at.a.year, at.a.month, (at.b.year - at.a.year) * 12 + at.b.month - at.a.month + 1


_FIRST_MONTH = "SELECT CAST(date_trunc('month', min(o_orderdate)) AS TIMESTAMP) AS a, CAST(date_trunc('month', max(o_orderdate)) AS TIMESTAMP) AS b FROM orders"


@query(f"""WITH span AS ({_FIRST_MONTH}), grid AS (SELECT CAST(i AS INTEGER) AS ord, a + to_months(CAST(i AS INTEGER)) AS start FROM span, unnest(range(0, date_diff('month', a, b) + 1)) u(i))
    SELECT ord, start + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND AS instant, (SELECT count(*) FROM orders WHERE o_orderdate >= start AND o_orderdate < start + INTERVAL 1 MONTH) AS n_orders FROM grid""")
def cal_monthly_grid(spark, sf_dir):
    """Month ends from the first order's month to the last's, and the orders of each month."""
    year, month, count = _first_order(spark, sf_dir)
    return _grid_counts(cal.month_end_schedule(spark, year, month, count), spark, sf_dir, 1)


@query(f"""WITH span AS (SELECT date_trunc('quarter', a) AS a, b FROM ({_FIRST_MONTH})),
    grid AS (SELECT CAST(i AS INTEGER) AS ord, CAST(a AS TIMESTAMP) + to_months(CAST(3 * i AS INTEGER)) AS start FROM span, unnest(range(0, date_diff('quarter', a, b) + 1)) u(i))
    SELECT ord, start + INTERVAL 3 MONTH - INTERVAL 1 MICROSECOND AS instant, (SELECT count(*) FROM orders WHERE o_orderdate >= start AND o_orderdate < start + INTERVAL 3 MONTH) AS n_orders FROM grid""")
def cal_quarterly_grid(spark, sf_dir):
    """Quarter ends from the first order's quarter to the last's, and the orders of each quarter."""
    year, month, count = _first_order(spark, sf_dir)
    first = (month - 1) // 3 + 1
    months = count + (month - 1) % 3
    return _grid_counts(cal.quarter_end_schedule(spark, year, first, -(-months // 3)), spark, sf_dir, 3)


@query(f"""WITH span AS (SELECT CAST(min(o_orderdate) AS TIMESTAMP) AS first, CAST(max(o_orderdate) AS TIMESTAMP) AS last FROM orders),
    grid AS (SELECT date_trunc('month', first) + to_months(CAST(5 * i + 1 AS INTEGER)) - INTERVAL 1 MICROSECOND AS cutoff, first, last FROM span, unnest(range(0, 100)) u(i))
    SELECT CAST(cutoff AS TIMESTAMP) AS cutoff, 'evaluation' AS role, (SELECT count(*) FROM orders WHERE o_orderdate <= cutoff) AS n_known FROM grid WHERE cutoff BETWEEN first AND last""")
def cal_refit_events(spark, sf_dir):
    """Refits every five months within the span of the orders, and how many orders each may know."""
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("at"))
    span = orders.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    utc = lambda t: t.replace(tzinfo=timezone.utc)
    refits = cal.month_end_refits(spark, utc(span.a), utc(span.b), 5, "evaluation")
    # A running count over days and refits: no order is compared with each refit.
    days = orders.groupBy("at").count().select("at", "count", F.lit(0).alias("asks"), F.lit(None).cast("string").alias("role"))
    both = days.unionByName(refits.select(F.col("cutoff").alias("at"), F.lit(0).cast("long").alias("count"), F.lit(1).alias("asks"), "role"))
    known = running(both, [], ["at", "asks"], {"n_known": ("sum", F.col("count"))})
    return known.where("asks = 1").select(F.col("at").alias("cutoff"), "role", "n_known")


@query("""SELECT o_orderkey, o_orderdate + to_months(CAST(o_orderkey % 25 AS INTEGER) - 12) AS moved FROM orders""")
def cal_shift_months(spark, sf_dir):
    months = (F.col("o_orderkey") % 25 - 12).cast("int")
    return views.table(spark, sf_dir, "orders").select("o_orderkey", cal.shift_months(F.col("o_orderdate"), months).alias("moved"))


@query(
    """SELECT o_orderkey, date_trunc('month', o_orderdate + to_months(CAST(o_orderkey % 13 AS INTEGER)) - INTERVAL 1 MICROSECOND)
              + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND AS cutoff FROM orders"""
)
def cal_grid_before(spark, sf_dir):
    months = (F.col("o_orderkey") % 13).cast("int")
    return views.table(spark, sf_dir, "orders").select("o_orderkey", cal.grid_before(F.col("o_orderdate"), months).alias("cutoff"))


@query(
    """WITH x AS (SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
       SELECT o_custkey, o_orderkey, o_orderdate, before FROM x WHERE before >= o_orderdate"""
)
def cal_grid_monotone_violations(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return cal.grid_violations(orders, "o_orderdate", "o_orderkey", ("o_custkey",))


@query(
    """WITH x AS (SELECT o_custkey, o_orderkey, o_orderdate,
                         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders)
       SELECT o_custkey, o_orderkey, CAST(position AS INTEGER) AS position FROM x WHERE position % 3 = 0"""
)
def cal_refit_every_n(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return cal.observation_refits(orders, 3, ("o_custkey",), "at").select("o_custkey", "o_orderkey", "position")


@query(
    """SELECT o_orderdate AS instant FROM orders WHERE o_orderpriority = '1-URGENT'
       INTERSECT SELECT o_orderdate FROM orders WHERE o_orderpriority = '5-LOW'"""
)
def cal_holding_plan_intersect(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "instant")
    pick = lambda p: orders.where(F.col("o_orderpriority") == p)
    return cal.holding_instants(pick("1-URGENT"), pick("5-LOW"))


# Point in time.


@query(f"""WITH {OBS}, {GRID}
    SELECT decision_time, count(*) AS n_admitted FROM obs JOIN grid ON available_time <= decision_time GROUP BY ALL""")
def pit_admission(spark, sf_dir):
    # Each row counts from the first decision that admits it: the place is found in the
    # grid, which is small, and the counts are added up.
    grid = views.grid(spark)
    times = F.array(*(F.lit(r["decision_time"]) for r in grid.orderBy("ord").collect()))
    first = F.size(F.filter(times, lambda t: ~pit.is_available(F.col("available_time"), t)))
    counts = views.obs(spark, sf_dir).groupBy(first.alias("ord")).count()
    total = F.sum(F.coalesce("count", F.lit(0))).over(Window.orderBy("ord"))  # one row a decision
    return grid.join(counts, "ord", "left").withColumn("n_admitted", total).where("n_admitted > 0").select("decision_time", "n_admitted")


_THREE = "SELECT TIMESTAMP '2024-01-09' AS decision_time UNION ALL SELECT TIMESTAMP '2024-01-16' UNION ALL SELECT TIMESTAMP '2024-01-30'"


def _three(spark):
    return views.grid(spark).where(F.col("ord").isin(7, 14, 28))


@query(f"""WITH {OBS}, three AS ({_THREE})
    SELECT decision_time, series_id, observation_time, max(available_time) AS available_time,
           round(arg_max(value, available_time), 6) AS value
    FROM obs JOIN three ON available_time <= decision_time GROUP BY decision_time, series_id, observation_time""")
def pit_vintage_as_of(spark, sf_dir):
    found = pit.vintage_as_of(views.obs(spark, sf_dir), _three(spark))
    return found.withColumn("value", F.round("value", 6))


_VISIBLE = f"""WITH {OBS}, {GRID}, seen AS (
    SELECT decision_time, series_id, observation_time, available_time, value,
           row_number() OVER (PARTITION BY decision_time, series_id ORDER BY observation_time DESC, available_time DESC) AS k
    FROM obs JOIN grid ON available_time <= decision_time),
  asked AS (SELECT decision_time, s AS series_id FROM grid, (SELECT DISTINCT series_id AS s FROM obs UNION ALL SELECT 'EV/unknown'))
  SELECT a.decision_time, a.series_id, observation_time, available_time, round(value, 6) AS value
  FROM asked a LEFT JOIN seen s ON a.decision_time = s.decision_time AND a.series_id = s.series_id AND k = 1"""


def _asked(spark, sf_dir):
    known = views.obs(spark, sf_dir).select("series_id").distinct()
    return known.unionByName(spark.range(1).select(F.lit("EV/unknown").alias("series_id")))


@query(_VISIBLE)
def pit_visible_at(spark, sf_dir):
    found = pit.visible_at(views.obs(spark, sf_dir), views.grid(spark), _asked(spark, sf_dir), few=True)
    return found.withColumn("value", F.round("value", 6))


@query(_VISIBLE)
def pit_visible_at_many(spark, sf_dir):
    found = pit.visible_at(views.obs(spark, sf_dir), views.grid(spark), _asked(spark, sf_dir), few=False)
    return found.withColumn("value", F.round("value", 6))


@query(f"""WITH {OBS}, three AS ({_THREE}),
    requests AS (SELECT 'EV/' || event_type AS series_id, ts AS observation_time, event_id AS ord FROM events)
    SELECT decision_time, series_id, observation_time, max(available_time) AS available_time,
           round(arg_max(value, available_time), 6) AS value, min(r.ord) AS ord
    FROM requests r JOIN obs o USING (series_id, observation_time) JOIN three ON available_time <= decision_time
    GROUP BY decision_time, series_id, observation_time""")
def pit_align(spark, sf_dir):
    requests = views.table(spark, sf_dir, "events").select(
        F.concat(F.lit("EV/"), "event_type").alias("series_id"), F.col("ts").alias("observation_time"), F.col("event_id").alias("ord")
    )
    found = pit.align(views.obs(spark, sf_dir).drop("ord"), _three(spark), requests)
    return found.withColumn("value", F.round("value", 6))


@query(f"""WITH {OBS}, {GRID}
    SELECT decision_time, count(DISTINCT (series_id, observation_time)) AS n_groups, count(DISTINCT series_id) AS n_series
    FROM obs JOIN grid ON available_time <= decision_time GROUP BY ALL""")
def pit_information_set_counts(spark, sf_dir):
    # A group is visible from its first availability on: one row a group meets the grid.
    groups = views.obs(spark, sf_dir).groupBy("series_id", "observation_time").agg(F.min("available_time").alias("available_time"))
    seen = groups.join(F.broadcast(views.grid(spark)), F.col("available_time") <= F.col("decision_time"))
    by_series = seen.groupBy("decision_time", "series_id").count()
    return by_series.groupBy("decision_time").agg(F.sum("count").alias("n_groups"), F.count(F.lit(1)).alias("n_series"))


@query(f"""WITH {OBS} SELECT series_id, observation_time, count(*) AS vintages FROM obs GROUP BY ALL HAVING count(*) > 1""")
def pit_revision_pairs(spark, sf_dir):
    return pit.revision_pairs(views.obs(spark, sf_dir))


@query(f"""WITH {OBS} SELECT series_id, observation_time, available_time, observation_time + INTERVAL 2 DAYS AS decision_time FROM obs
    WHERE available_time > observation_time + INTERVAL 2 DAYS""")
def pit_lookahead_violations(spark, sf_dir):
    rows = views.obs(spark, sf_dir).withColumn("decision_time", F.col("observation_time") + F.expr("INTERVAL 2 DAYS"))
    return pit.lookahead(rows).select("series_id", "observation_time", "available_time", "decision_time")


@query(f"""WITH {OBS}, last AS (SELECT series_id, max(available_time) AS inputs_available FROM obs GROUP BY ALL)
    SELECT o.series_id, observation_time, available_time, inputs_available FROM obs o JOIN last USING (series_id)
    WHERE available_time < inputs_available""")
def pit_lineage(spark, sf_dir):
    rows = views.obs(spark, sf_dir)
    found = pit.lineage_violations(rows, rows)
    return found.select("series_id", "observation_time", "available_time", "inputs_available")


@query(f"""WITH {OBS} SELECT count(*) AS n_records, count(DISTINCT series_id) AS n_series,
    count(DISTINCT (series_id, observation_time)) AS n_groups, min(available_time) AS first_available, max(available_time) AS last_available FROM obs""")
def pit_store_counts(spark, sf_dir):
    return pit.store_counts(views.obs(spark, sf_dir))


@query(f"""WITH {OBS}, three AS ({_THREE}), items AS (SELECT decision_time, obs.* FROM obs, three)
    SELECT 'revision' AS kind, decision_time, series_id, observation_time FROM items GROUP BY ALL HAVING count(DISTINCT available_time) > 1
    UNION ALL SELECT 'lookahead', decision_time, series_id, observation_time FROM items WHERE available_time > decision_time""")
def pit_information_set_violations(spark, sf_dir):
    items = views.obs(spark, sf_dir).join(F.broadcast(_three(spark).select("decision_time")), F.lit(True))
    return pit.information_set_violations(items)


# Features.

_ROLL = "(PARTITION BY series_id ORDER BY available_time, observation_time, ord ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


def _rolling_sql(measure, name):
    return f"""WITH {OBS}, x AS (SELECT series_id, available_time, {measure}(value) OVER {_ROLL} AS v,
        row_number() OVER (PARTITION BY series_id ORDER BY available_time, observation_time, ord) AS n FROM obs)
        SELECT series_id || '|{name}[5]' AS series_id, available_time AS observation_time, available_time, round(v, 6) + 0.0 AS value FROM x WHERE n >= 5"""


def _rounded(df):
    return df.withColumn("value", F.round("value", 6) + F.lit(0.0))


@query(_rolling_sql("avg", "rolling_mean"))
def trf_rolling_mean(spark, sf_dir):
    return _rounded(trf.rolling_mean(views.obs(spark, sf_dir), 5))


@query(_rolling_sql("stddev_pop", "rolling_volatility"))
def trf_rolling_vol(spark, sf_dir):
    return _rounded(trf.rolling_volatility(views.obs(spark, sf_dir), 5))


@query(f"""WITH {OBS} SELECT series_id || '|lag[2]' AS series_id, observation_time + INTERVAL 2 DAYS AS observation_time,
    greatest(available_time, observation_time + INTERVAL 2 DAYS) AS available_time, round(value, 6) + 0.0 AS value FROM obs""")
def trf_lag(spark, sf_dir):
    return _rounded(trf.lag(views.obs(spark, sf_dir), 2, timedelta(days=1)))


def _carry_sql(shown):
    return f"""WITH {OBS}, {GRID}, seen AS (
        SELECT series_id, decision_time, observation_time, available_time, value,
               row_number() OVER (PARTITION BY series_id, decision_time ORDER BY available_time DESC, observation_time DESC) AS k
        FROM obs JOIN grid ON available_time <= decision_time)
        SELECT series_id || '|carry_forward' AS series_id, {shown} AS observation_time, decision_time AS available_time,
               round(value, 6) + 0.0 AS value FROM seen WHERE k = 1 AND decision_time - available_time <= INTERVAL 2 HOURS"""


@query(_carry_sql("observation_time"))
def trf_carry_forward(spark, sf_dir):
    return _rounded(trf.carry_forward(views.obs(spark, sf_dir), views.grid(spark), timedelta(hours=2)))


@query(_carry_sql("decision_time"))
def trf_carry_forward_realtime(spark, sf_dir):
    found = trf.carry_forward(views.obs(spark, sf_dir), views.grid(spark), timedelta(hours=2), real_time_surface=True, few=False)
    return _rounded(found)


def _scaler_sql(suffix, stats, value):
    return f"""WITH {OBS}, fit AS (SELECT series_id, {stats}, max(available_time) AS fit_available FROM obs
        WHERE available_time <= TIMESTAMP '2024-01-15' GROUP BY series_id)
        SELECT o.series_id || '|{suffix}' AS series_id, observation_time, greatest(available_time, fit_available) AS available_time,
               round({value}, 6) + 0.0 AS value FROM obs o JOIN fit USING (series_id)"""


def _fit_rows(spark, sf_dir):
    return views.obs(spark, sf_dir).where(F.col("available_time") <= F.to_timestamp(F.lit("2024-01-15 00:00:00")))


@query(_scaler_sql("standard_scaled", "avg(value) AS m, stddev_pop(value) AS s", "(value - m) / s"))
def trf_standard_scaler(spark, sf_dir):
    return _rounded(trf.standard_scale(views.obs(spark, sf_dir), _fit_rows(spark, sf_dir)))


@query(_scaler_sql("minmax_scaled", "min(value) AS m, max(value) - min(value) AS s", "(value - m) / s"))
def trf_minmax_scaler(spark, sf_dir):
    return _rounded(trf.minmax_scale(views.obs(spark, sf_dir), _fit_rows(spark, sf_dir)))


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
    SELECT o_custkey, o_orderkey, o_orderdate FROM x WHERE k <= 4""")
def trf_latest_window(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return trf.latest_window(orders, 4, ("o_custkey",), "at").select("o_custkey", "o_orderkey", "o_orderdate")


@query(f"""WITH {views.PANEL}, {views.MONTHS}, x AS (
    SELECT m.instant AS cutoff, n.instant, row_number() OVER (PARTITION BY m.instant ORDER BY n.instant DESC) AS k
    FROM months m JOIN months n ON n.instant <= m.instant)
    SELECT cutoff, instant AS window_start FROM x WHERE k = 12""")
def trf_window_start(spark, sf_dir):
    at = views.Market(spark, sf_dir).months.select("instant")
    return trf.window_start(at, at.select(F.col("instant").alias("cutoff")), 12)


@query(f"""WITH {views.PANEL}, x AS (SELECT asset AS series_id, month_end AS observation_time, available_time, g AS value,
    lag(g) OVER (PARTITION BY asset ORDER BY month_end) AS before FROM panel)
    SELECT series_id, observation_time, available_time, round(value / before - 1, 6) + 0.0 AS value FROM x WHERE before IS NOT NULL""")
def trf_simple_returns(spark, sf_dir):
    rows = views.panel(spark, sf_dir).select(
        F.col("asset").alias("series_id"), F.col("month_end").alias("observation_time"), "available_time", F.col("g").alias("value")
    )
    return _rounded(trf.simple_returns(rows))


# Diagnostics.


@query(f"""WITH {OBS} SELECT replace(series_id, 'EV/', '') AS series_id, count(value) AS n, round(avg(value), 6) AS mean,
    round(stddev_samp(value), 6) AS std, min(value) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.25), 6) AS q25,
    round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75,
    count(DISTINCT observation_time) AS n_keys, count(*) FILTER (value IS NULL) AS n_null, '' AS undefined FROM obs GROUP BY ALL""")
def dia_describe(spark, sf_dir):
    return _described(dia.describe(views.obs(spark, sf_dir)))


def _described(found):
    measures = [F.round(c, 6).alias(c) for c in ("mean", "std", "max", "q25", "median", "q75")]
    return found.select("series_id", "n", "min", *measures, "n_keys", "n_null", F.array_join("undefined", ",").alias("undefined"))


# Customers' orders as series: many short ones, some with one number, and with none where the price is hidden.
_SHORT = """short AS (SELECT 'C/' || o_custkey AS series_id, o_orderkey AS k, CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice END AS value FROM orders)"""


def _short(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    return orders.select(
        F.concat(F.lit("C/"), F.col("o_custkey").cast("string")).alias("series_id"), F.col("o_orderkey").alias("k"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_totalprice")).alias("value"),
    )


@query(f"""WITH {_SHORT} SELECT replace(series_id, 'C/', '') AS series_id, count(value) AS n, round(avg(value), 6) AS mean,
    round(stddev_samp(value), 6) AS std, min(value) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.25), 6) AS q25,
    round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, count(DISTINCT k) AS n_keys,
    count(*) FILTER (value IS NULL) AS n_null,
    CASE count(value) WHEN 0 THEN 'insufficient_n,no_numeric_values' WHEN 1 THEN 'insufficient_n' ELSE '' END AS undefined FROM short GROUP BY ALL""")
def dia_describe_short_series(spark, sf_dir):
    return _described(dia.describe(_short(spark, sf_dir), "k"))


@query(f"WITH {OBS} SELECT DISTINCT replace(series_id, 'EV/', '') AS series_id, observation_time FROM obs")
def dia_describe_keys(spark, sf_dir):
    return dia.described_keys(views.obs(spark, sf_dir))


@query(f"""WITH {OBS}, cells AS (SELECT series_id, observation_time, count(*) AS n, count(*) FILTER (value IS NULL) AS z FROM obs GROUP BY ALL)
    SELECT series_id, CAST(sum(n) AS BIGINT) AS n_records, count(*) AS n_distinct_keys, count(*) FILTER (n > 1) AS n_duplicate_cells,
           CAST(sum(n) - sum(z) AS BIGINT) AS n_numeric, CAST(sum(z) AS BIGINT) AS n_null FROM cells GROUP BY ALL""")
def dia_coverage(spark, sf_dir):
    found = dia.coverage(views.obs(spark, sf_dir))
    return found.select("series_id", "n_records", "n_distinct_keys", "n_duplicate_cells", "n_numeric", "n_null")


# Hourly means of the events: the table that missingness and correlation are taken of.
_HOURLY = """hourly AS (SELECT 'EV/' || event_type AS series_id, date_trunc('hour', ts) AS observation_time, avg(value) AS value
    FROM events GROUP BY ALL)"""


def _hourly(spark, sf_dir):
    return (
        views.table(spark, sf_dir, "events")
        .groupBy(F.concat(F.lit("EV/"), "event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("observation_time"))
        .agg(F.avg("value").alias("value"))
    )


@query(f"""WITH {_HOURLY}, due AS (SELECT s AS series_id, TIMESTAMP '2024-01-01' + to_hours(CAST(2 * i AS INTEGER)) AS observation_time
        FROM range(400) t(i), (SELECT DISTINCT series_id AS s FROM hourly)),
    x AS (SELECT coalesce(h.series_id, d.series_id) AS series_id, h.series_id IS NOT NULL AS seen, d.series_id IS NOT NULL AS due
        FROM hourly h FULL JOIN due d ON h.series_id = d.series_id AND h.observation_time = d.observation_time)
    SELECT series_id, count(*) FILTER (due) AS expected_n, count(*) FILTER (seen) AS observed_n,
           count(*) FILTER (due AND NOT seen) AS absent_expected_n, CAST(0 AS BIGINT) AS null_value_n,
           count(*) FILTER (seen AND NOT due) AS unexpected_observed_n,
           round(count(*) FILTER (due AND seen) / count(*) FILTER (due), 8) AS observed_fraction_of_expected FROM x GROUP BY ALL""")
def dia_missingness(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    hours = spark.range(400).select(
        (F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), (F.col("id") * 2).cast("int"))).alias("observation_time")
    )
    due = rows.select("series_id").distinct().join(F.broadcast(hours), F.lit(True))
    found = dia.missingness(rows, due)
    return found.withColumn("observed_fraction_of_expected", F.round("observed_fraction_of_expected", 8))


def _pairs_sql(rows, ranked=False):
    value = (
        """(SELECT first, second, k, rank() OVER (PARTITION BY first, second ORDER BY x) + (count(*) OVER (PARTITION BY first, second, x) - 1) / 2.0 AS x,
            rank() OVER (PARTITION BY first, second ORDER BY y) + (count(*) OVER (PARTITION BY first, second, y) - 1) / 2.0 AS y FROM pairs)"""
        if ranked
        else "pairs"
    )
    return f"""WITH {_HOURLY}, kept AS ({rows}),
        pairs AS (SELECT replace(a.series_id, 'EV/', '') AS first, replace(b.series_id, 'EV/', '') AS second, a.observation_time AS k, a.value AS x, b.value AS y
            FROM kept a JOIN kept b ON a.observation_time = b.observation_time AND a.series_id <= b.series_id),
        names AS (SELECT DISTINCT replace(series_id, 'EV/', '') AS s FROM hourly),
        found AS (SELECT first, second, count(*) AS n, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS r FROM {value} GROUP BY ALL)
        SELECT a.s AS first, b.s AS second, coalesce(n, 0) AS n, CASE WHEN n >= 3 THEN round(least(1.0, greatest(-1.0, r)), 6) + 0.0 END AS coefficient
        FROM names a JOIN names b ON a.s <= b.s LEFT JOIN found f ON f.first = a.s AND f.second = b.s"""


_ALL = "SELECT * FROM hourly"
_COMMON = """SELECT * FROM hourly WHERE observation_time IN (SELECT observation_time FROM hourly GROUP BY ALL
    HAVING count(*) = (SELECT count(DISTINCT series_id) FROM hourly))"""


def _correlation(spark, sf_dir, **options):
    found = dia.correlation(_hourly(spark, sf_dir), **options)
    return found.select("first", "second", "n", (F.round("coefficient", 6) + F.lit(0.0)).alias("coefficient"))


@query(_pairs_sql(_ALL))
def dia_corr_pearson_pairwise(spark, sf_dir):
    return _correlation(spark, sf_dir)


@query(_pairs_sql(_COMMON))
def dia_corr_pearson_listwise(spark, sf_dir):
    return _correlation(spark, sf_dir, deletion="listwise")


@query(_pairs_sql(_ALL, ranked=True))
def dia_corr_spearman(spark, sf_dir):
    return _correlation(spark, sf_dir, method="spearman")


@query(f"""WITH {_HOURLY} SELECT observation_time, """
       + ", ".join(f"round(max(value) FILTER (series_id = 'EV/{s}'), 6) AS \"{s}\"" for s in ("click", "error", "purchase", "view"))
       + " FROM hourly GROUP BY ALL")
def dia_series_pivot(spark, sf_dir):
    names = ["click", "error", "purchase", "view"]
    found = dia.series_table(_hourly(spark, sf_dir), names)
    return found.select("observation_time", *(F.round(n, 6).alias(n) for n in names))
