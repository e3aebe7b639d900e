"""Every query beside its SQL, on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from vintara.plans import registry

registry.load()
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(value):
    """A cell as it is compared: floats to nine digits, times without a zone."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}" if value else "0"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, bytearray):
        return bytes(value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    with duckdb.connect() as con:
        con.execute("SET TimeZone = 'UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        yield con


#: Queries over the same ledger take seconds each; one of each kind is run unless all are asked for.
SLOW = ("met_cer", "met_ann", "met_sharpe", "met_max", "met_cum", "met_core", "exp_hold", "cmp_table", "ptf_ledger_weights")
NAMES = [n for n in sorted(registry.ORACLES) if os.environ.get("TEST_ALL") or not n.startswith(SLOW)]


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_its_sql_gives(spark, sf_dir, duck, name):
    got = entry.queries()[name](spark, sf_dir)
    want = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())
