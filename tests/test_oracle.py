"""Every registered ledger query against its DuckDB oracle on the smallest driver folder."""

import datetime as dt
import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from carrierbook.plans import catalog
from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return con


ORACLE = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = catalog.run(spark, SF_SMALL, name)
    rows = df.collect()
    cols = df.columns
    cur = duck.execute(ORACLE[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    si = sorted(range(len(cols)), key=lambda i: cols[i])
    oi = sorted(range(len(ocols)), key=lambda i: ocols[i])
    assert Counter(tuple(_norm(r[i]) for i in si) for r in rows) == Counter(tuple(_norm(r[i]) for i in oi) for r in orows)


def test_every_query_runs_and_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["department_id", "department", "ins", "outs", "saldo"]
    assert df.count() == 6
    for name in set(catalog.query_callables()) - set(ORACLE):
        assert catalog.run(spark, SF_SMALL, name).count() >= 0
