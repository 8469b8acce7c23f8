import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from recollect.plans.registry import ORACLES, QUERIES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if v.__class__.__name__ == "Decimal":
        return repr(float(v))
    return repr(v)


@pytest.fixture(scope="module")
def sql(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view \"{os.path.basename(p)[:-8]}\" as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, sql, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in ORACLES:
        r = sql.sql(ORACLES[name])
        assert sorted(d[0] for d in r.description) == columns
        names = [d[0] for d in r.description]
        assert got == sorted(tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_prune_and_push(spark, data):
    """Filters and columns reach the scan."""
    plan = QUERIES["event_filter"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(type,message)" in plan and "result" not in plan.split("ReadSchema")[1]
