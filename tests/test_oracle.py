"""Every query with SQL gives the rows that DuckDB gives for it; the others run."""

import math
import os

import duckdb
import pytest

from lakeweave.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name not in registry.ORACLES:
        assert columns
        return
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted((tuple(map(plain, r)) for r in rows), key=repr) == sorted(want, key=repr)


def test_plans_shuffle_no_more_than_needed(spark, sf):
    """Triage is one projection over the scan; rules are broadcast."""
    plan = registry.triaged(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
