"""Every registered query with SQL against an independent engine, and its plan's shape."""

import glob
import math
import os

import duckdb
import pytest

import halyard.plans.catalog  # noqa: F401
from halyard.plans.registry import REGISTRY


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return v if isinstance(v, (bool, str, int)) else float(v)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, sf_dir, duck, name):
    found = REGISTRY[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    sql = REGISTRY[name].oracle()
    if sql is None:
        assert rows
        return
    other = duck.sql(sql)
    assert sorted(other.columns) == columns
    at = [other.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[k]) for k in at) for r in other.fetchall()), key=repr)


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = REGISTRY["O096_ensemble_mean_sem"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1].split(">")[0]


def test_rate_intervals_rest_on_200_resamples(spark, sf_dir):
    assert {r["n"] for r in REGISTRY["O175_rate_bootstrap"](spark, sf_dir).collect()} == {200}
