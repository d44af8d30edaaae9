"""Every core query against its SQL, over the smallest tables."""

import importlib

import pytest
import util

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
MODULES = [importlib.import_module(m) for m in entry.CORE]
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.ORACLE.items()}


@pytest.fixture(scope="module")
def con():
    return util.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    util.same_as_sql(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() == 49
