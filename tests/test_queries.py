"""Every registered query next to its SQL, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import canonical, engine

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return engine(FOLDER)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = con.execute(sql).df()
    a, b = canonical(got), canonical(want)
    assert list(a.columns) == list(b.columns) and a.equals(b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
