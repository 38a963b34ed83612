"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import oracle
import pytest

import __spark_entry__ as entry
from qualityspark import plans
from qualityspark.session import cuts_dropped

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


# Empty at this size: too few runs for a stuck or a second id.
MAY_BE_EMPTY = {"run_lookup", "sequence_conflicts", "page", "collection_listing"}


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    sql = entry.oracle_sql().get(name)
    with cuts_dropped(spark):
        df = entry.queries()[name](spark, FOLDER)
        if sql is None:
            assert df.count() > 0
            return
        diff = oracle.difference(df, con, sql)
    assert diff is None or (diff == "no rows" and name in MAY_BE_EMPTY), diff


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLES)
