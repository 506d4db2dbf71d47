"""Every registered query of the core against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from arborfold.plans import access_queries, graph_queries, lookup_queries, problems, service_queries, snapshot_queries, state_queries
from tools import compare

FOLDER = "/root/testdata/sf0.001"
NAMES = [n for m in (problems, graph_queries, state_queries, service_queries, snapshot_queries, access_queries, lookup_queries) for n in m.QUERIES]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    return compare.views(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare.compare(spark, con, FOLDER, name).startswith("equal")


def test_names_and_flagship(spark, con):
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).limit(1).count() == 1
