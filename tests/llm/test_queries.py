"""The text queries against their SQL, and their invariants, on the smallest tables."""

import os

import pytest

from arborfold.llm import queries
from tools import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    return compare.views(FOLDER)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    assert compare.compare(spark, con, FOLDER, name).startswith("equal" if name in queries.SQL else tuple("0123456789"))


def test_fill(spark, con):
    rows = queries.p6_fill(spark, FOLDER).collect()
    assert len(rows) == 3 and all(0.9 < r["fill"] <= 1 for r in rows) and len({r["tokens"] for r in rows}) == 1
