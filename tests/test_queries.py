"""Every registered query against its checking SQL on the given tables."""

import os

import pytest
from compare import connect, differences

from millrace.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_agrees(spark, db, name):
    problem = differences(
        spark, db, name, catalog.QUERIES[name], catalog.ORACLES[name], SF_DIR
    )
    assert problem is None, problem


def test_every_query_is_checked():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
