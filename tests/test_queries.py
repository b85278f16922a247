"""Every registered query against its SQL on the smallest data set."""

import os

import pytest

import compare
from cinderview.plans.catalog import CHECKS, QUERIES
from cinderview.session import apply_settings

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_sql(spark, con, name):
    df = QUERIES[name](apply_settings(spark), SF_DIR)
    assert compare.differences(df, con, CHECKS[name]) == ""


def test_every_query_has_a_check():
    assert set(CHECKS) == set(QUERIES)
