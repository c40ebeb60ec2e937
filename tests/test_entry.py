import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry_point  # noqa: E402
from check_queries import compare, duck  # noqa: E402


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0 and {"GameTitle", "Participant", "Condition", "rate_trial"} <= set(df.columns)


def test_every_check_query_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query_equals_check_query(spark, con, small_dir, name):
    ok, text = compare(spark, con, small_dir, name)
    assert ok, text
