"""Every registered query against its SQL twin at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    return check.oracle(SF_DIR)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_equals_sql(spark, duck, name):
    note, _, good = check.compare(spark, duck, SF_DIR, name, QUERIES[name], SQL[name])
    assert good or note.startswith("ok rows=0"), note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["label", "flows", "segments", "fwd_bytes", "largest"]
    assert df.count() == 6


def test_oracle_names_are_queries():
    assert set(SQL) <= set(QUERIES)
