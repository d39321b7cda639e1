"""Every registered query against its SQL on the smallest data set."""

import importlib.util
import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FOLDER = os.environ.get("LARDER_TEST_DATA", "/root/testdata/sf0.001")

spec = importlib.util.spec_from_file_location("check_queries", os.path.join(ROOT, "tools", "check_queries.py"))
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

from larder.queries import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    state, _, _ = check.compare(spark, con, name, QUERIES[name], SQL.get(name), FOLDER)
    assert state.startswith(("ok", "rows-only")), state


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
