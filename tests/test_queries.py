import pytest

from pubscope.plans import ORACLES, QUERIES
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, data, con, name):
    same(QUERIES[name](spark, data), con, ORACLES[name])


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_views_are_no_smaller_without_their_own_filter(spark, data):
    rows = {r["view"]: r["records"] for r in QUERIES["dashboard_views"](spark, data).collect()}
    assert all(rows[v] >= rows["all"] for v in rows)


def test_year_segments_never_exceed_the_total(spark, data):
    rows = QUERIES["stacked_years"](spark, data).collect()
    by = {}
    for r in rows:
        by.setdefault(r["year"], [r["total"], 0])[1] += r["count"]
    assert all(total >= s for total, s in by.values())
    assert sorted(by) == list(range(min(by), max(by) + 1))
