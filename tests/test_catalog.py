"""Every registered query against its SQL, value by value."""

import pytest

import __spark_entry__ as entry_points
from checks import catalog
from checks.compare import difference

# At the smallest scale nothing is found in these; larger scales have rows.
MAY_BE_EMPTY = {"e10_scan_pages_deep", "e17_scan_distinct_content"}


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    problem = difference(spark, duck, sf_dir, name)
    if problem == "no rows" and name in MAY_BE_EMPTY:
        problem = None
    assert problem is None


def test_entry_points(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    found = entry_points.entry(spark)
    assert found.columns[:5] == ["rule_id", "type", "value", "file", "line"]
    assert found.count() > 0


def test_every_family_is_registered():
    assert sorted(k[:3] for k in catalog.QUERIES if k[0] == "d") == [f"d{n:02}" for n in range(1, 18)]
