"""Every registered query against its SQL on DuckDB, at the smallest scale."""

import pytest
from compare import compare, contract

from ferrywell.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, SMALL) == []


def test_entry_passes(spark):
    verdict = contract.entry(spark).first()
    assert verdict.overall_passed and verdict.row_count_diff == 0 and verdict.source_rows > 0


def test_only_listings_lack_sql():
    assert set(QUERIES) - set(contract.oracle_sql()) == {"list_objects"} and set(QUERIES) <= set(contract.queries())
