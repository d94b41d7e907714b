"""Every query of the catalogue against its SQL on the same tables."""

import pytest

from lumaframe.plans import catalogue

from .oracle import compare


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, name):
    compare(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    """Their values are tested in test_brute, test_nights and test_alignments."""
    df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(set(df.columns)) == len(df.columns) and not df.isEmpty()
