"""Every query of the subpackage with SQL gives the rows that DuckDB gives; the others run."""

import pytest

from lodestrand.llm import catalog
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, name, FOLDER) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracles())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() >= 0
