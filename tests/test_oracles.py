"""Every core query with SQL gives the rows that DuckDB gives."""

import pytest

from lodestrand.plans import catalog
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, name, FOLDER) == ""


def test_other_queries_run(spark):
    for name in sorted(set(catalog.queries()) - set(catalog.oracles())):
        catalog.queries()[name](spark, FOLDER).count()
