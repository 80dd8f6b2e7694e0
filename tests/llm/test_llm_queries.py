import pytest
from compare import assert_same, connect

from callweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name])
