import oracle
import pytest

from fastaxis.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_meets_its_sql(spark, name):
    assert oracle.difference(registry.QUERIES[name](spark, DATA), registry.ORACLE_SQL[name], oracle.connect(DATA)) == ""
