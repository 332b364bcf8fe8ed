"""Every query of the catalog against its SQL, and the entry."""

import __spark_entry__
import oracle
import pytest

from fastaxis.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_meets_its_sql(spark, con, name):
    assert oracle.difference(catalog.QUERIES[name](spark, DATA), catalog.ORACLE_SQL[name], con) == ""


def test_every_query_is_registered():
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and all((r.error is None) == (r.ev_phi is not None) for r in rows)
