"""Every registered query against its SQL, on whole tables."""

import pytest

from catalog.check import difference, duck
from catalog.oracles import ORACLES
from catalog.queries import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, con, name):
    got = REGISTRY[name](spark, SF).toPandas()
    want = con.execute(ORACLES[name]).df()
    assert difference(got, want) is None


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark)
    assert rows.count() == 40
    assert set(e.queries()) >= set(REGISTRY)
