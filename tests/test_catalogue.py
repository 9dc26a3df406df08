"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest

from loomframe.plans import catalogue
from tests.differential import oracle, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert name in catalogue.ORACLES
    assert not same(got, oracle(SF, catalogue.ORACLES[name]))
