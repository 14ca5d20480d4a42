import pytest
from oracle import connect, same

from sparkloom.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracles()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_its_twin(spark, sf, con, name):
    out = QUERIES[name](spark, sf)
    if name in ORACLES:
        same(out, con, ORACLES[name])
    else:
        assert out.count() > 0
