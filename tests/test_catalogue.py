"""Every query of the catalogue runs, and equals its SQL where it has any."""

import pytest

from strataloom.plans import catalogue

from .compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.SQL:
        assert difference(df, con, catalogue.SQL[name]) == ""
    else:
        assert df.count() >= 0
