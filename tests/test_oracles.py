"""Every query with an SQL twin gives the same rows as the twin."""

import pytest

import __spark_entry__ as contract
from tests.compare import connect, difference

ORACLES = contract.oracle_sql()
SLOW = {"nb_grid", "lr_certificate", "embedding_certificate"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(contract.queries())


@pytest.mark.parametrize("name", [pytest.param(n, marks=pytest.mark.slow) if n in SLOW else n for n in ORACLES])
def test_same_rows(spark, sf, con, name):
    assert difference(contract.queries()[name](spark, sf), con, ORACLES[name]) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:5] == ["doc_id", "category", "fold", "predicted_label", "confidence"]
    assert df.count() > 0
