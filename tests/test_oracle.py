"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as e
from tests.compare import compare, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle(SF)


@pytest.mark.parametrize("name", list(e.queries()))
def test_query(spark, duck, name):
    df = e.queries()[name](spark, SF)
    text = e.oracle_sql().get(name)
    if text is None:
        assert df.count() > 0
    else:
        assert compare(df, duck, text) is None


def test_entry(spark):
    assert e.entry(spark).count() == 1


def test_oracles_belong_to_queries():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_golden_counts(spark):
    """Counts worked out in advance at sf 0.001."""
    similar = e.queries()["cross_sell_similar"](spark, SF).first()
    exact = e.queries()["cross_sell_similar_default"](spark, SF).first()
    assert (similar.cohort_size, similar.cross_sell_count) == (26, 18)
    assert (exact.cohort_size, exact.cross_sell_count) == (26, 9)
