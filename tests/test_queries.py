"""Each query against its SQL over the smallest tables."""

import pytest
from conftest import SF, rows

from quayside.plans import advice, advice_oracle, more, more_oracle, oracle
from quayside.plans import queries as plans


@pytest.fixture(scope="module", autouse=True)
def parsed_once(spark):
    """The fields of the papers and the comparison are the same in all queries: made once for all tests."""
    mp = pytest.MonkeyPatch()
    for name in ("fields", "firsts", "results"):
        held = getattr(plans, name)(spark, SF).persist()
        mp.setattr(plans, name, lambda *_, held=held: held)
    yield
    mp.undo()


def queries():
    return plans.queries() | more.queries() | advice.queries()


def oracle_sql():
    return oracle.oracle_sql() | more_oracle.oracle_sql() | advice_oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = queries()[name](spark, SF).toPandas()
    want = duck.sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_fuzzy_terms_find_misread_titles(spark):
    got = queries()["fuzzy_terms"](spark, SF).toPandas()
    assert len(got) == 6000 and sorted(set(got.term)) == ["bill of lading", "commercial invoice", "import declaration", "packing list"] and got.ratio.between(0.82, 1).all()


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
