import pytest
from conftest import DATA, same, views

from blockstrata.plans import catalog


@pytest.fixture(scope="module")
def con():
    return views()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    same(catalog.queries()[name](spark, DATA), catalog.oracle_sql()[name], con)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_missing_decrements_sees_the_whole_journal(spark, monkeypatch):
    own, seen = catalog.J.missing_decrements, []
    monkeypatch.setattr(catalog.J, "missing_decrements", lambda e, m: seen.append(e) or own(e, m))
    found = catalog.queries()["q14_missing_decrements"](spark, DATA)
    writes = catalog._writes(spark, DATA)
    assert seen[0].select("lbn").distinct().count() == writes.select("lbn").distinct().count()
    assert found.filter("lbn % 7 <> 0").isEmpty()


def test_entry_counts_blocks(spark):
    import __spark_entry__ as e

    row = e.entry(spark).first()
    assert (row.blocks, row.names, row.zeros) == (7676, 7133, 0)
