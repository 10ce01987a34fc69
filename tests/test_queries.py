"""Every query with SQL gives the same rows as DuckDB; the others give rows."""

import pytest
from helpers import DATA, rows_of

from icuflow.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, wanted = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows_of(got) == rows_of(wanted)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows(spark, name):
    # the smallest tables have no stays outside train
    data = DATA.replace("sf0.001", "sf0.01") if name in ("gbt_score", "sequence_score") else DATA
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_models_without_held_out_stays(spark):
    assert catalog.QUERIES["sequence_score"](spark, DATA).count() == 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
