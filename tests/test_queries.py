import os

import duckdb
import pytest

import __spark_entry__ as entry
from canlake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


def values(df):
    cols = sorted(df.columns)
    rows = df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)
    return cols, sorted(map(str, rows))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert values(catalog.queries()[name](spark, sf).toPandas()) == values(con.execute(catalog.oracle_sql()[name]).df())


def test_entry(spark, sf):
    assert os.path.isdir(sf) and entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.SQL) <= set(entry.oracle_sql())
