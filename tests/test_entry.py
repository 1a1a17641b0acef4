import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship_query(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and {"ticker", "date", "lagged_ncskew"} <= set(df.columns)


@pytest.mark.parametrize("name", ["weekly_returns", "asof_controversies", "class_balance"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("lineitem", "orders", "supplier", "nation", "region"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = contract.queries()[name](spark, FOLDER)
    result = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = sorted((tuple(map(str, r)) for r in result.fetchall()))
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == want
