import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_sql(spark, name):
    sql = __spark_entry__.oracle_sql()[name]
    con = duckdb.connect()
    for table in ("part", "events", "documents", "embeddings", "supplier"):
        con.sql(f"CREATE VIEW {table} AS FROM '{SF}/{table}.parquet'")
    want = con.sql(sql)
    cols = sorted(want.columns)
    got = __spark_entry__.queries()[name](spark, SF)
    assert sorted(got.columns) == cols
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(want.select(*cols).fetchall(), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
