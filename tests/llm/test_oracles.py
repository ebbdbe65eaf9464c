"""The SQL of operators that have some gives the same rows."""

import duckdb
import pytest

from versefold.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    ours, sql = registry.queries()[name](spark, sf).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    cols = sorted(ours.columns)
    assert cols == sorted(sql.columns)
    assert sorted(map(tuple, ours[cols].astype(str).values)) == sorted(map(tuple, sql[cols].astype(str).values))
