"""Queries of the training-data operators beside their DuckDB SQL, on the smallest tables."""

import duckdb
import pytest

from corpusloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, found.fetchall()))
