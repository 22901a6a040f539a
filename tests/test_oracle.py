"""Every query of the library beside its DuckDB SQL, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from corpusloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


def rows(columns, records):
    order = sorted(columns)
    return order, sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    found = duck.execute(plans.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert plans.QUERIES[name](spark, SF).count() >= 0
