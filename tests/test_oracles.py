"""Every registered query of the engine against its DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from mnemora import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        path = f"{D}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"create view {t} as select * from read_parquet('{path}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    want = duck.execute(catalog.ORACLE_SQL[name])
    kinds = {c[0]: str(c[1]) for c in want.description}
    assert {c: KINDS.get(k, k) for c, k in df.dtypes} == kinds
    assert table(df.columns, df.collect()) == table(list(kinds), want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, D).count() > 0
