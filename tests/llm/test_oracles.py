"""The registered queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from mnemora.llm.queries import ORACLE_SQL, QUERIES
from tests.test_oracles import KINDS, table


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    df = QUERIES[name](spark, d)
    want = con.execute(ORACLE_SQL[name])
    kinds = {c[0]: str(c[1]) for c in want.description}
    assert {c: KINDS.get(k, k) for c, k in df.dtypes} == kinds
    assert table(df.columns, df.collect()) == table(list(kinds), want.fetchall())
