"""Queries with SQL against DuckDB, on the smallest tables; all other queries give rows of a stable schema."""

import duckdb
import pytest

from corpusmill.llm import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    df = Q.queries()[name](spark, DATA)
    rows, columns = df.collect(), sorted(df.columns)
    assert rows
    if name not in Q.oracle_sql():
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    found = con.execute(Q.oracle_sql()[name])
    at = [[c[0] for c in found.description].index(c) for c in columns]
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted("|".join(show(r[c]) for c in columns) for r in rows) == sorted("|".join(show(r[i]) for i in at) for r in found.fetchall())
