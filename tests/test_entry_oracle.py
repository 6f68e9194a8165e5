import duckdb
import pytest

from dupescope.plans.oracle import oracle_sql as _oracle_sql

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages conversations".split()


def _norm(v):
    if isinstance(v, float):
        return repr(round(v, 6))  # minus zero is not zero
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def test_entry_smoke(spark):
    from __spark_entry__ import entry, oracle_sql, queries
    rows = entry(spark).collect()
    assert len(rows) == 6
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(_oracle_sql()))
def test_matches_duckdb_oracle(spark, name):
    from __spark_entry__ import oracle_sql, queries
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = queries()[name](spark, SF)
    rel = con.sql(oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in sdf.columns]
    s_rows = sorted((tuple(_norm(x) for x in r) for r in sdf.collect()), key=repr)
    d_rows = sorted((tuple(_norm(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert s_rows == d_rows
