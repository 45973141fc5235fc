"""Registered queries of the subpackage against DuckDB, and the shape of the registry."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from leafmill.llm.registry import load_all
from leafmill.sources.tables import SCHEMAS
from tools.check_oracle import norm

QUERIES = load_all()


@pytest.mark.parametrize("key", sorted(k for k, (_, sql) in QUERIES.items() if sql))
def test_same_rows(spark, sf, key):
    con = duckdb.connect()
    for t in SCHEMAS:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    fn, sql = QUERIES[key]
    df = fn(spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert cols == sorted(names)
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())


def test_one_query_for_each_operator():
    keys = set(entry.queries())
    assert {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 14)} and len(QUERIES) == 13
    assert set(QUERIES) | {"pipeline"} <= keys
    assert len(corpus_pipeline.STAGES) == 5
