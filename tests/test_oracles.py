"""Every registered query with SQL against DuckDB at the smallest scale; LEAFMILL_QUICK=1 runs a choice of keys."""

import os

import duckdb
import pytest

from leafmill.registry import load_all
from leafmill.sources.tables import SCHEMAS
from tools.check_oracle import norm

QUERIES = load_all()
SAMPLE = """table_scan file_format html_to_text text_blocks pipe_table_scan tokenize_words scrub_pii redact_with_counts india_ids
word_chunks table_segments metadata_filter metadata_filter_kinds workflow_rules acl_filter speaker_at window_stats percentile_linear
percentile_nearest exact_duplicates running_balance rank_list sliding_rate_limit version_history bm25_score dense_topk hybrid_search
cer triplets train_val_split ks_drift po_match invoice_anomalies risk_rollup iou_pairs paths find_text_span metrics_windows alert_rules""".split()
KEYS = sorted(k for k, q in QUERIES.items() if q.sql and (not os.environ.get("LEAFMILL_QUICK") or k in SAMPLE))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in SCHEMAS:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_same_rows(spark, duck, sf, key):
    df = QUERIES[key](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(QUERIES[key].sql)
    names = [d[0] for d in res.description]
    assert cols == sorted(names)
    order = [names.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in order) for r in res.fetchall())


def test_registry_shape():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(QUERIES) >= 190
    ids = {q.survey_id for q in QUERIES.values()}
    assert {"S1", "F4", "J8", "A1", "W2", "K2", "U1", "M1", "R4", "R8", "C1", "E1", "D1", "X1", "G6", "ST1"} <= ids


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
