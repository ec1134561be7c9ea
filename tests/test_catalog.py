"""Registered queries against their SQL on the smallest tables."""


import duckdb
import pytest
from conftest import SF

import __spark_entry__ as contract
from caseloom.catalog import load
from tools.check_oracle import TABLES, rows_of

NAMES = [
    "decision_place_report", "csv_event_log", "category_tokens", "item_seconds_since_earlier_event", "window_masks",
    "encoded_window_rows", "decision_samples", "held_out_place_diagnostics", "argmax_suffixes", "sampled_suffixes",
    "guided_decode_rows", "edit_distances", "attribute_checks", "semantic_loss",
]


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    entry = load()[name]
    df = entry.run(spark, SF)
    cur = con.execute(entry.sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
