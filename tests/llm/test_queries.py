import os

import check
import duckdb
import pytest

from crowdlens.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
#: Result columns that the contract names and rows that each query must return.
COLUMNS = {
    "op1": ("documents", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"),
    "op2": ("documents", "doc_id n_words n_base first_word last_word base_labels labels score"),
    "op3": ("documents", "doc_id held_out score predicted"),
    "op4": ("documents", "doc_id n_words n_hit n_items items_sha256 contaminated"),
    "op5": ("documents", "doc_id n_email n_ip n_card n_phone base_sha256 spans"),
    "op6": ("documents", "doc_id n_tokens bucket bucket_length batch slot padding over_budget"),
    "op7": ("pages", "page_id host path rule verdict"),
    "op8": ("pages", "page_id payload_bytes payload_digest record_type refers_to"),
    "op9": ("documents", "doc_id n_shingles component_id"),
    "op10": (None, "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars"),
    "op11": ("embeddings", "vec_id cluster distance cluster_inertia inertia centroid_sha256"),
    "op12": ("documents", "doc_id n_features weight score rank"),
    "op13": (None, "query_id rank vec_id score"),
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    rows = frame.collect()
    table, columns = COLUMNS[name.split("_")[0]]
    assert set(columns.split()) <= set(frame.columns)
    if table:
        assert len(rows) == duck.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    if name in queries.ORACLES:
        result = duck.execute(queries.ORACLES[name])
        names = [item[0] for item in result.description]
        assert sorted(frame.columns) == sorted(names)
        assert check.rows_of(frame.columns, rows) == check.rows_of(names, result.fetchall())
