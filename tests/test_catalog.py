import os

import duckdb
import pytest

import __spark_entry__ as entry
import check
from crowdlens.catalog import all_queries

FOLDER = "/root/testdata/sf0.001"
# Queries that are quick and cover each module; `python check.py` runs all of them at any scale.
QUICK = (
    "review_queue_top", "hash_repeats", "score_accounts", "scoring_parity_mismatch", "review_labeled", "split_leakage",
    "multilabel_report", "rolling_latency", "term_stats", "tfidf", "chi2_select", "vocab_sweep", "fit_gbt", "text_svd", "transform_review", "stream_events", "norm_ppf",
    "hash_sample", "bounded_sample", "grouped_split_xxhash64", "latency_summary_nulls", "rolling_latency_nulls",
    "latency_summary_sketch", "stream_last_n_latency", "stream_log_lag", "label_delta_regression", "landing_manifest", "stream_report", "split_summary", "cdf_breakpoints_sketch",
    "rating_deviation", "reviewer_signals", "burstiness", "duplication", "label_vocabulary", "attach_labels",
)


def test_every_query_has_a_check():
    """Of the library's own queries; those of training-data operators have tests of their own."""
    assert set(all_queries.QUERIES) == set(all_queries.ORACLES)
    assert set(all_queries.QUERIES) <= set(entry.queries()) and set(all_queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for table in check.TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = duck.execute(entry.oracle_sql()[name])
    columns = [item[0] for item in result.description]
    frame = entry.queries()[name](spark, FOLDER)
    assert sorted(frame.columns) == sorted(columns)
    assert check.rows_of(frame.columns, frame.collect()) == check.rows_of(columns, result.fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
