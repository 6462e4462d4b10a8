"""A cross-section of the registered queries against their SQL; check_queries.py runs them all."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from catalogue.registry import ORACLES, QUERIES
from check_queries import TABLES, compare

SF_DIR = "/root/testdata/sf0.001"
NAMES = [
    "evaluate_model_any_ids", "evaluation_sweep", "match_flags_by_id", "cumulative_curve_of_lines", "shortlist_codes", "group_membership",
    "confusion_matrix", "split_retained", "append_latency_results", "clean_code_sets_five_digits",
    "evaluate_repeated_ids", "curves_repeated_ids", "split_repeated_keys", "skip_repeated_keys", "read_free_text", "cumulative_curve_of_prices",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, con, name):
    assert compare(spark, con, name, SF_DIR)[0].startswith("ok")


def test_every_query_of_the_catalogue_has_its_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
