"""Every query has a SQL twin, and a sample of them is compared here."""

import duckdb
import pytest

import __spark_entry__ as contract
from scrubline.plans import oracle
from scrubline.plans.queries import QUERIES
from tools.check_oracle import TABLES, compare

SAMPLE = [
    "scrub_conversations", "scrub_hybrid", "residual_risk_documents", "gate_requests", "audit_from_gate",
    "verify_audit", "merge_audit", "latency_p95", "append_rate_sliding", "review_claims",
    "facts_prompt", "stream_gate", "stream_audit_append", "stream_request_rate",
]


@pytest.fixture(scope="module")
def connection(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def test_queries_and_sql_name_the_same_things():
    assert set(QUERIES) == set(oracle.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, connection, sf_dir, name):
    verdict, _, _ = compare(spark, connection, name, sf_dir)
    assert verdict.startswith("ok"), verdict
