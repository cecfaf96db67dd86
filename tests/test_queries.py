"""Queries beside their SQL. ``CINDERLOG_ALL=1`` runs every one of them."""

import os

import pytest

import workload
from workload.compare import compare

CATALOG = workload.load_all()
SF_DIR = "/root/testdata/sf0.001"
SAMPLE = (
    "parse_access", "parse_json", "parse_auto", "detect_format", "format_ambiguity", "stats_summary", "endpoint_shares", "latency_percentiles",
    "burst_windows", "session_table", "journeys", "injection_hits", "metrics_long", "evaluate_rules", "incident_evidence", "health_scores",
    "stream_parse", "stream_sessions",
)


def test_every_query_has_sql():
    assert set(CATALOG.QUERIES) == set(CATALOG.ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")
@pytest.mark.parametrize("name", list(CATALOG.QUERIES) if os.environ.get("CINDERLOG_ALL") else SAMPLE)
def test_query_agrees_with_sql(spark, name):
    count, verdict = compare(spark, name, CATALOG.QUERIES[name], CATALOG.ORACLES.get(name), SF_DIR)
    assert verdict == "ok" and count > 0, verdict
