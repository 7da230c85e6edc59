"""Registered queries against DuckDB on the smallest tables. SPANWISE_ALL=1 runs every one."""

import os

import pytest
from oracle import compare, duck

from spanwise.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
CORE = (
    "service_rollup trace_summaries request_dna trace_tree service_edges unchecked_edges merge_counts baseline_verdict baseline_asof "
    "incident_clusters identity_links causality_violations causal_order process_journeys correlate_changes advisory_ranking check_drift "
    "boundary_compatibility investigations verify_recovery case_audit approval_quorum ledger_append ledger_verify settlements redact_text "
    "spans_from_otlp_json packages_from_manifests stream_service_health stream_async_stitch"
).split()
NAMES = sorted(QUERIES) if os.environ.get("SPANWISE_ALL") else CORE


@pytest.mark.skipif(not os.path.isdir(SF), reason="no benchmark tables")
@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, name):
    ok, message = compare(spark, duck(SF), SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, message


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
