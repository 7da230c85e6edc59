"""Queries that answer for all services and measures."""

import os

import pytest
from oracle import compare, duck

from spanwise.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no benchmark tables")


def test_every_service_and_measure(spark):
    for name in ("journey_rti", "storage_report"):
        ok, message = compare(spark, duck(SF), SF, name, QUERIES[name], ORACLES[name])
        assert ok, message
    row = QUERIES["journey_rti"](spark, SF).first()
    assert row["weighted_rti"] is None and row["journeys"] == 4
    assert {r["measure"] for r in QUERIES["storage_report"](spark, SF).collect()} == {"traces", "spans", "bytes"}
