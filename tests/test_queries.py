"""Registered queries against their SQL, and the driver contract."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from checks.compare import connect, differences

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "detector_events", "observation_records", "observation_members", "quality_gate_bypass",
    "shortlist", "session_enrichment", "evidence_rows", "findings_upsert", "trend_states",
    "reconciliation_plan", "generation_projection", "actionable_trends", "detector_yield",
    "validate_results", "invalid_transitions", "slot_coverage",
    "domain_audit", "application_change", "stream_events", "stream_sequence_detectors",
    "stream_trends", "append_new_history", "latest_rows", "membership_key", "shell_words",
    "contract_fingerprint", "contract_stop", "write_results", "emit_events", "remote_presence",
    "review_batches", "activity_snapshots", "tool_loop",
]
NAMES = sorted(entry.queries()) if os.environ.get("TRACEFOLD_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    text = entry.oracle_sql().get(name)
    if text is None:
        assert df.count() > 0
    else:
        assert differences(df, con, text) == []


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
