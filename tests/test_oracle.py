"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import rows_of
from queries import MODULES
from queries.views import TABLES

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# One or more per kind of operator; ORACLE_ALL=1 runs every query, which takes some minutes.
SAMPLE = [
    "summary_trend", "top_rules", "compliance_report", "ai_by_tool", "top_rules_daily",
    "team_heatmap", "mode_rule", "history_dashboard", "sample_stats", "endpoint_signal",
    "match_rules", "scan_code", "scan", "unguarded_routes_js", "suppress_lines", "blend",
    "code_features", "paste_signal", "with_language", "dedup_findings", "minus_baseline",
    "enrich_compliance", "apply_fixes", "preview_fixes", "code_context", "read_sarif",
    "external_semgrep", "report_json", "ingest_findings", "upsert_findings", "validate_findings",
    "stream_trend", "packages", "match_advisories",
]
CHOSEN = sorted(SQL) if os.environ.get("ORACLE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).columns == ["rule_id", "rule_title", "severity", "count"]


def test_every_twin_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    own = {name for m in MODULES for name in m.QUERIES}
    assert own - set(SQL) == {"train_classifier", "model_blend"}  # models, no SQL form


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(SQL[name])
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    assert got == want


def test_model(spark, sf):
    rows = QUERIES["model_blend"](spark, sf).collect()
    assert rows and all(0.0 <= r["blended"] <= 100.0 for r in rows)
