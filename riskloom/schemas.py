"""Fixed schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


_S, _I, _L, _F, _D = StringType(), IntegerType(), LongType(), FloatType(), DoubleType()
_LIST = ArrayType(_S)

CORPUS = _struct(("path", _S), ("language", _S), ("content", _S))

RULE = _struct(
    ("id", _S), ("title", _S), ("severity", _S), ("confidence", _F), ("languages", _LIST),
    ("category", _S), ("cwe_id", _S), ("owasp_category", _S), ("ai_tendency", _S),
    ("tags", _LIST), ("fix_suggestion", _S), ("pattern_any", _LIST), ("pattern_all", _LIST),
    ("pattern_not", _LIST), ("negative_patterns", _LIST),
)

FINDING = _struct(
    ("id", _S), ("title", _S), ("severity", _S), ("file", _S), ("line", _I), ("column", _I),
    ("snippet", _S), ("ai_confidence", _F), ("risk_score", _F), ("category", _S),
    ("cwe_id", _S), ("owasp_category", _S), ("tags", _LIST), ("ai_tendency", _S),
    ("fix_suggestion", _S),
)

SCAN = _struct(
    ("scan_id", _S), ("timestamp", TimestampType()), ("org_id", _S), ("team_id", _S),
    ("repo_id", _S), ("repo_name", _S), ("target_path", _S), ("branch", _S), ("commit_sha", _S),
    ("ci_run_id", _S), ("cli_version", _S), ("total_findings", _I), ("critical_count", _I),
    ("high_count", _I), ("medium_count", _I), ("low_count", _I), ("info_count", _I),
    ("ai_estimated_count", _I), ("ai_ratio", _F), ("scan_duration_ms", _I),
    ("files_scanned", _I), ("rules_loaded", _I), ("user_email", _S),
    ("scan_date", DateType()),
)

STORED_FINDING = _struct(
    ("scan_id", _S), ("finding_hash", _S), ("rule_id", _S), ("rule_title", _S),
    ("severity", _S), ("file_path", _S), ("line_number", _I), ("snippet", _S),
    ("ai_confidence", _F), ("ai_tendency", _S), ("fix_suggestion", _S), ("cwe_id", _S),
    ("owasp_category", _S), ("first_seen", TimestampType()), ("last_seen", TimestampType()),
    ("times_seen", _L), ("is_fixed", BooleanType()), ("fixed_at", TimestampType()),
)

INGEST_FINDING = _struct(
    ("rule_id", _S), ("rule_title", _S), ("severity", _S), ("file_path", _S),
    ("line_number", _I), ("snippet", _S), ("ai_confidence", _F), ("ai_tendency", _S),
    ("fix_suggestion", _S), ("cwe_id", _S), ("owasp_category", _S),
)

INGEST = _struct(
    ("org_id", _S), ("team_id", _S), ("repo_id", _S), ("repo_name", _S), ("branch", _S),
    ("commit_sha", _S), ("target_path", _S), ("cli_version", _S), ("ci_run_id", _S),
    ("user_email", _S),
    ("scan_result", _struct(
        ("total_findings", _I), ("critical", _I), ("high", _I), ("medium", _I), ("low", _I),
        ("info", _I), ("ai_estimated_count", _I), ("scan_duration_ms", _I),
        ("files_scanned", _I), ("rules_loaded", _I), ("findings", ArrayType(INGEST_FINDING)),
    )),
)

HISTORY = _struct(
    ("timestamp", _L), ("target", _S), ("total", _L), ("critical", _L), ("high", _L),
    ("medium", _L), ("low", _L), ("info", _L), ("ai_estimated", _L), ("top_rule", _S),
)

PACKAGE = _struct(("name", _S), ("version", _S), ("ecosystem", _S), ("manifest_file", _S))

# Reports -------------------------------------------------------------------------------------

_BY_SEVERITY = _struct(("critical", _D), ("high", _D), ("medium", _D), ("low", _D), ("info", _D))

REPORT_JSON = _struct(
    ("summary", _struct(
        ("total", _D), ("scanned_files", _L), ("matched_rules", _L), ("dedup_mode", _S),
        ("original_total", _L), ("deduped_total", _L), ("ai_estimated", _D),
        ("top_pattern", _S), ("by_severity", _BY_SEVERITY),
    )),
    ("findings", ArrayType(_struct(
        ("id", _S), ("title", _S), ("severity", _S), ("file", _S), ("line", _I), ("column", _I),
        ("snippet", _S), ("ai_confidence", _D), ("risk_score", _D), ("category", _S),
        ("cwe_id", _S), ("owasp_category", _S), ("ai_tendency", _S), ("fix_suggestion", _S),
        ("tags", _LIST),
    ))),
)

_SARIF_LOCATION = _struct(("physicalLocation", _struct(
    ("artifactLocation", _struct(("uri", _S))),
    ("region", _struct(("startLine", _I), ("startColumn", _I))),
)))

SARIF = _struct(("version", _S), ("runs", ArrayType(_struct(
    ("results", ArrayType(_struct(
        ("ruleId", _S), ("level", _S), ("message", _struct(("text", _S))),
        ("locations", ArrayType(_SARIF_LOCATION)),
        ("properties", _struct(
            ("aiConfidence", _D), ("riskScore", _D), ("category", _S), ("tags", _LIST),
        )),
    ))),
))))

# External analyzers. Strings keep a value of another JSON type readable as text.
SEMGREP = _struct(("results", ArrayType(_struct(
    ("check_id", _S), ("path", _S), ("start", _struct(("line", _I), ("col", _I))),
    ("extra", _struct(("message", _S), ("lines", _S), ("severity", _S))),
))))

BANDIT = _struct(("results", ArrayType(_struct(
    ("test_id", _S), ("issue_text", _S), ("filename", _S), ("line_number", _I),
    ("col_offset", _I), ("code", _S), ("issue_severity", _S),
))))

ESLINT = ArrayType(_struct(
    ("filePath", _S),
    ("messages", ArrayType(_struct(
        ("ruleId", _S), ("message", _S), ("line", _I), ("column", _I), ("severity", _I),
        ("source", _S),
    ))),
))

ADVISORY = _struct(
    ("id", _S), ("summary", _S),
    ("severity", ArrayType(_struct(("type", _S), ("score", _S)))),
    ("database_specific", _struct(("severity", _S))),
    ("affected", ArrayType(_struct(
        ("package", _struct(("name", _S), ("ecosystem", _S))),
        ("versions", _LIST),
        ("ranges", ArrayType(_struct(
            ("type", _S),
            ("events", ArrayType(_struct(
                ("introduced", _S), ("fixed", _S), ("last_affected", _S),
            ))),
        ))),
    ))),
)

PROBE = _struct(
    ("iteration", _I), ("endpoint", _S), ("code", _S), ("latency_ms", _D),
    ("total_findings", _D), ("coverage_pct", _D),
)
