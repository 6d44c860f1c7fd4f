"""Queries over reports: reading, normalising, summarising and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import views as v
from queries.dashboards import AS_OF, ORG, report_cte
from queries.scanning import score
from queries.selection import _SCANNER
from queries.sqlparts import exact, rank, score1
from riskloom.operators import analytics as an
from riskloom.operators import findings as fd
from riskloom.sinks import documents as doc
from riskloom.sinks import notices as nt
from riskloom.sinks.tables import compliance_table
from riskloom.sources import reports as rp

QUERIES: dict = {}
SQL: dict = {}

# One report per finding row: the row and, for odd orders, a bare second entry.
_ODD = "orderkey % 2 = 1"


def _native(spark, sf) -> DataFrame:
    f = v.scanner_findings(spark, sf)
    none = F.lit(None)
    first = F.struct(
        "id", "title", "severity", F.when(F.col("line") != 4, F.col("file")).alias("file"),
        F.when(F.col("line") != 5, F.col("line")).alias("line"), "column", "snippet",
        score("ai_confidence"), score("risk_score"), "category", "tags")
    second = F.struct(
        F.lit("SECOND").alias("id"), F.lit("bare").alias("title"), F.lit("low").alias("severity"),
        none.cast("string").alias("file"), none.cast("int").alias("line"),
        F.lit(1).alias("column"), F.lit("").alias("snippet"), F.lit(99.5).alias("ai_confidence"),
        F.lit(1.5).alias("risk_score"), none.cast("string").alias("category"),
        F.array().cast("array<string>").alias("tags"))
    entries = F.when(F.expr(_ODD), F.array(first, second)).otherwise(F.array(first))
    summary = F.struct(
        F.when(F.col("line") == 1, F.lit(7)).alias("total"),
        F.when(F.col("line") == 2, F.lit("TOP-1")).alias("top_pattern"),
        F.struct(F.lit(2).alias("critical"), F.col("line").alias("low")).alias("by_severity"))
    return f.select("orderkey", "line", F.col("column").alias("col_no"),
                    F.to_json(F.struct(summary.alias("summary"), entries.alias("findings")))
                    .alias("payload"))


def _sarif(spark, sf) -> DataFrame:
    f = v.scanner_findings(spark, sf)
    level = (F.when(F.col("severity").isin("critical", "high"), "error")
             .when(F.col("severity") == "medium", "Warning")
             .when(F.col("severity") == "low", "note"))
    place = F.array(F.struct(F.struct(
        F.struct(F.col("file").alias("uri")).alias("artifactLocation"),
        F.struct(F.when(F.col("line") != 5, F.col("line")).alias("startLine")).alias("region"),
    ).alias("physicalLocation")))
    result = F.struct(
        F.col("id").alias("ruleId"), level.alias("level"),
        F.struct(F.col("title").alias("text")).alias("message"),
        F.when(F.col("line") != 4, place).alias("locations"),
        F.struct(score("ai_confidence").alias("aiConfidence"), "category").alias("properties"))
    run = F.struct(F.when(F.expr(_ODD), F.array(result, result)).otherwise(F.array(result))
                   .alias("results"))
    return f.select("orderkey", "line", F.col("column").alias("col_no"),
                    F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs")))
                    .alias("payload"))


QUERIES["read_report_json"] = lambda spark, sf: rp.report_findings(
    _native(spark, sf).select("orderkey", "payload")).select(
    "orderkey", "id", "severity", "file", F.col("line").alias("at"), score("ai_confidence"),
    score("risk_score"), "category")
SQL["read_report_json"] = f"""{_SCANNER} SELECT orderkey, rule_id AS id, severity,
  CASE WHEN line = 4 THEN 'unknown' ELSE file END AS file, CASE WHEN line = 5 THEN 1 ELSE line END AS at,
  {score1('ai_confidence')} AS ai_confidence, {score1('risk_score')} AS risk_score, category FROM s
UNION ALL SELECT orderkey, 'SECOND', 'low', 'unknown', 1, 99.5::DOUBLE, 1.5::DOUBLE, NULL FROM s
WHERE {_ODD}"""

QUERIES["read_sarif"] = lambda spark, sf: rp.sarif_results(
    _sarif(spark, sf).select("orderkey", "payload")).select(
    "orderkey", "id", "level", "message", "file", F.col("line").alias("at"), "ai_confidence",
    "category")
_LEVEL = ("CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' "
          "THEN 'Warning' WHEN severity = 'low' THEN 'note' END")
SQL["read_sarif"] = f"""{_SCANNER} SELECT orderkey, rule_id AS id, {_LEVEL} AS level, title AS message,
  CASE WHEN line = 4 THEN 'unknown' ELSE file END AS file,
  CASE WHEN line IN (4, 5) THEN 1 ELSE line END AS at, {score1('ai_confidence')} AS ai_confidence,
  coalesce(category, 'uncategorized') AS category
FROM s, (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR {_ODD}"""

QUERIES["baseline_keys"] = lambda spark, sf: rp.baseline_rows(
    _native(spark, sf).select("payload").unionByName(_sarif(spark, sf).select("payload")))
SQL["baseline_keys"] = f"""{_SCANNER}, k AS (
  SELECT CASE WHEN line = 4 THEN 'unknown' ELSE file END AS file, CASE WHEN line = 5 THEN 1 ELSE line END
    AS line, category FROM s
  UNION ALL SELECT 'unknown', 1, NULL FROM s WHERE {_ODD}
  UNION ALL SELECT CASE WHEN line = 4 THEN 'unknown' ELSE file END,
    CASE WHEN line IN (4, 5) THEN 1 ELSE line END, category FROM s)
SELECT DISTINCT lower(file) AS file, line, lower(coalesce(category, 'uncategorized')) AS category FROM k"""

# Summary of mixed reports --------------------------------------------------------------------


def _mixed(spark, sf) -> DataFrame:
    a = _native(spark, sf).where("orderkey % 3 > 0")
    return a.unionByName(_sarif(spark, sf).where("orderkey % 3 = 0"))


QUERIES["summarize_report"] = lambda spark, sf: rp.summarize_report(
    _mixed(spark, sf).select("orderkey", "line", "col_no", "payload"))
_N = f"CASE WHEN {_ODD} THEN 2 ELSE 1 END"
SQL["summarize_report"] = f"""{_SCANNER} SELECT orderkey, line, "column" AS col_no,
  (CASE WHEN line = 1 THEN 7 ELSE {_N} END)::BIGINT AS total, 2::BIGINT AS critical, 0::BIGINT AS high,
  0::BIGINT AS medium, line::BIGINT AS low, 0::BIGINT AS info,
  (CASE WHEN ai_confidence >= 70 THEN 1 ELSE 0 END + CASE WHEN {_ODD} THEN 1 ELSE 0 END)::BIGINT
    AS ai_estimated, CASE WHEN line = 2 THEN 'TOP-1' ELSE rule_id END AS top_rule
FROM s WHERE orderkey % 3 > 0
UNION ALL SELECT orderkey, line, "column", ({_N})::BIGINT, 0,
  (CASE WHEN severity IN ('critical', 'high') THEN {_N} ELSE 0 END)::BIGINT,
  (CASE WHEN severity = 'medium' THEN {_N} ELSE 0 END)::BIGINT,
  (CASE WHEN severity = 'low' THEN {_N} ELSE 0 END)::BIGINT,
  (CASE WHEN severity = 'info' THEN {_N} ELSE 0 END)::BIGINT,
  (CASE WHEN ai_confidence >= 70 THEN {_N} ELSE 0 END)::BIGINT, rule_id
FROM s WHERE orderkey % 3 = 0"""

# External analyzers --------------------------------------------------------------------------


def _semgrep(spark, sf) -> DataFrame:
    f = v.scanner_findings(spark, sf)
    raw = (F.when(F.col("severity") == "critical", "ERROR").when(F.col("severity") == "info", "odd")
           .when(F.col("severity") == "low", "Info"))
    result = F.struct(
        F.concat(F.lit("py.lang/"), "id", F.lit("..")).alias("check_id"), F.col("file").alias("path"),
        F.struct("line", F.when(F.col("column") > 3, F.col("column")).alias("col")).alias("start"),
        F.struct(F.when(F.col("line") != 2, F.col("title")).alias("message"),
                 F.when(F.col("line") < 6, F.concat(F.lit("  "), "snippet")).alias("lines"),
                 raw.alias("severity")).alias("extra"))
    return f.select("orderkey", F.to_json(F.struct(F.array(result).alias("results")))
                    .alias("payload"))


def _bandit(spark, sf) -> DataFrame:
    f = v.scanner_findings(spark, sf)
    result = F.struct(
        F.col("id").alias("test_id"), F.col("title").alias("issue_text"),
        F.when(F.col("line") != 3, F.col("file")).alias("filename"),
        F.col("line").alias("line_number"), F.lit("   ").alias("code"),
        F.upper("severity").alias("issue_severity"))
    return f.select("orderkey", F.to_json(F.struct(F.array(result).alias("results")))
                    .alias("payload"))


def _eslint(spark, sf) -> DataFrame:
    f = v.scanner_findings(spark, sf)
    message = F.struct(
        F.when(F.col("line") != 6, F.col("id")).alias("ruleId"), F.col("title").alias("message"),
        "line", "column", F.when(F.col("line") != 1, F.col("line") % 3).alias("severity"))
    files = F.array(F.struct(F.col("file").alias("filePath"), F.array(message).alias("messages")))
    return f.select("orderkey", F.to_json(files).alias("payload"))


def _external(engine: str, build):
    def run(spark, sf):
        return rp.external_findings(build(spark, sf), engine).select(
            "orderkey", "id", "title", "severity", "file", F.col("line").alias("at"),
            F.col("column").alias("col_no"), "snippet", score("ai_confidence"), score("risk_score"),
            "category", F.array_join("tags", ",").alias("tags"))
    return run


def _external_sql(engine: str, rule: str, title: str, severity: str, file: str, col: str,
                  snippet: str, prefix: str) -> str:
    risk = " ".join(f"WHEN '{k}' THEN {x}" for k, x in rp.BRIDGE_RISK.items())
    clean = f"trim(regexp_replace(upper({rule}), '[^A-Z0-9]+', '_', 'g'), '_')"
    return f"""{_SCANNER}, x AS (SELECT orderkey, '{prefix}' || {clean} AS id, {title} AS title,
  {severity} AS severity, {file} AS file, line AS at, {col} AS col_no, {snippet} AS snippet FROM s)
SELECT *, 30.0::DOUBLE AS ai_confidence, (CASE severity {risk} END)::DOUBLE AS risk_score,
  'sast-bridge' AS category, 'sast-bridge,{engine}' AS tags FROM x"""


_RULE = "'py.lang/' || rule_id || '..'"
_TITLE = f"CASE WHEN line = 2 THEN {_RULE} ELSE title END"
QUERIES["external_semgrep"] = _external("semgrep", _semgrep)
SQL["external_semgrep"] = _external_sql(
    "semgrep", _RULE, _TITLE,
    "CASE severity WHEN 'critical' THEN 'high' WHEN 'low' THEN 'low' ELSE 'medium' END", "file",
    'CASE WHEN "column" > 3 THEN "column" ELSE 1 END',
    f"CASE WHEN line < 6 THEN snippet ELSE {_TITLE} END", "SAST-SEMGRP-")
QUERIES["external_bandit"] = _external("bandit", _bandit)
SQL["external_bandit"] = _external_sql(
    "bandit", "rule_id", "title", "CASE severity WHEN 'high' THEN 'high' WHEN 'low' THEN 'low' "
    "ELSE 'medium' END", "CASE WHEN line = 3 THEN 'unknown' ELSE file END", "1", "title",
    "SAST-BANDIT-")
QUERIES["external_eslint"] = _external("eslint", _eslint)
SQL["external_eslint"] = _external_sql(
    "eslint", "CASE WHEN line = 6 THEN 'UNKNOWN' ELSE rule_id END", "title",
    "CASE WHEN line = 1 THEN 'medium' WHEN line % 3 = 2 THEN 'high' WHEN line % 3 = 1 THEN 'medium' "
    "ELSE 'low' END", "file", '"column"', "title", "SAST-ESLINT-")

# Written reports -----------------------------------------------------------------------------


def _round_trip_json(spark, sf) -> DataFrame:
    """The documents of a report, read back."""
    found = fd.dedup_findings(v.scanner_findings(spark, sf))
    rows = doc.entries_of(doc.report_json(found, 100, 16), 1)
    one = rows.select(F.concat(F.lit('{"findings":['), "entry", F.lit("]}")).alias("document"))
    return rp.report_findings(one, "document").select(
        "id", "severity", "file", "line", "column", score("ai_confidence"), score("risk_score"),
        "category")


def _dedup_sql() -> str:
    from queries.scanning import dedup_sql
    return dedup_sql("s")


QUERIES["report_json"] = _round_trip_json
SQL["report_json"] = f"""{_SCANNER} SELECT rule_id AS id, severity, file, line, "column",
  {score1('ai_confidence')} AS ai_confidence, {score1('risk_score')} AS risk_score, category
FROM ({_dedup_sql()})"""

QUERIES["report_json_summary"] = lambda spark, sf: doc.report_json(
    v.scanner_findings(spark, sf), 100, 16, "none").where("part = 0").select(
    F.concat("value", F.lit("]}")).alias("document")).select(
    *[F.get_json_object("document", f"$.summary.{p}").alias(n) for p, n in [
        ("total", "total"), ("scanned_files", "files"), ("dedup_mode", "mode"),
        ("ai_estimated", "ai"), ("top_pattern", "top"), ("by_severity.high", "high"),
        ("by_severity.info", "info")]])
SQL["report_json_summary"] = f"""{_SCANNER}, c AS (SELECT rule_id, count(*) AS n FROM s GROUP BY 1)
SELECT count(*)::VARCHAR AS total, '100' AS files, 'none' AS mode,
  (count(*) FILTER (WHERE ai_confidence >= 70))::VARCHAR AS ai,
  (SELECT rule_id FROM c ORDER BY n DESC, rule_id DESC LIMIT 1) AS top,
  (count(*) FILTER (WHERE severity = 'high'))::VARCHAR AS high,
  (count(*) FILTER (WHERE severity = 'info'))::VARCHAR AS info FROM s"""

QUERIES["report_sarif"] = lambda spark, sf: rp.sarif_results(doc.entries_of(doc.report_sarif(
    fd.dedup_findings(v.scanner_findings(spark, sf))), 3).select(F.concat(
        F.lit('{"runs":[{"results":['), "entry", F.lit("]}]}")).alias("document")),
    "document").select("id", "level", "message", "file", "line", "column", "ai_confidence",
                       "risk_score")
SQL["report_sarif"] = f"""{_SCANNER} SELECT rule_id AS id, CASE WHEN severity IN ('critical', 'high')
  THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level,
  printf('%s (AI confidence %.1f%%, risk %.1f)', title, ai_confidence::DOUBLE, risk_score::DOUBLE)
  AS message, file, line, "column", {score1('ai_confidence')} AS ai_confidence,
  {score1('risk_score')} AS risk_score FROM ({_dedup_sql()})"""

QUERIES["report_annotations"] = lambda spark, sf: nt.report_annotations(
    v.scanner_findings(spark, sf)).unionByName(
    nt.annotation_trailer(v.scanner_findings(spark, sf), "none"))
_ESC = "replace(replace(replace(replace({}, '%', '%25'), chr(10), '%0A'), ':', '%3A'), ',', '%2C')"
SQL["report_annotations"] = f"""{_SCANNER}, q AS (SELECT * FROM s),
t AS (SELECT * FROM q ORDER BY risk_score DESC, {rank('severity')} DESC, file, line, "column", rule_id
  LIMIT 200)
SELECT '::' || CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium'
  THEN 'warning' ELSE 'notice' END || ' file=' || {_ESC.format('file')} || ',line=' || line || ',col='
  || "column" || ',title=' || {_ESC.format("'[' || rule_id || '] ' || title")} || '::'
  || replace(printf('%s (AI confidence %.1f%%, risk %.1f)', title, ai_confidence::DOUBLE,
     risk_score::DOUBLE), '%', '%25') AS value FROM t
UNION ALL SELECT '::notice::truncated annotations to first 200 findings (of ' || count(*) || ').' FROM q
HAVING count(*) > 200
UNION ALL SELECT 'summary: total=' || count(*) || ' dedup_mode=none original_total=' || count(*)
  || ' deduped_total=' || count(*) FROM q"""

QUERIES["compliance_csv"] = lambda spark, sf: compliance_table(an.compliance_report(
    v.findings(spark, sf), v.scans(spark, sf), ORG, "2001-01-01", AS_OF))

_POINTS = "100 - least((critical * 10 + high * 5 + medium * 2 + low)::DOUBLE / total_findings, 100)"
SQL["compliance_csv"] = f"""{report_cte('2001-01-01', AS_OF)} SELECT org_id AS "Organization",
  team_id AS "Team", repo_id AS "Repository", strftime(scanned_at, '%Y-%m-%d %H:%M:%S') AS "Scan Date",
  total_findings::VARCHAR AS "Total Findings", critical::VARCHAR AS "Critical", high::VARCHAR AS "High",
  medium::VARCHAR AS "Medium", low::VARCHAR AS "Low", top_cwe AS "Top CWE", top_owasp AS "Top OWASP",
  CASE WHEN total_findings <= 0 THEN '100.0%' ELSE printf('%.1f%%', {exact(_POINTS, 1)}) END
  AS "Compliance Score" FROM j"""

QUERIES["alert_payload"] = lambda spark, sf: nt.alert_payload(
    v.scanner_findings(spark, sf), "high", "src/", 1_700_000_000, 97, 25).select(
    *[F.get_json_object("payload", f"$.{p}").alias(n) for p, n in [
        ("event", "event"), ("summary.alert_findings", "alerts"), ("summary.low", "low"),
        ("summary.matched_rules", "rules"), ("top_findings[0].risk_score", "best"),
        ("top_findings[19].id", "last_id"), ("top_findings[20].id", "beyond")]])
SQL["alert_payload"] = f"""{_SCANNER}, q AS (SELECT * FROM s WHERE {rank('severity')} >= 4),
t AS (SELECT *, row_number() OVER (ORDER BY risk_score DESC, {rank('severity')} DESC, file, line, "column",
  rule_id) AS i FROM q)
SELECT 'scan.completed' AS event, (SELECT count(*) FROM q)::VARCHAR AS alerts,
  (SELECT count(*) FROM s WHERE severity = 'low')::VARCHAR AS low, '25' AS rules,
  (SELECT {score1('risk_score')} FROM t WHERE i = 1)::VARCHAR AS best,
  (SELECT rule_id FROM t WHERE i = 20) AS last_id, NULL::VARCHAR AS beyond"""

