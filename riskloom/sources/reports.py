"""Reports of scanners and ingest payloads, from a JSON text column or from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.functions.numbers import f32
from riskloom.functions.severity import literal_map
from riskloom.functions.text import ascii_lower, null_if_blank, sanitize_id


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as ``path, payload``."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def report_findings(df: DataFrame, col: str = "payload") -> DataFrame:
    """S3: one row per finding of native JSON reports, with the loose defaults of readers."""
    keep = [c for c in df.columns if c != col]
    rows = parsed_once(df, "_r", F.from_json(col, schemas.REPORT_JSON))
    rows = rows.select(*keep, F.explode("_r.findings").alias("f"))
    return rows.select(
        *keep, "f.id", "f.title", "f.severity", F.coalesce("f.file", F.lit("unknown")).alias("file"),
        F.coalesce("f.line", F.lit(1)).alias("line"), "f.column", "f.snippet",
        f32(F.col("f.ai_confidence")).alias("ai_confidence"),
        f32(F.col("f.risk_score")).alias("risk_score"), "f.category", "f.cwe_id",
        "f.owasp_category", "f.tags", "f.ai_tendency", "f.fix_suggestion")


def sarif_results(df: DataFrame, col: str = "payload") -> DataFrame:
    """One row per SARIF result; the first location counts."""
    keep = [c for c in df.columns if c != col]
    rows = parsed_once(df, "_r", F.from_json(col, schemas.SARIF))
    rows = rows.select(*keep, F.explode("_r.runs").alias("run"))
    rows = rows.select(*keep, F.explode("run.results").alias("r"))
    place = F.get(F.col("r.locations"), F.lit(0))["physicalLocation"]
    return rows.select(
        *keep, F.col("r.ruleId").alias("id"), "r.level", F.col("r.message.text").alias("message"),
        F.coalesce(place["artifactLocation"]["uri"], F.lit("unknown")).alias("file"),
        F.coalesce(place["region"]["startLine"], F.lit(1)).alias("line"),
        F.coalesce(place["region"]["startColumn"], F.lit(1)).alias("column"),
        F.col("r.properties.aiConfidence").alias("ai_confidence"),
        F.col("r.properties.riskScore").alias("risk_score"),
        F.coalesce(F.col("r.properties.category"), F.lit("uncategorized")).alias("category"),
        F.col("r.properties.tags").alias("tags"))


# External analyzers (S5, X9) -----------------------------------------------------------------

# Id prefixes, severity words and risk points of external findings.
_PREFIX = {"semgrep": "SAST-SEMGRP-", "bandit": "SAST-BANDIT-", "eslint": "SAST-ESLINT-"}
_SEVERITY = {
    "semgrep": {"error": "high", "warning": "medium", "info": "low"},
    "bandit": {"high": "high", "medium": "medium", "low": "low"},
}
BRIDGE_RISK = {"critical": 90.0, "high": 80.0, "medium": 65.0, "low": 45.0, "info": 30.0}


def _raw_semgrep(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    rows = parsed_once(df, "_r", F.from_json(col, schemas.SEMGREP))
    rows = rows.select(*keep, F.explode("_r.results").alias("r"))
    return rows.select(
        *keep, F.coalesce("r.check_id", F.lit("UNKNOWN")).alias("rule"),
        F.col("r.extra.message").alias("message"), F.col("r.path").alias("file"),
        F.col("r.start.line").alias("line"), F.col("r.start.col").alias("column"),
        F.col("r.extra.lines").alias("snippet"),
        F.coalesce("r.extra.severity", F.lit("warning")).alias("severity"))


def _raw_bandit(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    rows = parsed_once(df, "_r", F.from_json(col, schemas.BANDIT))
    rows = rows.select(*keep, F.explode("_r.results").alias("r"))
    return rows.select(
        *keep, F.coalesce("r.test_id", F.lit("UNKNOWN")).alias("rule"),
        F.col("r.issue_text").alias("message"), F.col("r.filename").alias("file"),
        F.col("r.line_number").alias("line"), F.col("r.col_offset").alias("column"),
        F.col("r.code").alias("snippet"),
        F.coalesce("r.issue_severity", F.lit("medium")).alias("severity"))


def _raw_eslint(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    rows = parsed_once(df, "_r", F.from_json(col, schemas.ESLINT))
    rows = rows.select(*keep, F.explode("_r").alias("file"))
    rows = rows.select(*keep, "file.filePath", F.explode("file.messages").alias("r"))
    return rows.select(
        *keep, F.coalesce("r.ruleId", F.lit("UNKNOWN")).alias("rule"), "r.message",
        F.col("filePath").alias("file"), "r.line", "r.column", F.col("r.source").alias("snippet"),
        F.coalesce("r.severity", F.lit(1)).cast("string").alias("severity"))


_RAW = {"semgrep": _raw_semgrep, "bandit": _raw_bandit, "eslint": _raw_eslint}


def _severity(engine: str, raw: Column) -> Column:
    if engine == "eslint":
        return F.when(raw == "2", "high").when(raw == "1", "medium").otherwise("low")
    return F.coalesce(F.try_element_at(literal_map(_SEVERITY[engine]), F.lower(raw)),
                      F.lit("medium"))


def normalize_external(rows: DataFrame, engine: str) -> DataFrame:
    """Raw analyzer rows (rule, message, file, line, column, snippet, severity) as findings."""
    severity = _severity(engine, F.col("severity"))
    title = F.coalesce("message", "rule")
    raw = {"rule", "message", "file", "line", "column", "snippet", "severity"}
    keep = [c for c in rows.columns if c not in raw]
    missing = F.lit(None).cast("string")
    return rows.select(
        *keep,
        F.concat(F.lit(_PREFIX[engine]), sanitize_id("rule")).alias("id"), title.alias("title"),
        severity.alias("severity"), F.coalesce("file", F.lit("unknown")).alias("file"),
        F.coalesce("line", F.lit(1)).alias("line"), F.coalesce("column", F.lit(1)).alias("column"),
        F.coalesce(null_if_blank("snippet"), title).alias("snippet"),
        f32(30.0).alias("ai_confidence"),
        f32(F.element_at(literal_map(BRIDGE_RISK), severity)).alias("risk_score"),
        F.lit("sast-bridge").alias("category"), missing.alias("cwe_id"),
        missing.alias("owasp_category"),
        F.array(F.lit("sast-bridge"), F.lit(engine)).alias("tags"),
        missing.alias("ai_tendency"), missing.alias("fix_suggestion"))


def external_findings(df: DataFrame, engine: str, col: str = "payload") -> DataFrame:
    """Findings of one external analyzer's JSON output."""
    keep = [c for c in df.columns if c != col]
    return normalize_external(_RAW[engine](df, col, keep), engine)


def parsed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column (a parsed or lower-cased text) behind a one-row explode. A filter on the
    result would otherwise be pushed below the projection and repeat the work for every field or
    word it looks at."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def read_report_json(spark: SparkSession, path: str) -> DataFrame:
    """S3: findings of native JSON report files."""
    return report_findings(read_payloads(spark, path))


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    """Results of SARIF files."""
    return sarif_results(read_payloads(spark, path))


def read_external(spark: SparkSession, path: str, engine: str) -> DataFrame:
    """Findings of an external analyzer's report files."""
    return external_findings(read_payloads(spark, path), engine)


# Ingest payloads (S7) ------------------------------------------------------------------------

def parse_ingest(df: DataFrame, col: str = "payload") -> DataFrame:
    """Add the parsed payload as ``p`` and ``accepted`` (all required fields present)."""
    counts = ["total_findings", "critical", "high", "medium", "low", "info", "ai_estimated_count"]
    needed = [F.col("p.repo_name"), F.col("p.target_path"),
              *[F.col(f"p.scan_result.{c}") for c in counts]]
    ok = F.lit(True)
    for c in needed:
        ok = ok & c.isNotNull()
    bad = F.exists(F.coalesce(F.col("p.scan_result.findings"), F.array()), lambda f: (
        f["rule_id"].isNull() | f["severity"].isNull() | f["file_path"].isNull()))
    parsed = parsed_once(df, "p", F.from_json(col, schemas.INGEST))
    return parsed.withColumn("accepted", ok & ~F.coalesce(bad, F.lit(False)))


# Summary of a report (G34) -------------------------------------------------------------------

def _mode(ids: Column) -> Column:
    """Most frequent non-empty id of an array, smallest id on a tie, ``-`` when there is none: one
    pass over the sorted ids, where equal ones stand together."""
    named = F.array_sort(F.filter(ids, lambda i: i.isNotNull() & (i != "")))
    start = F.struct(F.lit(0).alias("most"), F.lit("-").alias("best"), F.lit(0).alias("run"),
                     F.lit("").alias("last"))

    def step(state: Column, i: Column) -> Column:
        run = F.when(state["last"] == i, state["run"] + 1).otherwise(1)
        more = run > state["most"]
        return F.struct(F.when(more, run).otherwise(state["most"]).alias("most"),
                        F.when(more, i).otherwise(state["best"]).alias("best"),
                        run.alias("run"), i.alias("last"))

    return F.coalesce(F.aggregate(named, start, step)["best"], F.lit("-"))


def summarize_report(df: DataFrame, fmt: str = "auto", col: str = "payload") -> DataFrame:
    """History-style summary of a report; ``auto`` tells the two formats apart by shape."""
    keep = [c for c in df.columns if c != col]
    both = F.struct(F.from_json(col, schemas.REPORT_JSON).alias("j"),
                    F.from_json(col, schemas.SARIF).alias("s"))
    rows = parsed_once(df, "_r", both).withColumns({"_j": F.col("_r.j"), "_s": F.col("_r.s")})
    findings = F.coalesce(F.col("_j.findings"), F.array())
    results = F.flatten(F.transform(F.coalesce(F.col("_s.runs"), F.array()),
                                    lambda r: F.coalesce(r["results"], F.array())))
    is_json = F.lit(fmt == "json")
    is_sarif = F.lit(fmt == "sarif")
    if fmt == "auto":
        is_json = F.col("_j.summary").isNotNull() & F.col("_j.findings").isNotNull()
        is_sarif = ~is_json & F.col("_s.runs").isNotNull()
    sure = F.lit(70.0)
    by = "_j.summary.by_severity."

    def level(*names: str) -> Column:
        return F.size(F.filter(results, lambda r: F.lower(
            F.coalesce(r["level"], F.lit(""))).isin(*names))).cast("bigint")

    known = ("error", "warning", "note")
    sarif_counts = {"critical": F.lit(0).cast("bigint"), "high": level("error"),
                    "medium": level("warning"), "low": level("note"),
                    "info": F.size(results) - level(*known)}

    def either(native: Column, sarif: Column) -> Column:
        return F.when(is_json, native.cast("bigint")).otherwise(sarif.cast("bigint"))

    counted = rows.where(is_json | is_sarif)
    top = F.coalesce(F.nullif(F.col("_j.summary.top_pattern"), F.lit("")),
                     _mode(F.transform(findings, lambda f: f["id"])))
    return counted.select(
        *keep,
        either(F.coalesce(F.col("_j.summary.total"), F.size(findings)),
               F.size(results)).alias("total"),
        *[either(F.coalesce(F.col(by + s), F.lit(0)), sarif_counts[s]).alias(s)
          for s in sarif_counts],
        either(F.coalesce(F.col("_j.summary.ai_estimated"), F.size(F.filter(
            findings, lambda f: f["ai_confidence"] >= sure))),
            F.size(F.filter(results, lambda r: r["properties"]["aiConfidence"] >= sure))
        ).alias("ai_estimated"),
        F.when(is_json, top).otherwise(
            _mode(F.transform(results, lambda r: r["ruleId"]))).alias("top_rule"))


def baseline_rows(df: DataFrame, col: str = "payload") -> DataFrame:
    """The distinct (file, line, category) keys of native or SARIF reports."""
    other = F.lit("uncategorized")
    native = report_findings(df.select(col), col).select(
        "file", "line", F.coalesce("category", other).alias("category"))
    sarif = sarif_results(df.select(col), col).select("file", "line", "category")
    return native.unionByName(sarif).select(
        ascii_lower("file").alias("file"), "line",
        ascii_lower("category").alias("category")).distinct()
