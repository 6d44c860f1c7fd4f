"""Deterministic sample tables of any size, from ids and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.text import scan_hash
from riskloom.operators.ingest import with_ai_ratio

_ORGS = ["acme", "globex", "initech"]
_TEAMS = ["platform", "payments", "mobile", "data"]
_REPOS = ["api", "web", "worker", "cli", "infra"]
_RULES = ["PY-CRYPTO-001", "JS-INJ-001", "PY-AUTH-002", "GO-MISC-003", "JS-CRYPTO-004"]
_SEVERITIES = ["critical", "high", "high", "medium", "low"]
_FILES = ["src/auth.py", "src/database.js", "src/config.go", "src/utils.ts"]


def _draw(key: Column, name: str, n: int) -> Column:
    """A number below n that depends on the key only."""
    return F.pmod(F.xxhash64(key, F.lit(name)), F.lit(n)).cast("int")


def _one_of(key: Column, name: str, values: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, values)), _draw(key, name, len(values)))


def seed_scans(spark: SparkSession, n: int = 100, as_of: str = "2025-01-31") -> DataFrame:
    """Scans of the 30 days before ``as_of``."""
    k = F.col("id")
    end = F.lit(as_of).cast("timestamp")
    rows = spark.range(n).select(
        k.cast("string").alias("scan_id"),
        (end - F.make_dt_interval(secs=_draw(k, "age", 30 * 86_400))).alias("timestamp"),
        _one_of(k, "org", _ORGS).alias("org_id"), _one_of(k, "team", _TEAMS).alias("team_id"),
        _one_of(k, "repo", _REPOS).alias("repo_id"),
        F.concat(F.lit("repo-"), k.cast("string")).alias("repo_name"),
        F.lit("src/").alias("target_path"),
        F.when(_draw(k, "branch", 10) >= 3, "main").otherwise("develop").alias("branch"),
        *[_draw(k, s, m).alias(s + "_count") for s, m in
          [("critical", 5), ("high", 15), ("medium", 20), ("low", 10), ("info", 1)]],
        (_draw(k, "total", 30) + 20).alias("total_findings"),
        _draw(k, "ai", 20).alias("ai_estimated_count"),
        (_draw(k, "ms", 3000) + 500).alias("scan_duration_ms"),
        (_draw(k, "files", 500) + 50).alias("files_scanned"), F.lit(169).alias("rules_loaded"))
    return with_ai_ratio(rows)


def seed_findings(scans: DataFrame) -> DataFrame:
    """Three to ten findings per scan."""
    per = _draw(F.col("scan_id"), "findings", 8) + 3
    rows = scans.select("scan_id", "timestamp", F.explode(F.sequence(F.lit(1), per)).alias("i"))
    k = F.concat_ws(":", "scan_id", F.col("i").cast("string"))
    line = _draw(k, "line", 500) + 1
    rule, path = _one_of(k, "rule", _RULES), _one_of(k, "file", _FILES)
    return rows.select(
        "scan_id", scan_hash(F.col("scan_id"), path, line, rule).alias("finding_hash"),
        rule.alias("rule_id"), rule.alias("rule_title"),
        _one_of(k, "severity", _SEVERITIES).alias("severity"), path.alias("file_path"),
        line.alias("line_number"),
        (F.lit(0.5) + _draw(k, "confidence", 50) / 100).cast("float").alias("ai_confidence"),
        F.col("timestamp").alias("first_seen"), F.col("timestamp").alias("last_seen"),
        F.lit(1).cast("bigint").alias("times_seen"), F.lit(False).alias("is_fixed"),
        F.lit(None).cast("timestamp").alias("fixed_at"))


def seed_history(spark: SparkSession, days: int = 30, scans_per_day: int = 2,
                 as_of: int = 1_738_281_600) -> DataFrame:
    """History records, ``scans_per_day`` on each day before ``as_of`` (epoch seconds)."""
    k = F.col("id")
    counts = [("critical", 3), ("high", 8), ("medium", 7), ("low", 5), ("info", 3)]
    rows = spark.range(days * scans_per_day).select(
        (F.lit(as_of) - F.floor(k / scans_per_day) * 86_400 - _draw(k, "s", 86_400)).cast("bigint")
        .alias("timestamp"), _one_of(k, "target", _REPOS).alias("target"),
        *[_draw(k, s, n).cast("bigint").alias(s) for s, n in counts],
        _one_of(k, "rule", _RULES).alias("top_rule"))
    total = sum((F.col(s) for s, _ in counts[1:]), F.col("critical"))
    rows = rows.withColumn("total", total)
    ai = F.floor(F.col("total") * (F.lit(15) + _draw(F.col("timestamp"), "ai", 25)) / 100)
    return rows.withColumn("ai_estimated", ai.cast("bigint")).select(
        "timestamp", "target", "total", *[s for s, _ in counts], "ai_estimated", "top_rule")
