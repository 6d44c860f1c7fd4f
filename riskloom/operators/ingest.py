"""Ingest payloads into the two tables, upsert, validation, retention and migrations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.functions.numbers import f32
from riskloom.functions.severity import RANKS
from riskloom.functions.text import fingerprint, null_if_blank, scan_hash
from riskloom.operators.compliance import enrich_compliance
from riskloom.sources.history import COUNTS
from riskloom.sources.reports import parse_ingest


@dataclass(frozen=True)
class Ingested:
    scans: DataFrame
    findings: DataFrame
    rejects: DataFrame


def with_ai_ratio(df: DataFrame) -> DataFrame:
    """Share of likely generated findings, single precision, 0 without findings."""
    share = (f32(F.col("ai_estimated_count")) / f32(F.col("total_findings"))).cast("float")
    return df.withColumn("ai_ratio", F.when(F.col("total_findings") > 0, share).otherwise(
        f32(0.0)))


def unit_confidence(c: Column) -> Column:
    """Confidence on the 0-1 scale; senders use 0-100."""
    return F.when(c > 1, (f32(c) / f32(100.0)).cast("float")).otherwise(f32(c))


def _scan_id(payload: str, received: str) -> Column:
    """A stable id in UUID form from the payload and its arrival."""
    h = F.sha2(F.concat_ws("|", F.col(received).cast("string"), payload), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts])


def ingest(payloads: DataFrame, col: str = "payload", received: str = "received_at") -> Ingested:
    """Scan rows, finding rows and refused payloads. A payload row may bring its own
    ``scan_id``; otherwise the id is derived from the payload and its arrival time."""
    rows = parse_ingest(payloads, col)
    if "scan_id" not in rows.columns:
        rows = rows.withColumn("scan_id", _scan_id(col, received))
    good = rows.where("accepted").withColumn("timestamp", F.col(received))
    head = ["org_id", "team_id", "repo_id", "repo_name", "target_path", "branch", "commit_sha",
            "ci_run_id", "cli_version"]
    r = "p.scan_result."
    scans = good.select(
        F.col("scan_id").cast("string"), "timestamp", *[F.col("p." + c) for c in head],
        F.col(r + "total_findings"), *[F.col(r + s).alias(s + "_count") for s in RANKS],
        *[F.col(r + c) for c in ("ai_estimated_count", "scan_duration_ms", "files_scanned",
                                 "rules_loaded")],
        "p.user_email", F.to_date("timestamp").alias("scan_date"))
    scans = with_ai_ratio(scans).select(*schemas.SCAN.fieldNames())
    f = good.select(F.col("scan_id").cast("string").alias("scan_id"), "timestamp", "p.repo_id",
                    F.explode(r + "findings").alias("f"))
    findings = f.select(
        "scan_id",
        scan_hash(F.col("scan_id"), F.col("f.file_path"), F.col("f.line_number"),
                  F.col("f.rule_id")).alias("finding_hash"),
        "f.rule_id", "f.rule_title", F.lower("f.severity").alias("severity"), "f.file_path",
        "f.line_number", "f.snippet", unit_confidence(F.col("f.ai_confidence")).alias(
            "ai_confidence"),
        "f.ai_tendency", "f.fix_suggestion", null_if_blank("f.cwe_id").alias("cwe_id"),
        null_if_blank("f.owasp_category").alias("owasp_category"),
        F.col("timestamp").alias("first_seen"), F.col("timestamp").alias("last_seen"),
        F.lit(1).cast("bigint").alias("times_seen"), F.lit(False).alias("is_fixed"),
        F.lit(None).cast("timestamp").alias("fixed_at"),
        fingerprint(F.col("repo_id"), F.col("f.file_path"), F.col("f.line_number"),
                    F.col("f.rule_id")).alias("fingerprint"))
    return Ingested(scans, findings, rows.where("not accepted").select(col, received))


def scan_tables(findings: DataFrame, heads: DataFrame) -> Ingested:
    """A scan's result as rows of the two tables, without a payload in between. ``findings`` are those
    of :func:`riskloom.plans.scan.scan` with their ``scan_id``; ``heads`` has a row per scan with its
    ``scan_id``, ``timestamp`` and what is known of the other head columns. Findings get compliance
    keys (X10); the scan's counts are one aggregate per scan, so a scan of any size is one row that no
    task has gathered. Findings without a head are refused."""
    rows = enrich_compliance(findings)
    level = F.lower("severity")
    counts = rows.groupBy("scan_id").agg(
        F.count("*").cast("int").alias("total_findings"),
        *[F.count_if(level == s).cast("int").alias(s + "_count") for s in RANKS],
        F.count_if(F.col("ai_confidence") >= 70).cast("int").alias("ai_estimated_count"))
    zero = {c: 0 for c in counts.columns if c != "scan_id"}
    known = [c for c in heads.columns if c in schemas.SCAN.fieldNames() and c not in zero]
    scans = heads.select(*known).join(counts, "scan_id", "left").fillna(zero, list(zero))
    scans = with_ai_ratio(scans.withColumn("scan_date", F.to_date("timestamp")))
    scans = scans.select(*[
        F.col(f.name).cast(f.dataType) if f.name in scans.columns
        else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.SCAN])
    repo = F.col("repo_id") if "repo_id" in heads.columns else F.lit(None).cast("string")
    met = rows.join(heads.select("scan_id", "timestamp", repo.alias("_repo")), "scan_id")
    line = F.col("line").cast("int")
    stored = met.select(
        F.col("scan_id").cast("string").alias("scan_id"),
        scan_hash(F.col("scan_id").cast("string"), F.col("file"), line, F.col("id"))
        .alias("finding_hash"),
        F.col("id").alias("rule_id"), F.col("title").alias("rule_title"), level.alias("severity"),
        F.col("file").alias("file_path"), line.alias("line_number"), "snippet",
        unit_confidence(F.col("ai_confidence")).alias("ai_confidence"), "ai_tendency",
        "fix_suggestion", null_if_blank("cwe_id").alias("cwe_id"),
        null_if_blank("owasp_category").alias("owasp_category"),
        F.col("timestamp").alias("first_seen"), F.col("timestamp").alias("last_seen"),
        F.lit(1).cast("bigint").alias("times_seen"), F.lit(False).alias("is_fixed"),
        F.lit(None).cast("timestamp").alias("fixed_at"),
        fingerprint(F.col("_repo"), F.col("file"), line, F.col("id")).alias("fingerprint"))
    refused = findings.join(heads.select("scan_id"), "scan_id", "left_anti")
    return Ingested(scans, stored, refused)


def upsert_findings(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = (
        "scan_id", "finding_hash")) -> DataFrame:
    """One row per key; the first row's values stay, last_seen and times_seen move on. Both sides are
    folded by key before they meet, so copies of a key are folded in the tasks before the shuffle and
    rows that already lie by key, such as those of an upsert before, are not moved again."""
    cols = [c for c in old.columns if c not in (*keys, "first_seen", "last_seen", "times_seen")]

    def marked(df: DataFrame, new: int) -> DataFrame:
        return df.select(*keys, F.struct(F.lit(new).alias("new"), "first_seen", F.struct(*cols).alias("v"))
                         .alias("_first"), "first_seen", "last_seen", "times_seen")

    def folded(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.min("_first").alias("_first"), F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"), F.sum("times_seen").alias("times_seen"))

    lacking = {c: F.lit(None).cast(old.schema[c].dataType) for c in old.columns if c not in new.columns}
    both = folded(marked(old, 0)).unionByName(folded(marked(new.withColumns(lacking), 1)))
    return folded(both).select(*keys, "_first.v.*", "first_seen", "last_seen", "times_seen").select(
        *old.columns)


# Validation (I4) -----------------------------------------------------------------------------

def _violations(checks: dict[str, Column]) -> Column:
    """Names of the failed checks; as in SQL, a check that is NULL passes."""
    named = [F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in checks.items()]
    return F.filter(F.array(*named), lambda v: v.isNotNull())


def _later_copies(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add ``_later``: the row is not the first of its key. Only repeated keys are joined back."""
    repeated = df.groupBy(*keys).agg(F.min(order).alias("_first"), F.count("*").alias("_copies"))
    repeated = repeated.where("_copies > 1").drop("_copies")
    return df.join(repeated, keys, "left").withColumn(
        "_later", F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).drop("_first")


def check_scans(df: DataFrame, order: str = "timestamp") -> DataFrame:
    """I4: scans with the names of their violated constraints."""
    rows = _later_copies(df, ["scan_id"], order)
    counts = F.lit(True)
    for s in RANKS:
        counts = counts & (F.col(s + "_count") >= 0)
    ai, total = F.col("ai_estimated_count"), F.col("total_findings")
    return rows.withColumn("violations", _violations({
        "required": F.col("scan_id").isNotNull() & F.col("target_path").isNotNull(),
        "scan_id_unique": ~F.col("_later"), "valid_findings": total >= 0,
        "valid_severity_counts": counts, "valid_ai_count": (ai >= 0) & (ai <= total),
    })).drop("_later")


def check_findings(df: DataFrame, order: str = "first_seen") -> DataFrame:
    """I4: findings with the names of their violated constraints."""
    rows = _later_copies(df, ["scan_id", "finding_hash"], order)
    fixed, at = F.col("is_fixed"), F.col("fixed_at")
    required = F.lit(True)
    for c in ("scan_id", "finding_hash", "rule_id", "severity", "file_path"):
        required = required & F.col(c).isNotNull()
    return rows.withColumn("violations", _violations({
        "required": required, "unique_per_scan": ~F.col("_later"),
        "valid_severity": F.col("severity").isin(list(RANKS)),
        "valid_confidence": (F.col("ai_confidence") >= 0) & (F.col("ai_confidence") <= 1),
        "valid_line_number": F.col("line_number") > 0,
        "valid_times_seen": F.col("times_seen") > 0,
        "fixed_at_requires_is_fixed": (fixed & at.isNotNull()) | (~fixed & at.isNull()),
    })).drop("_later")


def validate(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I4: (accepted rows, rejected rows with their violations)."""
    bad = F.size("violations") > 0
    return checked.where(~bad).drop("violations"), checked.where(bad)


# Upkeep (I6-I8) ------------------------------------------------------------------------------

def apply_retention(df: DataFrame, as_of: str, years: int = 2, ts: str = "timestamp"
                    ) -> DataFrame:
    """Rows not older than the retention time."""
    bound = F.lit(as_of).cast("timestamp_ntz") - F.make_ym_interval(F.lit(years))
    return df.where(F.col(ts) >= bound)


def history_to_scans(df: DataFrame, org_id: str | None = None, team_id: str | None = None
                     ) -> DataFrame:
    """Scan rows of a history log; details the log does not hold are zero."""
    scans = df.select(
        F.sha2(F.concat_ws("|", F.col("timestamp").cast("string"), "target"), 256).alias("scan_id"),
        F.timestamp_seconds("timestamp").alias("timestamp"),
        F.lit(org_id).cast("string").alias("org_id"),
        F.lit(team_id).cast("string").alias("team_id"),
        F.col("target").alias("target_path"), F.col("total").cast("int").alias("total_findings"),
        *[F.col(s).cast("int").alias(s + "_count") for s in COUNTS[1:6]],
        F.col("ai_estimated").cast("int").alias("ai_estimated_count"),
        F.lit(0).alias("scan_duration_ms"), F.lit(0).alias("files_scanned"),
        F.lit(0).alias("rules_loaded"))
    return with_ai_ratio(scans)


def backfill_flags(df: DataFrame, metadata: str = "ai_metadata") -> DataFrame:
    """I8: mark findings that carry generator metadata; others keep their flag."""
    flag = F.col("is_ai_generated") if "is_ai_generated" in df.columns else F.lit(False)
    filled = F.coalesce(F.col(metadata) != "", F.lit(False))
    return df.withColumn("is_ai_generated", F.when(filled, True).otherwise(flag))
