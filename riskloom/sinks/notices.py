"""K4, K8: annotation lines of a build and the alert payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.severity import min_severity, rank, severity_counts
from riskloom.functions.text import escape_annotation_message, escape_annotation_property
from riskloom.sinks.documents import with_target

ANNOTATION_LIMIT = 200
ALERT_LIMIT = 20


def _strongest(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("risk_score"), F.desc(rank("severity")), "file", "line", "column",
                      "id").limit(n)


def report_annotations(findings: DataFrame, limit: int = ANNOTATION_LIMIT) -> DataFrame:
    """K4: one annotation line per finding, the strongest first. The limit is the build system's;
    ``annotation_trailer`` tells how many findings there are in all."""
    level = (F.when(F.col("severity").isin("critical", "high"), "error")
             .when(F.col("severity") == "medium", "warning").otherwise("notice"))
    message = F.format_string("%s (AI confidence %.1f%%, risk %.1f)", F.col("title"),
                              F.col("ai_confidence").cast("double"),
                              F.col("risk_score").cast("double"))
    title = F.concat(F.lit("["), "id", F.lit("] "), "title")
    one = F.lit(1)
    line = F.concat(
        F.lit("::"), level, F.lit(" file="), escape_annotation_property("file"), F.lit(",line="),
        F.greatest("line", one).cast("string"), F.lit(",col="),
        F.greatest("column", one).cast("string"), F.lit(",title="),
        escape_annotation_property(title), F.lit("::"), escape_annotation_message(message))
    return _strongest(findings, limit).select(line.alias("value"))


def annotation_trailer(findings: DataFrame, dedup_mode: str = "normalized",
                       original_total: int | None = None, limit: int = ANNOTATION_LIMIT
                       ) -> DataFrame:
    """K4: the lines after the annotations: truncation notice and totals, or the all-clear."""
    n = F.col("n").cast("string")
    original = F.lit(str(original_total)) if original_total is not None else n
    notice = F.when(F.col("n") > limit, F.concat(
        F.lit(f"::notice::truncated annotations to first {limit} findings (of "), n, F.lit(").")))
    totals = F.when(F.col("n") > 0, F.concat(
        F.lit("summary: total="), n, F.lit(f" dedup_mode={dedup_mode} original_total="), original,
        F.lit(" deduped_total="), n)).otherwise(F.lit("No vulnerabilities detected."))
    lines = F.filter(F.array(notice, totals), lambda x: x.isNotNull())
    return findings.agg(F.count("*").alias("n")).select(F.explode(lines).alias("value"))


def alert_payload(findings: DataFrame, severity: str = "high", target: str = ".",
                  timestamp: int = 0, scanned_files: int = 0, matched_rules: int = 0,
                  by: str | None = None) -> DataFrame:
    """K8: one JSON payload with totals and the 20 strongest findings at or above a severity, and one for
    each value of the column ``by`` where that is given; no row where there are none. A task sends 20
    findings per target at most."""
    found = with_target(findings, by)
    loud = min_severity(found, severity)
    place = Window.partitionBy("_target").orderBy(
        F.desc("risk_score"), F.desc(rank("severity")), "file", "line", "column", "id")
    best = loud.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= ALERT_LIMIT)
    top = best.select("_target", F.struct(
        (-F.col("risk_score")).alias("o1"), (-rank("severity")).alias("o2"),
        F.col("file").alias("o3"), F.col("line").alias("o4"), F.col("column").alias("o5"),
        F.col("id").alias("o6"),
        F.struct("id", "title", "severity", "file", "line", "column",
                 F.round(F.col("risk_score").cast("double"), 1).alias("risk_score"),
                 F.round(F.col("ai_confidence").cast("double"), 1).alias("ai_confidence"),
                 "category").alias("f")).alias("r"))
    listed = top.groupBy("_target").agg(  # 20 rows at most
        F.transform(F.array_sort(F.collect_list("r")), lambda r: r["f"]).alias("top"))
    alerts = loud.groupBy("_target").agg(F.count("*").alias("alerts"))
    totals = found.groupBy("_target").agg(F.count("*").alias("total_findings"), *severity_counts())
    rows = totals.join(alerts, "_target").join(listed, "_target")
    summary = F.struct("total_findings", "critical", "high", "medium", "low", "info",
                       F.lit(scanned_files).alias("scanned_files"),
                       F.lit(matched_rules).alias("matched_rules"),
                       F.col("alerts").alias("alert_findings"))
    payload = F.struct(
        F.lit("scan.completed").alias("event"), F.lit(timestamp).alias("timestamp"),
        (F.col("_target") if by else F.lit(target)).alias("target"), F.lit(severity).alias("notify_min_severity"),
        summary.alias("summary"), F.col("top").alias("top_findings"))
    return rows.select(F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))
