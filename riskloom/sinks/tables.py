"""K1, K5, K6: tables, history log and compliance CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.history import history_line

# The twelve columns of the compliance report.
COMPLIANCE_COLUMNS = {
    "Organization": "org_id", "Team": "team_id", "Repository": "repo_id",
    "Scan Date": "scanned_at", "Total Findings": "total_findings", "Critical": "critical",
    "High": "high", "Medium": "medium", "Low": "low", "Top CWE": "top_cwe",
    "Top OWASP": "top_owasp", "Compliance Score": "compliance_score",
}


def write_by_date(df: DataFrame, path: str, date: str = "scan_date", mode: str = "append",
                  moved: bool = True) -> None:
    """Parquet by day. The rebalance hint lets adaptive execution cut a large day into several
    files and join small ones, whatever share of the rows one day holds. Without ``moved`` every task
    writes a file of its own per day, for rows of few days: no row crosses a disk but that of the table.
    Half of a finding are digits of hashes, which Zstandard packs to half their bytes and Snappy not at all."""
    rows = df.hint("rebalance", F.col(date)) if moved else df
    rows.write.mode(mode).option("compression", "zstd").partitionBy(date).parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, by: str = "file", path: str | None = None
                   ) -> None:
    """A table whose rows lie in ``buckets`` files by the hash of a column, sorted by it. Corpus and findings
    that are written with equal numbers join and group by file without moving a row."""
    writer = df.repartition(buckets, by).write.mode("overwrite").bucketBy(buckets, by).sortBy(by)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def write_tables(scans: DataFrame, findings: DataFrame, path: str, mode: str = "append",
                 moved: bool = True) -> None:
    """K1: ``<path>/scans`` and ``<path>/findings`` by scan date. A finding is stored under the
    date of its own scan, so that a window of days prunes both tables alike; a finding whose scan
    is not among ``scans`` goes under the day it was first seen. Without ``moved``, for scans of few days
    such as those of one run, findings are written by the tasks that made them."""
    write_by_date(scans, f"{path}/scans", mode=mode)
    dates = scans.select("scan_id", F.col("scan_date").alias("_date")).distinct()
    dated = (findings.drop("scan_date").join(dates, "scan_id", "left")
             .withColumn("scan_date", F.coalesce("_date", F.to_date("first_seen"))).drop("_date"))
    write_by_date(dated, f"{path}/findings", mode=mode, moved=moved)


def history_lines(df: DataFrame) -> DataFrame:
    """K5: records as escaped log lines."""
    return df.select(history_line().alias("value"))


def write_history(df: DataFrame, path: str) -> None:
    """K5: append to the log folder."""
    history_lines(df).write.mode("append").text(path)


def compliance_table(report: DataFrame) -> DataFrame:
    """K6: a compliance report under its column titles, all text."""
    def text(name: str):
        c = F.col(name)
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss") if name == "scanned_at" else c.cast("string")

    return report.select(*[text(c).alias(title) for title, c in COMPLIANCE_COLUMNS.items()])


def write_compliance_csv(report: DataFrame, path: str) -> None:
    """K6: CSV with a header; the report's order is kept inside and across the part files."""
    compliance_table(report).write.mode("overwrite").csv(path, header=True)
