"""The four rollups as partitioned tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.analytics import (
    hourly_window, repo_health_daily, team_leaderboard_weekly, top_rules_daily, trend_hourly)
from riskloom.session import stored


def rollups(findings: DataFrame, scans: DataFrame, as_of: str) -> dict[str, DataFrame]:
    return {
        "top_rules_daily": top_rules_daily(findings, scans),
        "repo_health_daily": repo_health_daily(scans),
        "team_leaderboard_weekly": team_leaderboard_weekly(scans),
        "vulnerability_trend_hourly": trend_hourly(scans, as_of),
    }


_TIME = {"top_rules_daily": "day", "repo_health_daily": "day", "team_leaderboard_weekly": "week",
         "vulnerability_trend_hourly": "hour"}


#: What the rollups read of a scan.
SCAN_COLUMNS = {"scan_id", "scan_date", "timestamp", "org_id", "team_id", "repo_id", "repo_name",
                "total_findings", "critical_count", "high_count", "medium_count", "low_count",
                "ai_ratio", "scan_duration_ms"}


def whole_weeks(first: date, last: date) -> tuple[date, date]:
    """The Monday at or before ``first`` and the Sunday at or after ``last``."""
    return first - timedelta(first.weekday()), last + timedelta(6 - last.weekday())


def _within(df: DataFrame, first: date, last: date) -> Column:
    """Whether a row lies in these days, by whatever the table has for it."""
    inside = F.lit(True)
    if "scan_date" in df.columns:
        inside = F.col("scan_date").between(F.lit(first), F.lit(last))
    if "timestamp" in df.columns:
        inside = inside & (F.col("timestamp") >= F.lit(str(first)).cast("timestamp_ntz")) \
            & (F.col("timestamp") < F.lit(str(last + timedelta(1))).cast("timestamp_ntz"))
    return inside


def _between(df: DataFrame, first: date, last: date) -> DataFrame:
    return df.where(_within(df, first, last))


def refresh_rollups(findings: DataFrame, scans: DataFrame, as_of: str, path: str,
                    first: date | None = None, last: date | None = None) -> None:
    """Write every rollup, one folder per week.

    ``findings`` and ``scans`` are the stored tables, whole. With ``first`` and ``last`` only the
    weeks that these days touch are read, computed and replaced: a folder is always made from all
    scans of its week, and folders of other weeks stay as they are. The hourly rollup
    covers seven days and is replaced as a whole.

    A scan may be the result of joins and counts of its own, so the columns that the rollups read are
    computed once and stored, for all rollups or for those of the weeks.
    """
    scans = scans.select([c for c in scans.columns if c in SCAN_COLUMNS])
    if first is None and last is None:
        parts = rollups(findings, stored(scans), as_of)
    elif first is None or last is None:
        raise ValueError("first and last belong together")
    else:
        span = whole_weeks(first, last)
        near = stored(scans.where(_within(scans, *span) | hourly_window(scans, as_of)))
        parts = rollups(_between(findings, *span), _between(near, *span), as_of)
        parts["vulnerability_trend_hourly"] = trend_hourly(near, as_of)
    for name, df in parts.items():
        hourly = name == "vulnerability_trend_hourly"
        dated = df.withColumn("period", F.date_format(F.date_trunc("week", _TIME[name]), "yyyy-MM-dd"))
        mode = "static" if hourly or first is None else "dynamic"
        (dated.hint("rebalance", F.col("period")).write.mode("overwrite")
         .option("partitionOverwriteMode", mode).partitionBy("period").parquet(f"{path}/{name}"))


def read_rollups(spark, path: str) -> dict[str, DataFrame]:
    """The four rollups as they were written."""
    return {name: spark.read.parquet(f"{path}/{name}").drop("period") for name in _TIME}
