"""The scan history: statistics, series, rankings and the dashboard row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numbers import percent_change, round_exact
from riskloom.functions.severity import RANKS, severity_counts
from riskloom.functions.text import escape_history
from riskloom.sources.history import COUNTS

DAY = 86_400


def parse_days(raw: str) -> int:
    """``30d`` or ``30``; zero is refused."""
    days = int(raw.strip().lower().removesuffix("d"))
    if days <= 0:
        raise ValueError("the number of days must be greater than zero")
    return days


def history_window(df: DataFrame, as_of: int, days: float | None) -> DataFrame:
    """Records from N days before ``as_of`` (epoch seconds) on; no days keep all."""
    if not days or days <= 0:
        return df
    return df.where(F.col("timestamp") >= as_of - int(days * DAY))


def history_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Half-open range of epoch seconds."""
    return df.where((F.col("timestamp") >= start) & (F.col("timestamp") < end))


def _sums(condition: Column | None = None, prefix: str = "") -> list[Column]:
    def total(name: str) -> Column:
        value = F.col(name) if condition is None else F.when(condition, F.col(name))
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    scans = F.count("*") if condition is None else F.count_if(condition)
    return [scans.alias(prefix + "scans"), total("total").alias(prefix + "findings"),
            *[total(s).alias(prefix + s) for s in RANKS],
            total("ai_estimated").alias(prefix + "ai_estimated")]


def _ratio4(ai: Column, findings: Column) -> Column:
    return F.when(findings > 0, round_exact(ai.cast("double") / findings, 4, "up")).otherwise(
        F.lit(0.0))


def history_stats(df: DataFrame) -> DataFrame:
    """Totals of the log."""
    return df.agg(*_sums())


def history_rule_counts(df: DataFrame) -> DataFrame:
    """How often each rule was the top rule."""
    named = df.where(~F.coalesce(F.col("top_rule"), F.lit("")).isin("", "-"))
    return named.groupBy(F.col("top_rule").alias("rule")).agg(F.count("*").alias("count"))


def history_summary(df: DataFrame) -> DataFrame:
    """Totals with ratio (4 decimals) and mean findings per scan (2 decimals)."""
    out = history_stats(df)
    mean = round_exact(F.col("findings").cast("double") / F.col("scans"), 2, "up")
    return out.withColumns({
        "high_or_above": F.col("critical") + F.col("high"),
        "ai_ratio": _ratio4(F.col("ai_estimated"), F.col("findings")),
        "avg_findings_per_scan": F.when(F.col("scans") > 0, mean).otherwise(F.lit(0.0))})


def history_series(df: DataFrame) -> DataFrame:
    """One row per UTC day, ascending."""
    day = F.date_add(F.lit("1970-01-01").cast("date"),
                     F.floor(F.col("timestamp") / DAY).cast("int")).cast("string")
    return df.groupBy(day.alias("day")).agg(*_sums()).withColumns({
        "high_or_above": F.col("critical") + F.col("high"),
        "ai_ratio": _ratio4(F.col("ai_estimated"), F.col("findings"))}).orderBy("day")


def history_top_rules(df: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent top rules."""
    return history_rule_counts(df).orderBy(F.desc("count"), "rule").limit(max(1, n))


def history_top_targets(df: DataFrame, n: int = 10) -> DataFrame:
    """Targets with most findings."""
    target = F.when(F.coalesce(F.col("target"), F.lit("")) == "", ".").otherwise(F.col("target"))
    return df.groupBy(target.alias("target")).agg(
        F.sum("total").alias("findings"), F.count("*").alias("scans"),
        F.sum("critical").alias("critical"), F.sum("high").alias("high"),
    ).orderBy(F.desc("findings"), "target").limit(max(1, n))


def history_dashboard(df: DataFrame, as_of: int, days: int) -> DataFrame:
    """Current and previous window, five changes and metadata from one pass."""
    start, before = as_of - days * DAY, as_of - 2 * days * DAY
    ts = F.col("timestamp")
    current, previous = ts >= start, (ts >= before) & (ts < start)
    day = F.when(current, F.floor(ts / DAY))
    both = df.agg(*_sums(current), *_sums(previous, "prev_"),
                  F.count("*").alias("total_scans_available"),
                  F.countDistinct(day).alias("days_with_activity"))
    both = both.withColumns({
        "high_or_above": F.col("critical") + F.col("high"),
        "ai_ratio": _ratio4(F.col("ai_estimated"), F.col("findings")),
        "_prev_hoa": F.col("prev_critical") + F.col("prev_high"),
        "_prev_ratio": _ratio4(F.col("prev_ai_estimated"), F.col("prev_findings"))})
    mean = round_exact(F.col("findings").cast("double") / F.col("scans"), 2, "up")
    changed = {
        "avg_findings_per_scan": F.when(F.col("scans") > 0, mean).otherwise(F.lit(0.0)),
        "scans_delta_pct": percent_change(F.col("scans"), F.col("prev_scans")),
        "findings_delta_pct": percent_change(F.col("findings"), F.col("prev_findings")),
        "critical_delta_pct": percent_change(F.col("critical"), F.col("prev_critical")),
        "high_or_above_delta_pct": percent_change(F.col("high_or_above"), F.col("_prev_hoa")),
        "ai_ratio_delta_pct": percent_change(F.col("ai_ratio") * 100, F.col("_prev_ratio") * 100)}
    return both.withColumns(changed).select(
        "scans", "findings", *RANKS, "ai_estimated", "high_or_above", "ai_ratio", *changed,
        F.col("prev_scans").alias("previous_window_scans"),
        F.col("prev_findings").alias("previous_window_findings"), "total_scans_available",
        "days_with_activity")


def history_line() -> Column:
    """One escaped log line from record columns."""
    top = F.when(F.coalesce(F.col("top_rule"), F.lit("")) == "", "-").otherwise(F.col("top_rule"))
    return F.concat_ws("|", F.col("timestamp").cast("string"), escape_history("target"),
                       *[F.col(c).cast("string") for c in COUNTS], escape_history(top))


def to_history(findings: DataFrame, keys: tuple[str, ...] = ("target", "timestamp"),
               col: str = "id") -> DataFrame:
    """History records of scans from their findings; ``keys`` name the scan columns. The top
    rule comes from counts per rule, so a scan of any size is reduced in the tasks first."""
    per_rule = findings.groupBy(*keys, col).agg(
        F.count("*").alias("total"), *severity_counts(),
        F.count_if(F.col("ai_confidence") >= 70).alias("ai_estimated"))
    best = F.max(F.struct(F.col("total").alias("n"), F.col(col).alias("rule")))
    return per_rule.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in COUNTS], best["rule"].alias("top_rule"))
