"""Dashboard queries over the ``scans`` and ``findings`` tables.

``as_of`` is always an argument; nothing reads the clock. Scans are filtered before any join, no
side is hinted: a scans window that is small at run time is broadcast by adaptive execution, and a
scan that holds a large part of all findings is split by its skew handling, because every
aggregate above the join starts with a partial one in the same stage.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.numbers import percent_change, ratio, round_exact
from riskloom.functions.scoring import compliance_score, heat_level, security_score
from riskloom.session import stored

SEVERITY_SUMS = {"critical": "critical_count", "high": "high_count", "medium": "medium_count",
                 "low": "low_count", "info": "info_count"}
AI_THRESHOLD = 0.6


# Filters -------------------------------------------------------------------------------------

def _moment(as_of: str | datetime | date) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def _back(as_of: str | datetime, days: int) -> Column:
    return _moment(as_of) - F.make_dt_interval(F.lit(days))


def scoped(df: DataFrame, **ids: str | None) -> DataFrame:
    """P10: equality filters; a value of None means no filter."""
    for name, value in ids.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def _from(df: DataFrame, bound: Column, ts: str, until: Column | None = None) -> DataFrame:
    """Read only the day folders from a moment on, and up to one, where the table is stored by
    day."""
    if ts == "timestamp" and "scan_date" in df.columns:
        df = df.where(F.col("scan_date") >= F.to_date(bound))
        if until is not None:
            df = df.where(F.col("scan_date") <= F.to_date(until))
    return df


def window_days(df: DataFrame, as_of: str | datetime, start: int, end: int = 0,
                ts: str = "timestamp") -> DataFrame:
    """Later than ``start`` days ago and not later than ``end`` days ago."""
    rows = _from(df, _back(as_of, start), ts, _back(as_of, end))
    return rows.where((F.col(ts) > _back(as_of, start)) & (F.col(ts) <= _back(as_of, end)))


def since_days(df: DataFrame, as_of: str | datetime, days: int, inclusive: bool = False,
               ts: str = "timestamp") -> DataFrame:
    """P11, one-sided: later than N days ago, or from N days ago on."""
    bound = _back(as_of, days)
    rows = _from(df, bound, ts)
    return rows.where(F.col(ts) >= bound if inclusive else F.col(ts) > bound)


def _scan_key(findings: DataFrame, scans: DataFrame) -> list[str]:
    """A scan's day, where both tables are stored by it, and its id."""
    dated = "scan_date" in findings.columns and "scan_date" in scans.columns
    return ["scan_date", "scan_id"] if dated else ["scan_id"]


def _joined(findings: DataFrame, scans: DataFrame, *cols: str) -> DataFrame:
    """Findings of the given scans with a few scan columns."""
    key = _scan_key(findings, scans)
    return findings.join(scans.select(*key, *cols), key)


def _recent(findings: DataFrame, scans: DataFrame, as_of: str | datetime, days: int,
            ids: dict, inclusive: bool = False) -> DataFrame:
    """J2 for the scans later than ``days`` ago: both tables read only those days."""
    return _joined(_from(findings, _back(as_of, days), "timestamp"),
                   since_days(scoped(scans, **ids), as_of, days, inclusive))


# Summary and trend (G2-G4) -------------------------------------------------------------------

def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("bigint")


def _scan_sums() -> list[Column]:
    return [F.countDistinct("scan_id").alias("total_scans"),
            _total("total_findings").alias("total_findings"),
            *[_total(c).alias(name) for name, c in SEVERITY_SUMS.items()],
            _total("ai_estimated_count").alias("ai_estimated")]


def summary(scans: DataFrame, as_of: str, days: int, end: int = 0, **ids: str | None) -> DataFrame:
    """One row of totals for a window."""
    rows = window_days(scoped(scans, **ids), as_of, days, end)
    return rows.agg(*_scan_sums()).withColumn(
        "ai_ratio", ratio(F.col("ai_estimated"), F.col("total_findings")))


def summary_trend(scans: DataFrame, as_of: str, days: int, **ids: str | None) -> DataFrame:
    """The window, the equal window before it and three changes, from one pass."""
    rows = window_days(scoped(scans, **ids), as_of, 2 * days)
    current = F.col("timestamp") > _back(as_of, days)
    halves = rows.groupBy(F.when(current, "cur").otherwise("prev").alias("half")).agg(*_scan_sums())
    names = ["total_scans", "total_findings", *SEVERITY_SUMS, "ai_estimated"]

    def pick(half: str, name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("half") == half, F.col(name))), F.lit(0))

    both = halves.agg(*[pick("cur", n).alias(n) for n in names],
                      *[pick("prev", n).alias("prev_" + n)
                        for n in ("total_scans", "total_findings", "ai_estimated")])
    both = both.withColumns({
        "ai_ratio": ratio(F.col("ai_estimated"), F.col("total_findings")),
        "prev_ai_ratio": ratio(F.col("prev_ai_estimated"), F.col("prev_total_findings"))})
    return both.withColumns({
        "findings_delta_pct": percent_change(F.col("total_findings"), F.col("prev_total_findings")),
        "ai_ratio_delta_pct": percent_change(F.col("ai_ratio") * 100, F.col("prev_ai_ratio") * 100),
        "scans_delta_pct": percent_change(F.col("total_scans"), F.col("prev_total_scans"))})


def time_series(scans: DataFrame, as_of: str, days: int, **ids: str | None) -> DataFrame:
    """One row per day, ascending."""
    rows = since_days(scoped(scans, **ids), as_of, days)
    daily = rows.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.countDistinct("scan_id").alias("scans"), _total("total_findings").alias("findings"),
        *[_total(c).alias(name) for name, c in SEVERITY_SUMS.items()],
        _total("ai_estimated_count").alias("ai_estimated"))
    return daily.withColumns({
        "high_or_above": F.col("critical") + F.col("high"),
        "ai_ratio": ratio(F.col("ai_estimated"), F.col("findings"))}).orderBy("date")


# Rankings (G5, G6) ---------------------------------------------------------------------------

def top_rules(findings: DataFrame, scans: DataFrame, as_of: str, days: int, limit: int = 10,
              **ids: str | None) -> DataFrame:
    """Most frequent (rule, title, severity)."""
    rows = _recent(findings, scans, as_of, days, ids)
    return rows.groupBy("rule_id", "rule_title", "severity").agg(F.count("*").alias("count")
        ).orderBy(F.desc("count"), "rule_id", "rule_title", "severity").limit(limit)


def top_repos(scans: DataFrame, as_of: str, days: int, limit: int = 10, **ids: str | None
              ) -> DataFrame:
    """Repositories with most findings; scans without a repository are left out."""
    rows = since_days(scoped(scans, **ids), as_of, days).where(F.col("repo_id").isNotNull())
    return rows.groupBy("repo_id", "repo_name").agg(
        F.countDistinct("scan_id").alias("scans"),
        F.sum("total_findings").cast("bigint").alias("findings"),
        F.avg("ai_ratio").alias("ai_ratio"),
    ).orderBy(F.desc("findings"), "repo_id", "repo_name").limit(limit)


# Compliance (G7-G10) -------------------------------------------------------------------------

def _filled(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def compliance_coverage(findings: DataFrame, scans: DataFrame, as_of: str, days: int,
                        **ids: str | None) -> DataFrame:
    """Findings with a CWE or OWASP key, and their share in percent."""
    rows = _recent(findings, scans, as_of, days, ids)
    counted = rows.agg(F.count("*").alias("total_findings"),
                       F.count_if(_filled("cwe_id") | _filled("owasp_category"))
                       .alias("classified_findings"))
    return counted.withColumn("coverage_pct", ratio(
        F.col("classified_findings"), F.col("total_findings")) * 100.0)


def _top_key(findings: DataFrame, scans: DataFrame, as_of: str, days: int, key: str, limit: int,
             **ids: str | None) -> DataFrame:
    rows = _recent(findings.where(_filled(key)), scans, as_of, days, ids)
    return rows.groupBy(F.col(key).alias("key")).agg(
        F.count("*").alias("count"),
        *[F.count_if(F.col("severity") == s).alias(s)
          for s in ("critical", "high", "medium", "low")],
    ).orderBy(F.desc("count"), "key").limit(max(limit, 1))


def top_cwe(findings: DataFrame, scans: DataFrame, as_of: str, days: int, limit: int = 10,
            **ids: str | None) -> DataFrame:
    """Most frequent CWE ids."""
    return _top_key(findings, scans, as_of, days, "cwe_id", limit, **ids)


def top_owasp(findings: DataFrame, scans: DataFrame, as_of: str, days: int, limit: int = 10,
              **ids: str | None) -> DataFrame:
    """Most frequent OWASP categories."""
    return _top_key(findings, scans, as_of, days, "owasp_category", limit, **ids)


def top_value_per(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent non-empty value per key, ties to the smallest value. Counted
    first, so a hot key sends its distinct values and not its rows."""
    counts = df.where(_filled(value)).groupBy(key, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), F.asc(value))
    return counts.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(
        key, F.col(value).alias("top_" + value))


def _per_scan(findings: DataFrame) -> DataFrame:
    """Counts and the most frequent CWE and OWASP keys per scan, from one pass: every finding
    counts once for each of its two keys, and a scan's totals are those of its CWE rows."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value"))
                                for k in ("cwe_id", "owasp_category")]))
    levels = ("critical", "high", "medium", "low")
    counts = findings.select("scan_id", "severity", kinds.alias("k")).groupBy(
        "scan_id", "k.kind", "k.value").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in levels])
    main = F.col("kind") == "cwe_id"

    def top(kind: str) -> Column:
        named = (F.col("kind") == kind) & _filled("value")
        return F.min(F.when(named, F.struct((-F.col("n")).alias("n"), "value")))["value"]

    return counts.groupBy("scan_id").agg(
        F.sum(F.when(main, F.col("n"))).alias("total_findings"),
        *[F.sum(F.when(main, F.col(s))).alias(s) for s in levels],
        top("cwe_id").alias("top_cwe_id"), top("owasp_category").alias("top_owasp_category"))


def compliance_report(findings: DataFrame, scans: DataFrame, org: str, start: str, end: str
                      ) -> DataFrame:
    """G10 (J3, J4, X12): one row per scan of an organisation in a date range, newest first.

    Findings are reduced to one row per scan before they meet the scans, so the outer join moves
    no finding twice.
    """
    ts = F.col("timestamp")
    last = _moment(end) + F.make_dt_interval(F.lit(1))
    chosen = _from(scans, _moment(start), "timestamp", last).where(
        (F.col("org_id") == org) & (ts >= _moment(start)) & (ts <= last))
    key = _scan_key(findings, scans)
    wanted = _from(findings, _moment(start), "timestamp", last).join(
        chosen.select(*key), key, "left_semi")
    out = (chosen.select("scan_id", "org_id", "team_id", "repo_id", "timestamp")
           .join(_per_scan(wanted), "scan_id", "left"))
    zero = {c: 0 for c in ("total_findings", "critical", "high", "medium", "low")}
    named = {c: "N/A" for c in ("team_id", "repo_id", "top_cwe_id", "top_owasp_category")}
    out = out.fillna(zero).fillna(named)
    cols = [F.col(c) for c in zero]
    return out.select(
        "org_id", "team_id", "repo_id", F.col("timestamp").alias("scanned_at"), *cols,
        F.col("top_cwe_id").alias("top_cwe"), F.col("top_owasp_category").alias("top_owasp"),
        compliance_score(*cols).alias("compliance_score"), "scan_id",
    ).orderBy(F.desc("scanned_at"), "scan_id")


# Generated-code metrics (G11-G14) ------------------------------------------------------------

def _confidence() -> Column:
    return F.coalesce(F.col("ai_confidence"), F.lit(0)).cast("double")


def tool_of(tendency: Column) -> Column:
    """Tool named by a tendency text."""
    text = F.coalesce(tendency, F.lit(""))
    return (F.when(text.ilike("%copilot%"), "GitHub Copilot")
            .when(text.ilike("%chatgpt%"), "ChatGPT")
            .when(text.ilike("%claude%"), "Claude").otherwise("AI-assisted"))


def ai_summary(findings: DataFrame, scans: DataFrame, as_of: str, days: int = 30,
               **ids: str | None) -> DataFrame:
    """Findings with a confidence of 0.6 or more, and their share."""
    rows = _recent(findings, scans, as_of, days, ids, inclusive=True)
    counted = rows.agg(F.count_if(_confidence() >= AI_THRESHOLD).alias("total_ai_findings"),
                       F.count("*").alias("total_findings"))
    return counted.withColumn("ai_percentage", ratio(
        F.col("total_ai_findings"), F.col("total_findings")) * 100.0)


def ai_by_tool(findings: DataFrame, scans: DataFrame, as_of: str, days: int = 30,
               **ids: str | None) -> DataFrame:
    """Likely generated findings per tool with their share."""
    rows = _recent(findings.where(_confidence() >= AI_THRESHOLD), scans, as_of, days, ids, inclusive=True)
    tools = rows.groupBy(tool_of(F.col("ai_tendency")).alias("tool")).agg(
        F.count("*").alias("findings"), F.avg(_confidence() * 100.0).alias("avg_confidence"))
    total = F.sum("findings").over(Window.partitionBy(F.lit(0)))  # four tools, so four rows
    return tools.withColumn("percentage", ratio(F.col("findings"), total) * 100.0).orderBy(
        F.desc("findings"), "tool").limit(10)


def ai_by_pattern(findings: DataFrame, scans: DataFrame, as_of: str, days: int = 30,
                  **ids: str | None) -> DataFrame:
    """Likely generated findings per rule and tool."""
    rows = _recent(findings.where(_confidence() >= AI_THRESHOLD), scans, as_of, days, ids, inclusive=True)
    return rows.groupBy(
        F.col("rule_id").alias("pattern_id"),
        F.coalesce("rule_title", "rule_id").alias("description"),
        tool_of(F.col("ai_tendency")).alias("tool"),
    ).agg(F.count("*").alias("count"), F.avg(_confidence() * 100.0).alias("avg_confidence")
          ).orderBy(F.desc("count"), "pattern_id", "description", "tool").limit(10)


def confidence_bands(findings: DataFrame, scans: DataFrame, as_of: str, days: int = 30,
                     **ids: str | None) -> DataFrame:
    """Findings per confidence band."""
    c = F.col("ai_confidence").cast("double")
    return _recent(findings, scans, as_of, days, ids, inclusive=True).agg(
        F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.6) & (c < 0.8)).alias("medium"),
        F.count_if((c > 0) & (c < 0.6)).alias("low"))


# Rollups (G15-G18, G38) ----------------------------------------------------------------------

def top_rules_daily(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Per organisation, team, day and rule. Each distinct count is a reduction of its own, to a row
    per scan and to a row per file, and both are added up together; rows are never expanded. The joined
    rows are stored, as both reductions read them."""
    group = ["org_id", "team_id", "day", "rule_id", "rule_title", "severity"]
    rows = stored(_joined(findings, scans, "org_id", "team_id", "timestamp").select(
        *group[:2], F.date_trunc("day", "timestamp").alias("day"), *group[3:], "scan_id", "file_path",
        "ai_confidence"))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    per_scan = rows.groupBy(*group, "scan_id").agg(
        F.count("*").alias("n"), F.sum(F.col("ai_confidence").cast("double")).alias("c"),
        F.count("ai_confidence").alias("k")).select(
        *group, "n", "c", "k", F.col("scan_id").isNotNull().cast("bigint").alias("scans"),
        zero.alias("files"))
    per_file = rows.where(F.col("file_path").isNotNull()).select(*group, "file_path").distinct().select(
        *group, zero.alias("n"), F.lit(None).cast("double").alias("c"), zero.alias("k"),
        zero.alias("scans"), one.alias("files"))
    return per_scan.unionByName(per_file).groupBy(*group).agg(
        F.sum("scans").alias("scans_with_rule"), F.sum("n").alias("total_occurrences"),
        (F.sum("c") / F.nullif(F.sum("k"), F.lit(0))).alias("avg_ai_confidence"),
        F.sum("files").alias("unique_files_affected"))


def repo_health_daily(scans: DataFrame) -> DataFrame:
    """Per organisation, repository and day."""
    return scans.groupBy("org_id", "repo_id", "repo_name",
                         F.date_trunc("day", "timestamp").alias("day")).agg(
        F.countDistinct("scan_id").alias("total_scans"),
        F.sum("total_findings").alias("total_findings"),
        *[F.sum(f"{s}_count").alias(f"{s}_findings")
          for s in ("critical", "high", "medium", "low")],
        F.avg("ai_ratio").alias("avg_ai_ratio"),
        F.avg("scan_duration_ms").alias("avg_scan_duration_ms"))


def team_leaderboard_weekly(scans: DataFrame) -> DataFrame:
    """Per organisation, team and week with the security score."""
    rows = scans.where(F.col("team_id").isNotNull())
    weekly = rows.groupBy("org_id", "team_id", F.date_trunc("week", "timestamp").alias("week")).agg(
        F.countDistinct("scan_id").alias("scans_performed"),
        F.sum("total_findings").alias("total_findings"),
        F.sum(F.col("critical_count") + F.col("high_count")).alias("high_severity_count"),
        F.avg("ai_ratio").alias("avg_ai_ratio"),
        F.sum("critical_count").alias("_c"), F.sum("high_count").alias("_h"))
    return weekly.withColumn("security_score", security_score(F.col("_c"), F.col("_h"))
                             ).drop("_c", "_h")


def hourly_window(scans: DataFrame, as_of: str, days: int = 7) -> Column:
    """Whether a scan is one of :func:`trend_hourly`; a condition on its day lets folders be skipped."""
    recent = F.col("timestamp") > _back(as_of, days)
    if "scan_date" in scans.columns:
        recent = recent & (F.col("scan_date") >= F.to_date(_back(as_of, days)))
    return recent


def trend_hourly(scans: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Per organisation and hour, last seven days."""
    return since_days(scans, as_of, days).groupBy(
        "org_id", F.date_trunc("hour", "timestamp").alias("hour")).agg(
        F.countDistinct("scan_id").alias("scans"), F.sum("total_findings").alias("findings"),
        *[F.sum(f"{s}_count").alias(s) for s in ("critical", "high", "medium")],
        F.avg("ai_ratio").alias("ai_ratio"))


def org_rollup(scans: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per organisation."""
    return since_days(scans, as_of, days).groupBy("org_id").agg(
        F.count("*").alias("scans"), F.sum("total_findings").alias("findings"),
        F.avg("ai_ratio").alias("avg_ai_ratio"))


# Team views (G27-G29, O2) --------------------------------------------------------------------

def _by_team(scans: DataFrame) -> DataFrame:
    team = F.when(F.coalesce(F.col("team_id"), F.lit("")) == "", "Unassigned").otherwise(
        F.col("team_id"))
    return scans.groupBy(team.alias("team")).agg(
        F.sum("total_findings").alias("total"),
        *[F.sum(f"{s}_count").alias(s) for s in ("critical", "high", "medium", "low")],
        F.count("*").alias("scans"), F.sum("ai_estimated_count").alias("ai_estimated"))


def team_heatmap(scans: DataFrame) -> DataFrame:
    """Teams by findings with heat level and width in percent of the largest."""
    teams = _by_team(scans).drop("ai_estimated")
    largest = teams.agg(F.greatest(F.max("total"), F.lit(1))).scalar()
    return teams.withColumns({
        "heat": heat_level(F.col("total"), F.col("critical"), F.col("high")),
        "width_pct": F.col("total") / largest * 100.0}).orderBy(F.desc("total"), "team")


def team_comparison(scans: DataFrame, limit: int = 8) -> DataFrame:
    """The teams with most findings and their mean per scan."""
    mean = round_exact(F.col("total").cast("double") / F.col("scans"), 1, "up")
    return _by_team(scans).drop("medium", "low").withColumn("avg_findings", mean).orderBy(
        F.desc("total"), "team").limit(limit)


def filter_values(scans: DataFrame) -> DataFrame:
    """Distinct organisations, teams and repositories as (field, value)."""
    fields = {"org": "org_id", "team": "team_id", "repo": "repo_name"}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(c).alias("value"))
                                for k, c in fields.items()]))
    rows = scans.select(pairs.alias("p")).select("p.*")
    return rows.where(F.coalesce(F.col("value"), F.lit("")) != "").distinct().orderBy(
        "field", "value")


PAGE_ROWS = 1000


def list_scans(scans: DataFrame, limit: int = 100, offset: int = 0,
               after: tuple[str | datetime, str] | None = None, **ids: str | None) -> DataFrame:
    """O2: newest scans first, a page of at most ``PAGE_ROWS``. ``after`` is the timestamp and
    scan_id of the last row of the page before: later pages cost as much as the first one, where
    ``offset`` sorts all rows before it."""
    if not 0 <= limit <= PAGE_ROWS:
        raise ValueError(f"a page has at most {PAGE_ROWS} rows")
    rows = scoped(scans, **ids)
    if after is not None:
        ts = _moment(after[0])
        rows = rows.where((F.col("timestamp") < ts)
                          | ((F.col("timestamp") == ts) & (F.col("scan_id") > after[1])))
        if "scan_date" in rows.columns:
            rows = rows.where(F.col("scan_date") <= F.to_date(ts))
    return rows.select(
        "scan_id", "org_id", "team_id", "repo_id", "repo_name", "branch", "commit_sha",
        F.col("timestamp").alias("scanned_at"), "total_findings",
        *[F.col(c).alias(name) for name, c in SEVERITY_SUMS.items()], "ai_estimated_count",
    ).orderBy(F.desc("scanned_at"), "scan_id").offset(offset).limit(limit)


# Integrity (J8) ------------------------------------------------------------------------------

def orphans(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Findings whose scan does not exist."""
    return findings.join(scans.select("scan_id"), "scan_id", "left_anti")


def cascade_delete(findings: DataFrame, scans: DataFrame, deleted: DataFrame
                   ) -> tuple[DataFrame, DataFrame]:
    """Both tables without the deleted scans."""
    gone = deleted.select("scan_id").distinct()
    return (findings.join(gone, "scan_id", "left_anti"), scans.join(gone, "scan_id", "left_anti"))
