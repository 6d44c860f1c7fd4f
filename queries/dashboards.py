"""Queries over the scans and findings tables."""

from __future__ import annotations

import uuid
from datetime import date
from functools import reduce

from pyspark.sql import functions as F

from queries import views as v
from queries.sqlparts import change, exact, rank, ratio
from riskloom.functions import text as tx
from riskloom.functions.numbers import percent_change
from riskloom.functions.scoring import compliance_score, security_score
from riskloom.functions.severity import min_severity
from riskloom.operators import analytics as an
from riskloom.operators import findings as fd
from riskloom.plans.rollups import read_rollups, refresh_rollups
from riskloom.session import shared_dir

QUERIES: dict = {}
SQL: dict = {}
AS_OF = "2001-08-01"
ORG, TEAM = "ASIA", "BUILDING"
T0 = f"TIMESTAMP '{AS_OF} 00:00:00'"


def add(name: str, sql: str | None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return put


def r6(name: str):
    return F.round(F.col(name).cast("double"), 6).alias(name)


def with_r6(df, *names: str):
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


def after(days: int, op: str = ">") -> str:
    return f"ts {op} {T0} - INTERVAL {days} DAY"


_SUMS = """count(DISTINCT scan_id) AS total_scans,
  coalesce(sum(total_findings), 0)::BIGINT AS total_findings,
  coalesce(sum(critical_count), 0)::BIGINT AS critical, coalesce(sum(high_count), 0)::BIGINT AS high,
  coalesce(sum(medium_count), 0)::BIGINT AS medium, coalesce(sum(low_count), 0)::BIGINT AS low,
  coalesce(sum(info_count), 0)::BIGINT AS info,
  coalesce(sum(ai_estimated_count), 0)::BIGINT AS ai_estimated"""
_BOTH = v.WITH_BOTH
_SCANS = f"WITH {v.WITH_SCANS}"
_JOIN = "findings f JOIN scans s ON f.scan_id = s.scan_id"


@add("summary", f"""{_SCANS}, a AS (SELECT {_SUMS} FROM scans WHERE {after(90)} AND ts <= {T0})
SELECT *, round({ratio('ai_estimated', 'total_findings')}, 6) AS ai_ratio FROM a""")
def _(spark, sf):
    return with_r6(an.summary(v.scans(spark, sf), AS_OF, 90), "ai_ratio")


@add("summary_scoped", f"""{_SCANS}, a AS (SELECT {_SUMS} FROM scans
WHERE {after(400)} AND ts <= {T0} - INTERVAL 30 DAY AND org_id = '{ORG}' AND team_id = '{TEAM}')
SELECT *, round({ratio('ai_estimated', 'total_findings')}, 6) AS ai_ratio FROM a""")
def _(spark, sf):
    return with_r6(an.summary(v.scans(spark, sf), AS_OF, 400, 30, org_id=ORG, team_id=TEAM),
                   "ai_ratio")


@add("summary_trend", f"""{_SCANS},
c AS (SELECT {_SUMS} FROM scans WHERE {after(180)} AND ts <= {T0}),
p AS (SELECT {_SUMS} FROM scans WHERE {after(360)} AND {after(180, '<=')}),
b AS (SELECT c.*, p.total_scans AS prev_total_scans, p.total_findings AS prev_total_findings,
  p.ai_estimated AS prev_ai_estimated,
  {ratio('c.ai_estimated', 'c.total_findings')} AS ai_ratio,
  {ratio('p.ai_estimated', 'p.total_findings')} AS prev_ai_ratio FROM c, p)
SELECT * EXCLUDE (ai_ratio, prev_ai_ratio), round(ai_ratio, 6) AS ai_ratio,
  round(prev_ai_ratio, 6) AS prev_ai_ratio,
  {change('total_findings', 'prev_total_findings')} AS findings_delta_pct,
  {change('(ai_ratio * 100)', '(prev_ai_ratio * 100)')} AS ai_ratio_delta_pct,
  {change('total_scans', 'prev_total_scans')} AS scans_delta_pct FROM b""")
def _(spark, sf):
    return with_r6(an.summary_trend(v.scans(spark, sf), AS_OF, 180), "ai_ratio", "prev_ai_ratio")


@add("time_series", f"""{_SCANS}, d AS (SELECT ts::DATE AS date, count(DISTINCT scan_id) AS scans,
  sum(total_findings)::BIGINT AS findings, sum(critical_count)::BIGINT AS critical,
  sum(high_count)::BIGINT AS high, sum(medium_count)::BIGINT AS medium,
  sum(low_count)::BIGINT AS low, sum(info_count)::BIGINT AS info,
  sum(ai_estimated_count)::BIGINT AS ai_estimated FROM scans WHERE {after(365)} GROUP BY 1)
SELECT *, critical + high AS high_or_above,
  round({ratio('ai_estimated', 'findings')}, 6) AS ai_ratio FROM d""")
def _(spark, sf):
    return with_r6(an.time_series(v.scans(spark, sf), AS_OF, 365), "ai_ratio")


@add("top_rules", f"""{_BOTH} SELECT rule_id, rule_title, severity, count(*) AS count FROM {_JOIN}
WHERE {after(365)} GROUP BY 1, 2, 3 ORDER BY count DESC, rule_id, rule_title, severity LIMIT 10""")
def _(spark, sf):
    return an.top_rules(v.findings(spark, sf), v.scans(spark, sf), AS_OF, 365)


@add("top_repos", f"""{_SCANS} SELECT repo_id, repo_name, count(DISTINCT scan_id) AS scans,
  sum(total_findings)::BIGINT AS findings, round(avg(ai_ratio::DOUBLE), 6) AS ai_ratio FROM scans
WHERE {after(730)} AND repo_id IS NOT NULL GROUP BY 1, 2
ORDER BY findings DESC, repo_id, repo_name LIMIT 10""")
def _(spark, sf):
    return with_r6(an.top_repos(v.scans(spark, sf), AS_OF, 730), "ai_ratio")


@add("compliance_coverage", f"""{_BOTH}, c AS (SELECT count(*) AS total_findings,
  count(*) FILTER (WHERE cwe_id <> '' OR owasp_category <> '') AS classified_findings
  FROM {_JOIN} WHERE {after(365)})
SELECT *, round({ratio('classified_findings', 'total_findings')} * 100, 6) AS coverage_pct FROM c""")
def _(spark, sf):
    return with_r6(an.compliance_coverage(v.findings(spark, sf), v.scans(spark, sf), AS_OF, 365),
                   "coverage_pct")


def _top_key_sql(key: str) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}"
                       for s in ("critical", "high", "medium", "low"))
    return f"""{_BOTH} SELECT {key} AS key, count(*) AS count, {counts} FROM {_JOIN}
WHERE {after(365)} AND {key} <> '' GROUP BY 1 ORDER BY count DESC, key LIMIT 10"""


@add("top_cwe", _top_key_sql("cwe_id"))
def _(spark, sf):
    return an.top_cwe(v.findings(spark, sf), v.scans(spark, sf), AS_OF, 365)


@add("top_owasp", _top_key_sql("owasp_category"))
def _(spark, sf):
    return an.top_owasp(v.findings(spark, sf), v.scans(spark, sf), AS_OF, 365)


def _top_value_sql(key: str, value: str) -> str:
    return f"""(SELECT {key}, {value} AS top_{value} FROM (SELECT {key}, {value},
  row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {value}) AS r FROM findings
  WHERE {value} <> '' GROUP BY 1, 2) WHERE r = 1)"""


@add("top_value_per", f"WITH {v.WITH_FINDINGS} SELECT * FROM {_top_value_sql('file_path', 'cwe_id')}")
def _(spark, sf):
    return an.top_value_per(v.findings(spark, sf), "file_path", "cwe_id")


_POINTS = ("100 - least((critical * 10 + high * 5 + medium * 2 + low)::DOUBLE / total_findings, "
           "100)")


def report_cte(start: str, end: str) -> str:
    """j: the compliance report without its score."""
    return f"""{_BOTH}, n AS (SELECT scan_id, count(*) AS total_findings,
  count(*) FILTER (WHERE severity = 'critical') AS critical,
  count(*) FILTER (WHERE severity = 'high') AS high,
  count(*) FILTER (WHERE severity = 'medium') AS medium,
  count(*) FILTER (WHERE severity = 'low') AS low FROM findings GROUP BY 1),
c AS {_top_value_sql('scan_id', 'cwe_id')}, o AS {_top_value_sql('scan_id', 'owasp_category')},
j AS (SELECT org_id, coalesce(team_id, 'N/A') AS team_id, coalesce(repo_id, 'N/A') AS repo_id,
  ts AS scanned_at, coalesce(total_findings, 0) AS total_findings, coalesce(critical, 0) AS critical,
  coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low,
  coalesce(top_cwe_id, 'N/A') AS top_cwe, coalesce(top_owasp_category, 'N/A') AS top_owasp,
  s.scan_id FROM (SELECT * EXCLUDE (total_findings) FROM scans) s LEFT JOIN n ON s.scan_id = n.scan_id
  LEFT JOIN c ON s.scan_id = c.scan_id LEFT JOIN o ON s.scan_id = o.scan_id
  WHERE org_id = '{ORG}' AND ts >= DATE '{start}'
    AND ts <= DATE '{end}' + INTERVAL 1 DAY)"""


@add("compliance_report", f"""{report_cte('2000-01-01', '2000-12-31')}
SELECT *, CASE WHEN total_findings <= 0 THEN '100.0%'
  ELSE printf('%.1f%%', {exact(_POINTS, 1)}) END AS compliance_score FROM j""")
def _(spark, sf):
    return an.compliance_report(v.findings(spark, sf), v.scans(spark, sf), ORG, "2000-01-01",
                                "2000-12-31")


@add("compliance_score", f"""{_SCANS}, j AS (SELECT scan_id, total_findings,
  critical_count AS critical, high_count AS high, medium_count AS medium, low_count AS low FROM scans)
SELECT scan_id, CASE WHEN total_findings <= 0 THEN '100.0%'
  ELSE printf('%.1f%%', {exact(_POINTS, 1)}) END AS compliance_score FROM j""")
def _(spark, sf):
    c = F.col
    return v.scans(spark, sf).select("scan_id", compliance_score(
        c("total_findings"), c("critical_count"), c("high_count"), c("medium_count"),
        c("low_count")).alias("compliance_score"))


# Generated-code metrics ----------------------------------------------------------------------

_TOOL = """CASE WHEN coalesce(ai_tendency, '') ILIKE '%copilot%' THEN 'GitHub Copilot'
  WHEN coalesce(ai_tendency, '') ILIKE '%chatgpt%' THEN 'ChatGPT'
  WHEN coalesce(ai_tendency, '') ILIKE '%claude%' THEN 'Claude' ELSE 'AI-assisted' END"""
_SURE = "coalesce(ai_confidence, 0)::DOUBLE >= 0.6::DOUBLE"
_RECENT = f"FROM {_JOIN} WHERE {after(365, '>=')}"


@add("ai_summary", f"""{_BOTH}, c AS (SELECT count(*) FILTER (WHERE {_SURE}) AS total_ai_findings,
  count(*) AS total_findings {_RECENT})
SELECT *, round({ratio('total_ai_findings', 'total_findings')} * 100, 6) AS ai_percentage FROM c""")
def _(spark, sf):
    return with_r6(an.ai_summary(v.findings(spark, sf), v.scans(spark, sf), AS_OF, 365),
                   "ai_percentage")


@add("ai_by_tool", f"""{_BOTH}, t AS (SELECT {_TOOL} AS tool, count(*) AS findings,
  round(avg(ai_confidence::DOUBLE * 100), 6) AS avg_confidence {_RECENT} AND {_SURE} GROUP BY 1)
SELECT *, round({ratio('findings', '(sum(findings) OVER ())')} * 100, 6) AS percentage FROM t""")
def _(spark, sf):
    return with_r6(an.ai_by_tool(v.findings(spark, sf), v.scans(spark, sf), AS_OF, 365),
                   "avg_confidence", "percentage")


@add("ai_by_pattern", f"""{_BOTH} SELECT rule_id AS pattern_id,
  coalesce(rule_title, rule_id) AS description, {_TOOL} AS tool, count(*) AS count,
  round(avg(ai_confidence::DOUBLE * 100), 6) AS avg_confidence {_RECENT} AND {_SURE}
GROUP BY 1, 2, 3 ORDER BY count DESC, pattern_id, description, tool LIMIT 10""")
def _(spark, sf):
    return with_r6(an.ai_by_pattern(v.findings(spark, sf), v.scans(spark, sf), AS_OF, 365),
                   "avg_confidence")


@add("confidence_bands", f"""{_BOTH} SELECT
  count(*) FILTER (WHERE ai_confidence::DOUBLE >= 0.8::DOUBLE) AS high,
  count(*) FILTER (WHERE ai_confidence::DOUBLE >= 0.6::DOUBLE
                   AND ai_confidence::DOUBLE < 0.8::DOUBLE) AS medium,
  count(*) FILTER (WHERE ai_confidence > 0 AND ai_confidence::DOUBLE < 0.6::DOUBLE) AS low
{_RECENT}""")
def _(spark, sf):
    return an.confidence_bands(v.findings(spark, sf), v.scans(spark, sf), AS_OF, 365)


# Rollups -------------------------------------------------------------------------------------

_RULES_DAILY = f"""SELECT org_id, team_id, date_trunc('day', ts)::TIMESTAMP AS day, rule_id,
  rule_title, severity, count(DISTINCT s.scan_id) AS scans_with_rule,
  count(*) AS total_occurrences, round(avg(ai_confidence::DOUBLE), 6) AS avg_ai_confidence,
  count(DISTINCT file_path) AS unique_files_affected FROM {_JOIN} GROUP BY 1, 2, 3, 4, 5, 6"""


@add("top_rules_daily", f"{_BOTH} {_RULES_DAILY}")
def _(spark, sf):
    return with_r6(an.top_rules_daily(v.findings(spark, sf), v.scans(spark, sf)),
                   "avg_ai_confidence")


_HEALTH = """SELECT org_id, repo_id, repo_name, date_trunc('day', ts)::TIMESTAMP AS day,
  count(DISTINCT scan_id) AS total_scans, sum(total_findings)::BIGINT AS total_findings,
  sum(critical_count)::BIGINT AS critical_findings, sum(high_count)::BIGINT AS high_findings,
  sum(medium_count)::BIGINT AS medium_findings, sum(low_count)::BIGINT AS low_findings,
  round(avg(ai_ratio::DOUBLE), 6) AS avg_ai_ratio,
  round(avg(scan_duration_ms), 6) AS avg_scan_duration_ms FROM scans GROUP BY 1, 2, 3, 4"""


@add("repo_health_daily", f"{_SCANS} {_HEALTH}")
def _(spark, sf):
    return with_r6(an.repo_health_daily(v.scans(spark, sf)), "avg_ai_ratio",
                   "avg_scan_duration_ms")


_WEEKLY = """SELECT org_id, team_id, date_trunc('week', ts)::TIMESTAMP AS week,
  count(DISTINCT scan_id) AS scans_performed, sum(total_findings)::BIGINT AS total_findings,
  sum(critical_count + high_count)::BIGINT AS high_severity_count,
  round(avg(ai_ratio::DOUBLE), 6) AS avg_ai_ratio,
  (CASE WHEN sum(critical_count + high_count) = 0 THEN 100
   ELSE greatest(0, 100 - (sum(critical_count) * 10 + sum(high_count) * 3)) END)::BIGINT
   AS security_score FROM scans WHERE team_id IS NOT NULL GROUP BY 1, 2, 3"""


@add("team_leaderboard_weekly", f"{_SCANS} {_WEEKLY}")
def _(spark, sf):
    return with_r6(an.team_leaderboard_weekly(v.scans(spark, sf)), "avg_ai_ratio")


_HOURLY = f"""SELECT org_id, date_trunc('hour', ts)::TIMESTAMP AS hour,
  count(DISTINCT scan_id) AS scans, sum(total_findings)::BIGINT AS findings,
  sum(critical_count)::BIGINT AS critical, sum(high_count)::BIGINT AS high,
  sum(medium_count)::BIGINT AS medium, round(avg(ai_ratio::DOUBLE), 6) AS ai_ratio
  FROM scans WHERE {after(7)} GROUP BY 1, 2"""


@add("trend_hourly", f"{_SCANS} {_HOURLY}")
def _(spark, sf):
    return with_r6(an.trend_hourly(v.scans(spark, sf), AS_OF), "ai_ratio")


_ROLLUP = "SELECT '{0}' AS rollup, org_id, {1} AS owner, {2} AS item, {3} AS period, {4} AS n FROM {5}"


@add("refresh_rollups", f"""{_BOTH}, a AS ({_RULES_DAILY}), b AS ({_HEALTH}), c AS ({_WEEKLY}),
d AS ({_HOURLY}) """ + " UNION ALL ".join([
    _ROLLUP.format("top_rules_daily", "team_id", "rule_id || '/' || rule_title || '/' || severity",
                   "day", "(total_occurrences * 1000 + unique_files_affected)::BIGINT", "a"),
    _ROLLUP.format("repo_health_daily", "repo_id", "repo_name", "day",
                   "(total_findings * 1000 + total_scans)::BIGINT", "b"),
    _ROLLUP.format("team_leaderboard_weekly", "team_id", "NULL", "week",
                   "(total_findings * 1000 + scans_performed)::BIGINT", "c"),
    _ROLLUP.format("vulnerability_trend_hourly", "NULL", "NULL", "hour",
                   "(findings * 1000 + scans)::BIGINT", "d")]))
def _(spark, sf):
    """Written whole, refreshed for some days around the end of a month, and read back."""
    found, scans = v.findings(spark, sf), v.scans(spark, sf)
    path = f"{shared_dir(spark).rstrip('/')}/rollups/{uuid.uuid4().hex}"
    refresh_rollups(found, scans, AS_OF, path)
    refresh_rollups(found, scans, AS_OF, path, date(1998, 6, 29), date(1998, 7, 1))
    none = F.lit(None).cast("string")
    item = {"top_rules_daily": F.concat_ws("/", "rule_id", "rule_title", "severity"),
            "repo_health_daily": F.col("repo_name")}
    shape = {"top_rules_daily": ("team_id", "day", "total_occurrences", "unique_files_affected"),
             "repo_health_daily": ("repo_id", "day", "total_findings", "total_scans"),
             "team_leaderboard_weekly": ("team_id", "week", "total_findings", "scans_performed"),
             "vulnerability_trend_hourly": (none, "hour", "findings", "scans")}
    parts = []
    for name, df in read_rollups(spark, path).items():
        owner, period, total, count = shape[name]
        parts.append(df.select(
            F.lit(name).alias("rollup"), "org_id",
            (F.col(owner) if isinstance(owner, str) else owner).alias("owner"),
            item.get(name, none).alias("item"), F.col(period).alias("period"),
            (F.col(total) * 1000 + F.col(count)).cast("bigint").alias("n")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@add("org_rollup", f"""{_SCANS} SELECT org_id, count(*) AS scans,
  sum(total_findings)::BIGINT AS findings, round(avg(ai_ratio::DOUBLE), 6) AS avg_ai_ratio
FROM scans WHERE {after(30)} GROUP BY 1""")
def _(spark, sf):
    return with_r6(an.org_rollup(v.scans(spark, sf), AS_OF), "avg_ai_ratio")


@add("security_score", f"""{_SCANS}, t AS (SELECT repo_name, ts::DATE AS day,
  sum(critical_count)::BIGINT AS c, sum(high_count)::BIGINT AS h FROM scans GROUP BY 1, 2)
SELECT repo_name, day, CASE WHEN c + h = 0 THEN 100 ELSE greatest(0, 100 - (c * 10 + h * 3)) END
  AS security_score FROM t""")
def _(spark, sf):
    days = v.scans(spark, sf).groupBy("repo_name", F.to_date("timestamp").alias("day"))
    sums = days.agg(F.sum("critical_count").alias("c"), F.sum("high_count").alias("h"))
    return sums.select("repo_name", "day", security_score(F.col("c"), F.col("h")).alias("security_score"))


# Team views ----------------------------------------------------------------------------------

_TEAM = """SELECT coalesce(team_id, 'Unassigned') AS team, sum(total_findings)::BIGINT AS total,
  sum(critical_count)::BIGINT AS critical, sum(high_count)::BIGINT AS high,
  sum(medium_count)::BIGINT AS medium, sum(low_count)::BIGINT AS low, count(*) AS scans,
  sum(ai_estimated_count)::BIGINT AS ai_estimated FROM scans GROUP BY 1"""


@add("team_heatmap", f"""{_SCANS}, t AS ({_TEAM}) SELECT * EXCLUDE (ai_estimated),
  CASE WHEN critical > 0 THEN 'critical' WHEN high > 5 THEN 'high' WHEN total > 0 THEN 'medium'
       ELSE 'none' END AS heat,
  round(total / greatest(max(total) OVER (), 1) * 100, 6) AS width_pct FROM t""")
def _(spark, sf):
    return with_r6(an.team_heatmap(v.scans(spark, sf)), "width_pct")


@add("team_comparison", f"""{_SCANS}, t AS ({_TEAM}) SELECT * EXCLUDE (medium, low),
  {exact('total::DOUBLE / scans', 1, 'up')} AS avg_findings FROM t ORDER BY total DESC, team LIMIT 8""")
def _(spark, sf):
    return an.team_comparison(v.scans(spark, sf))


@add("filter_values", f"""{_SCANS} SELECT DISTINCT 'org' AS field, org_id AS value FROM scans
WHERE org_id <> '' UNION SELECT 'team', team_id FROM scans WHERE team_id <> ''
UNION SELECT 'repo', repo_name FROM scans WHERE repo_name <> ''""")
def _(spark, sf):
    return an.filter_values(v.scans(spark, sf))


@add("list_scans", f"""{_SCANS} SELECT scan_id, org_id, team_id, repo_id, repo_name, branch,
  commit_sha, ts AS scanned_at, total_findings, critical_count AS critical, high_count AS high,
  medium_count AS medium, low_count AS low, info_count AS info, ai_estimated_count
FROM scans WHERE org_id = '{ORG}' AND branch = 'F' ORDER BY ts DESC, scan_id LIMIT 200 OFFSET 50""")
def _(spark, sf):
    return an.list_scans(v.scans(spark, sf), 200, 50, org_id=ORG, branch="F")


# Filters, joins, small functions -------------------------------------------------------------

@add("scoped", f"""{_SCANS} SELECT scan_id, org_id, repo_id, branch FROM scans
WHERE org_id = '{ORG}' AND branch = 'O' AND repo_id = 'NATION_2'""")
def _(spark, sf):
    return an.scoped(v.scans(spark, sf), org_id=ORG, team_id=None, branch="O",
                     repo_id="NATION_2").select("scan_id", "org_id", "repo_id", "branch")


@add("window_days", f"""{_SCANS} SELECT scan_id, ts AS scanned_at FROM scans
WHERE {after(200)} AND {after(20, '<=')}""")
def _(spark, sf):
    rows = an.window_days(v.scans(spark, sf), AS_OF, 200, 20)
    return rows.select("scan_id", F.col("timestamp").alias("scanned_at"))


@add("findings_join_scans", f"""{_BOTH} SELECT org_id, severity, count(*) AS findings FROM {_JOIN}
GROUP BY 1, 2""")
def _(spark, sf):
    scans = v.scans(spark, sf).select("scan_id", "org_id")
    return v.findings(spark, sf).join(scans, "scan_id").groupBy("org_id", "severity").agg(
        F.count("*").alias("findings"))


@add("scans_left_findings", f"""{_BOTH} SELECT s.scan_id, count(f.scan_id) AS findings
FROM scans s LEFT JOIN findings f ON s.scan_id = f.scan_id GROUP BY 1""")
def _(spark, sf):
    counts = v.findings(spark, sf).groupBy("scan_id").agg(F.count("*").alias("findings"))
    return v.scans(spark, sf).select("scan_id").join(counts, "scan_id", "left").fillna(0)


@add("orphans", f"""{_BOTH} SELECT scan_id, rule_id, line_number FROM findings
WHERE scan_id NOT IN (SELECT scan_id FROM scans WHERE branch = 'P')""")
def _(spark, sf):
    scans = v.scans(spark, sf).where("branch = 'P'")
    return an.orphans(v.findings(spark, sf), scans).select("scan_id", "rule_id", "line_number")


@add("cascade_delete", f"""{_BOTH} SELECT 'findings' AS kept, scan_id, line_number FROM findings
WHERE scan_id NOT IN (SELECT scan_id FROM scans WHERE branch = 'F')
UNION ALL SELECT 'scans', scan_id, NULL FROM scans WHERE branch <> 'F'""")
def _(spark, sf):
    scans = v.scans(spark, sf)
    kept_f, kept_s = an.cascade_delete(v.findings(spark, sf), scans, scans.where("branch = 'F'"))
    return kept_f.select(F.lit("findings").alias("kept"), "scan_id", "line_number").unionAll(
        kept_s.select(F.lit("scans").alias("kept"), "scan_id", F.lit(None)))


@add("percent_change", f"""{_SCANS}, m AS (SELECT repo_name, date_trunc('month', ts)::TIMESTAMP AS
  month, sum(critical_count)::BIGINT AS cur FROM scans GROUP BY 1, 2),
p AS (SELECT *, coalesce(lag(cur) OVER (PARTITION BY repo_name ORDER BY month), 0) AS prev FROM m)
SELECT repo_name, month, {change('cur', 'prev')} AS change_pct FROM p""")
def _(spark, sf):
    from pyspark.sql import Window
    monthly = v.scans(spark, sf).groupBy(
        "repo_name", F.date_trunc("month", "timestamp").alias("month")).agg(
        F.sum("critical_count").alias("cur"))
    prev = F.coalesce(F.lag("cur").over(Window.partitionBy("repo_name").orderBy("month")), F.lit(0))
    return monthly.withColumn("prev", prev).select(
        "repo_name", "month", percent_change(F.col("cur"), F.col("prev")).alias("change_pct"))


@add("min_severity", f"""WITH {v.WITH_FINDINGS} SELECT scan_id, rule_id, severity,
  {rank('severity')} AS rank FROM findings WHERE {rank('severity')} >= 4""")
def _(spark, sf):
    from riskloom.functions.severity import rank as rank_of
    loud = min_severity(v.findings(spark, sf), "high")
    return loud.select("scan_id", "rule_id", "severity", rank_of("severity").alias("rank"))


_URL = """CASE c_custkey % 4 WHEN 0 THEN 'https://github.com/' || c_mktsegment || '/' || c_name || '.git'
 WHEN 1 THEN 'git@gitlab.example.org:' || c_mktsegment || '/' || c_name || '.git'
 WHEN 2 THEN 'http://host/' || c_name ELSE '/local/' || c_name END"""


@add("repo_id", f"""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0
  THEN 'github.com/' || c_mktsegment || '/' || c_name
  WHEN c_custkey % 4 = 1 THEN 'gitlab.example.org/' || c_mktsegment || '/' || c_name
  WHEN c_custkey % 4 = 2 THEN 'host/' || c_name ELSE '/local/' || c_name END AS repo FROM customer""")
def _(spark, sf):
    rows = v.load(spark, sf, "customer").select("c_custkey", F.expr(_URL).alias("url"))
    return rows.select("c_custkey", tx.repo_id("url").alias("repo"))


@add("null_if_blank", f"""WITH {v.WITH_FINDINGS} SELECT scan_id, line_number,
  nullif(trim(owasp_category), '') AS owasp FROM findings""")
def _(spark, sf):
    padded = F.concat(F.lit(" \t"), "owasp_category", F.lit(" "))
    return v.findings(spark, sf).select("scan_id", "line_number",
                                        tx.null_if_blank(padded).alias("owasp"))


@add("mode_rule", f"""WITH {v.WITH_FINDINGS}, c AS (SELECT scan_id, rule_id, count(*) AS n
  FROM findings GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, rule_id DESC) AS a,
  row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, rule_id) AS b FROM c)
SELECT x.scan_id, x.rule_id AS largest, y.rule_id AS smallest, x.n FROM r x
JOIN r y ON x.scan_id = y.scan_id WHERE x.a = 1 AND y.b = 1""")
def _(spark, sf):
    rows = v.findings(spark, sf)
    large = fd.mode_rule(rows, "largest", "rule_id", ("scan_id",))
    small = fd.mode_rule(rows, "smallest", "rule_id", ("scan_id",)).drop("n")
    return large.withColumnRenamed("top_rule", "largest").join(
        small.withColumnRenamed("top_rule", "smallest"), "scan_id").select(
        "scan_id", "largest", "smallest", "n")
