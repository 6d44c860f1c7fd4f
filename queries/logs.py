"""Queries over the history log and over probe samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import views as v
from queries.dashboards import with_r6
from queries.sqlparts import change, exact
from riskloom.functions.numbers import f32
from riskloom.operators import history as hs
from riskloom.operators import statistics as st
from riskloom.operators.ingest import history_to_scans
from riskloom.sinks.tables import history_lines
from riskloom.sources.history import parse_history

QUERIES: dict = {}
SQL: dict = {}

# One log line per scan; a few lines are broken on purpose, a few targets need escaping.
LOG = f"""
SELECT CAST(epoch_s AS STRING)
  || '|' || CASE WHEN k % 9 = 0 THEN 'repo%7Capi%252F' ELSE '' END || target
  || '|' || CAST(total_findings AS STRING) || '|' || CAST(critical_count AS STRING)
  || '|' || CAST(high_count AS STRING) || '|' || CAST(medium_count AS STRING)
  || '|' || CAST(low_count AS STRING)
  || '|' || CASE WHEN k % 101 = 0 THEN 'x' ELSE CAST(info_count AS STRING) END
  || '|' || CAST(ai_estimated_count AS STRING)
  || CASE WHEN k % 103 = 0 THEN '' WHEN k % 7 = 0 THEN '|-' ELSE '|RULE-' || CAST(k % 11 AS STRING) END
  AS value
FROM (SELECT CAST(scan_id AS BIGINT) AS k, EPOCH AS epoch_s, coalesce(repo_id, '') AS target,
        total_findings, critical_count, high_count, medium_count, low_count, info_count,
        ai_estimated_count FROM ({v.SCANS.strip()}) s0) s1
"""
_SPARK_LOG = LOG.replace("EPOCH AS", "unix_seconds(CAST(ts AS TIMESTAMP)) AS")
_SQL_LOG = v.strip_braces(LOG.replace("EPOCH AS", "epoch(ts)::BIGINT AS"))
AS_OF, DAYS = 996_624_000, 365  # 2001-08-01 UTC
_NUMBERS = ["total", "critical", "high", "medium", "low", "info", "ai_estimated"]

_HISTORY = f"""log AS ({_SQL_LOG}),
parts AS (SELECT string_split(value, '|') AS p FROM log),
history AS (SELECT try_cast(p[1] AS BIGINT) AS timestamp,
  replace(regexp_replace(p[2], '%7C', '|', 'gi'), '%25', '%') AS target,
  {', '.join(f'try_cast(p[{i + 3}] AS BIGINT) AS {n}' for i, n in enumerate(_NUMBERS))},
  replace(regexp_replace(p[10], '%7C', '|', 'gi'), '%25', '%') AS top_rule
  FROM parts WHERE len(p) = 10 AND try_cast(p[8] AS BIGINT) IS NOT NULL)"""
_H = f"WITH {_HISTORY}"
_CUR = f"timestamp >= {AS_OF - DAYS * 86400}"
_PREV = f"timestamp >= {AS_OF - 2 * DAYS * 86400} AND timestamp < {AS_OF - DAYS * 86400}"


def history(spark, sf):
    return parse_history(v.view(spark, sf, _SPARK_LOG, dealt=True))


def recent(spark, sf):
    return hs.history_window(history(spark, sf), AS_OF, DAYS)


def _sums(cond: str = "true", prefix: str = "") -> str:
    names = ["findings", *_NUMBERS[1:]]
    cols = ["total", *_NUMBERS[1:]]
    return f"count(*) FILTER (WHERE {cond}) AS {prefix}scans, " + ", ".join(
        f"coalesce(sum({c}) FILTER (WHERE {cond}), 0)::BIGINT AS {prefix}{n}"
        for n, c in zip(names, cols))


def _ratio4(ai: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN {exact(f'{ai}::DOUBLE / {n}', 4, 'up')} ELSE 0.0::DOUBLE END"


def _mean2(n: str = "findings", scans: str = "scans") -> str:
    return f"CASE WHEN {scans} > 0 THEN {exact(f'{n}::DOUBLE / {scans}', 2, 'up')} ELSE 0.0::DOUBLE END"


QUERIES["read_history"] = history
SQL["read_history"] = f"{_H} SELECT * FROM history"

QUERIES["history_window"] = lambda s, sf: hs.history_range(
    history(s, sf), AS_OF - 2 * DAYS * 86400, AS_OF - DAYS * 86400).select("timestamp", "target")
SQL["history_window"] = f"{_H} SELECT timestamp, target FROM history WHERE {_PREV}"

QUERIES["history_stats"] = lambda s, sf: hs.history_stats(recent(s, sf))
SQL["history_stats"] = f"{_H} SELECT {_sums()} FROM history WHERE {_CUR}"

QUERIES["history_rule_counts"] = lambda s, sf: hs.history_rule_counts(recent(s, sf))
SQL["history_rule_counts"] = f"""{_H} SELECT top_rule AS rule, count(*) AS count FROM history
WHERE {_CUR} AND top_rule NOT IN ('', '-') GROUP BY 1"""

QUERIES["history_summary"] = lambda s, sf: hs.history_summary(recent(s, sf))
SQL["history_summary"] = f"""{_H}, a AS (SELECT {_sums()} FROM history WHERE {_CUR})
SELECT *, critical + high AS high_or_above, {_ratio4('ai_estimated', 'findings')} AS ai_ratio,
  {_mean2()} AS avg_findings_per_scan FROM a"""

QUERIES["history_series"] = lambda s, sf: hs.history_series(recent(s, sf))
SQL["history_series"] = f"""{_H}, a AS (SELECT strftime(make_timestamp(timestamp * 1000000),
  '%Y-%m-%d') AS day, {_sums()} FROM history WHERE {_CUR} GROUP BY 1)
SELECT *, critical + high AS high_or_above, {_ratio4('ai_estimated', 'findings')} AS ai_ratio FROM a"""

QUERIES["history_top_rules"] = lambda s, sf: hs.history_top_rules(history(s, sf), 7)
SQL["history_top_rules"] = f"""{_H} SELECT top_rule AS rule, count(*) AS count FROM history
WHERE top_rule NOT IN ('', '-') GROUP BY 1 ORDER BY count DESC, rule LIMIT 7"""

QUERIES["history_top_targets"] = lambda s, sf: hs.history_top_targets(history(s, sf), 12)
SQL["history_top_targets"] = f"""{_H} SELECT CASE WHEN target = '' THEN '.' ELSE target END AS target,
  sum(total)::BIGINT AS findings, count(*) AS scans, sum(critical)::BIGINT AS critical,
  sum(high)::BIGINT AS high FROM history GROUP BY 1 ORDER BY findings DESC, 1 LIMIT 12"""

QUERIES["history_dashboard"] = lambda s, sf: hs.history_dashboard(history(s, sf), AS_OF, DAYS)
SQL["history_dashboard"] = f"""{_H}, a AS (SELECT {_sums(_CUR)}, {_sums(_PREV, 'p_')},
  count(*) AS total_scans_available,
  count(DISTINCT CASE WHEN {_CUR} THEN timestamp // 86400 END) AS days_with_activity FROM history),
b AS (SELECT *, critical + high AS high_or_above, p_critical + p_high AS p_hoa,
  {_ratio4('ai_estimated', 'findings')} AS ai_ratio,
  {_ratio4('p_ai_estimated', 'p_findings')} AS p_ratio FROM a)
SELECT scans, findings, critical, high, medium, low, info, ai_estimated, high_or_above, ai_ratio,
  {_mean2()} AS avg_findings_per_scan, {change('scans', 'p_scans')} AS scans_delta_pct,
  {change('findings', 'p_findings')} AS findings_delta_pct,
  {change('critical', 'p_critical')} AS critical_delta_pct,
  {change('high_or_above', 'p_hoa')} AS high_or_above_delta_pct,
  {change('(ai_ratio * 100)', '(p_ratio * 100)')} AS ai_ratio_delta_pct,
  p_scans AS previous_window_scans, p_findings AS previous_window_findings,
  total_scans_available, days_with_activity FROM b"""

QUERIES["write_history"] = lambda s, sf: history_lines(history(s, sf))
SQL["write_history"] = f"""{_H} SELECT timestamp::VARCHAR || '|'
  || replace(replace(target, '%', '%25'), '|', '%7C') || '|'
  || concat_ws('|', total, critical, high, medium, low, info, ai_estimated) || '|'
  || CASE WHEN top_rule = '' THEN '-' ELSE replace(replace(top_rule, '%', '%25'), '|', '%7C') END
  AS value FROM history"""

QUERIES["history_to_scans"] = lambda s, sf: history_to_scans(history(s, sf), "acme").withColumns({
    "timestamp": F.col("timestamp").cast("timestamp_ntz"),
    "ai_ratio": F.round(F.col("ai_ratio").cast("double"), 6)})
SQL["history_to_scans"] = f"""{_H} SELECT sha256(timestamp::VARCHAR || '|' || target) AS scan_id,
  make_timestamp(timestamp * 1000000) AS timestamp, 'acme' AS org_id, NULL::VARCHAR AS team_id,
  target AS target_path, total::INT AS total_findings, critical::INT AS critical_count,
  high::INT AS high_count, medium::INT AS medium_count, low::INT AS low_count,
  info::INT AS info_count, ai_estimated::INT AS ai_estimated_count, 0 AS scan_duration_ms,
  0 AS files_scanned, 0 AS rules_loaded, round((CASE WHEN total > 0 THEN
  (ai_estimated::REAL / total::REAL)::REAL ELSE 0::REAL END)::DOUBLE, 6) AS ai_ratio FROM history"""

# A scan's findings become one record.
QUERIES["to_history"] = lambda s, sf: hs.to_history(
    v.findings(s, sf).withColumn("ai_confidence", F.col("ai_confidence") * f32(100.0)),
    ("scan_id",), "rule_id")
SQL["to_history"] = f"""WITH {v.WITH_FINDINGS}, r AS (SELECT scan_id, rule_id, count(*) AS n
  FROM findings GROUP BY 1, 2),
t AS (SELECT scan_id, rule_id, row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, rule_id DESC)
  AS i FROM r)
SELECT f.scan_id, count(*) AS total, {', '.join(f"count(*) FILTER (WHERE severity = '{x}') AS {x}"
  for x in ('critical', 'high', 'medium', 'low', 'info'))},
  count(*) FILTER (WHERE ai_confidence * 100::REAL >= 70) AS ai_estimated, any_value(t.rule_id) AS top_rule
FROM findings f JOIN t ON f.scan_id = t.scan_id AND t.i = 1 GROUP BY 1"""

# Probe samples -------------------------------------------------------------------------------

PROBES = """
SELECT CAST(event_id AS INT) AS iteration,
  CASE event_type WHEN 'view' THEN 'summary' WHEN 'click' THEN 'compliance-gaps'
    WHEN 'purchase' THEN 'ai-metrics' WHEN 'signup' THEN 'health' ELSE 'summary' END AS endpoint,
  CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 3 = 0 THEN '000' WHEN user_id % 3 = 1
    THEN '503' ELSE '404' END ELSE '200' END AS code,
  value AS latency_ms, CAST(user_id AS DOUBLE) AS total_findings,
  CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN CAST(user_id % 100 AS DOUBLE) END
    AS coverage_pct
FROM {events}
"""
_PROBES = f"WITH samples AS ({v.strip_braces(PROBES)})"
_FAILED = "code = '000' OR code::INT >= 400"


def probes(spark, sf):
    return v.view(spark, sf, PROBES)


QUERIES["sample_stats"] = lambda s, sf: with_r6(
    st.sample_stats(v.load(s, sf, "events"), "value", ("event_type",)), "mean", "stddev", "median",
    "p95")
SQL["sample_stats"] = """SELECT event_type, min(value) AS min, max(value) AS max,
  round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev,
  round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95
FROM events GROUP BY 1"""

QUERIES["sample_stats_all"] = lambda s, sf: with_r6(
    st.sample_stats(v.load(s, sf, "lineitem"), "l_extendedprice"), "mean", "stddev", "median",
    "p95")
SQL["sample_stats_all"] = """SELECT min(l_extendedprice) AS min, max(l_extendedprice) AS max,
  round(avg(l_extendedprice), 6) AS mean, round(stddev_pop(l_extendedprice), 6) AS stddev,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
  round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem"""

QUERIES["nearest_rank"] = lambda s, sf: st.nearest_rank(
    v.load(s, sf, "orders"), "o_totalprice", 0.95, ("o_orderpriority",), "p95")
SQL["nearest_rank"] = """SELECT o_orderpriority, quantile_disc(o_totalprice, 0.95) AS p95
FROM orders GROUP BY 1"""

QUERIES["endpoint_signal"] = lambda s, sf: with_r6(st.endpoint_signal(probes(s, sf)),
                                                   "coverage_avg")
SQL["endpoint_signal"] = f"""{_PROBES}, good AS (SELECT endpoint, latency_ms,
  row_number() OVER (PARTITION BY endpoint ORDER BY latency_ms) AS i,
  count(*) OVER (PARTITION BY endpoint) AS n FROM samples WHERE code = '200'),
lat AS (SELECT endpoint,
  max(latency_ms) FILTER (WHERE i = least(greatest(floor(0.5::DOUBLE * n + 0.999999::DOUBLE), 1), n)) AS p50_ms,
  max(latency_ms) FILTER (WHERE i = least(greatest(floor(0.95::DOUBLE * n + 0.999999::DOUBLE), 1), n)) AS p95_ms
  FROM good GROUP BY 1),
a AS (SELECT endpoint, count(*) AS requests, count(*) FILTER (WHERE {_FAILED}) AS failures,
  min(coverage_pct) AS coverage_min, round(avg(coverage_pct), 6) AS coverage_avg FROM samples GROUP BY 1)
SELECT a.*, coalesce(p50_ms, 0) AS p50_ms, coalesce(p95_ms, 0) AS p95_ms,
  round(failures::DOUBLE / requests * 100, 2) AS error_pct FROM a LEFT JOIN lat USING (endpoint)"""

_GATES = {"max_error_rate_pct": 1.0, "max_summary_p95_ms": 50.0, "max_compliance_p95_ms": 500.0,
          "min_coverage_pct": 70.0}
QUERIES["evaluate_gates"] = lambda s, sf: st.evaluate_gates(st.probe_metrics(probes(s, sf)),
                                                            **_GATES)
SQL["evaluate_gates"] = f"""{_PROBES}, m AS (SELECT
  count(*) FILTER (WHERE {_FAILED})::DOUBLE / count(*) * 100 AS er,
  quantile_cont(latency_ms, 0.95) FILTER (WHERE code = '200' AND endpoint = 'summary') AS sp,
  quantile_cont(latency_ms, 0.95) FILTER (WHERE code = '200' AND endpoint = 'compliance-gaps') AS cp,
  min(coverage_pct) FILTER (WHERE endpoint = 'compliance-gaps') AS cov FROM samples),
x AS (SELECT unnest([
  CASE WHEN er > 1 THEN printf('error_rate_pct %.2f%% > max_error_rate_pct 1.00%%', er) END,
  CASE WHEN sp > 50 THEN printf('summary_p95_ms %.3f > max_summary_p95_ms 50.000', sp) END,
  CASE WHEN cp > 500 THEN printf('compliance_p95_ms %.3f > max_compliance_p95_ms 500.000', cp) END,
  CASE WHEN cov < 70 THEN printf('coverage_pct %.2f%% < min_coverage_pct 70.00%%', cov) END])
  AS violation FROM m)
SELECT violation FROM x WHERE violation IS NOT NULL"""
