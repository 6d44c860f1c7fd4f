"""Queries that select, deduplicate, compare and repair findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import views as v
from queries.rulebook import CODE_RULES, rules
from queries.scanning import CODE, code_findings, dedup_sql, norm_sql, route_parts, score
from queries.sqlparts import (
    hits_cte, lines_cte, lower, rank, score1, scored_cte, severity_counts, trim)
from riskloom.operators import findings as fd
from riskloom.operators import matching as mt
from riskloom.operators import remediation as rm
from riskloom.operators.compliance import BY_CATEGORY, BY_SEGMENT, BY_TAG, enrich_compliance
from riskloom.operators.routes import unguarded_routes
from riskloom.operators.searchindex import indexed_search, write_searchable
from riskloom.session import scratch

QUERIES: dict = {}
SQL: dict = {}
_SCANNER = f"""WITH {v.WITH_SCANNER}, s AS (SELECT * RENAME (id AS rule_id, col_no AS "column")
  FROM scanner)"""


# Filters -------------------------------------------------------------------------------------

QUERIES["apply_profile"] = lambda spark, sf: fd.apply_profile(
    mt.match_rules(v.code_corpus(spark, sf), rules(spark, CODE_RULES)), "pragmatic").select(
    F.col("id").alias("rule_id"), "path", "line")
SQL["apply_profile"] = f"""{hits_cte(CODE, CODE_RULES)} SELECT rid AS rule_id, path, line FROM hits
WHERE prior >= 0.5::REAL AND {rank('severity')} >= 4"""

QUERIES["at_location"] = lambda spark, sf: fd.at_location(
    v.scanner_findings(spark, sf), "src/Mod_5.py:3").select("file", "line", "column", "id")
SQL["at_location"] = f"""{_SCANNER} SELECT file, line, "column", rule_id AS id FROM s
WHERE file = 'src/Mod_5.py' AND line = 3"""

QUERIES["search"] = lambda spark, sf: fd.search(
    v.scanner_findings(spark, sf), "brand#1 MOD_9 critical :2:").select("id", "file", "line", "column")
SQL["search"] = f"""{_SCANNER}, h AS (SELECT *, lower(concat_ws(' ', rule_id, title, file,
  file || ':' || line || ':' || "column", severity)) AS text FROM s)
SELECT rule_id AS id, file, line, "column" FROM h WHERE contains(text, 'brand#1')
  AND contains(text, 'mod_9') AND contains(text, 'critical') AND contains(text, ':2:')"""

def _indexed(spark, sf) -> DataFrame:
    """The same words over stored findings, through their trigram index."""
    folder = scratch(spark)
    write_searchable(v.scanner_findings(spark, sf).drop("tags_text"), folder, 24)
    return indexed_search(spark, folder, "brand#1 MOD_9 critical :2:").select(
        "id", "file", "line", "column")


QUERIES["indexed_search"] = _indexed
SQL["indexed_search"] = SQL["search"]

# Dedup and picks -----------------------------------------------------------------------------


def _dedup(spark, sf) -> DataFrame:
    out = fd.dedup_findings(v.scanner_findings(spark, sf))
    return out.select("file", "line", "column", "category", "snippet", "severity",
                      F.col("id").alias("rule_id"), score("risk_score"), score("ai_confidence"))


QUERIES["dedup_findings"] = _dedup
SQL["dedup_findings"] = f"""{_SCANNER} SELECT file, line, "column", category, snippet, severity,
  rule_id, {score1('risk_score')} AS risk_score, {score1('ai_confidence')} AS ai_confidence
FROM ({dedup_sql('s')})"""

QUERIES["unique_findings"] = lambda spark, sf: mt.unique_findings(
    v.scanner_findings(spark, sf)).select("id", "file", "line", "column", "title")
SQL["unique_findings"] = f"""{_SCANNER} SELECT rule_id AS id, file, line, "column", title FROM (
  SELECT *, row_number() OVER (PARTITION BY rule_id, file, line ORDER BY "column", title) AS k FROM s)
WHERE k = 1"""

QUERIES["review_comments"] = lambda spark, sf: fd.review_comments(
    v.scanner_findings(spark, sf), "high", 25).select("file", "line", "severity", "id", "snippet")
SQL["review_comments"] = f"""{_SCANNER} SELECT file, line, severity, rule_id AS id, snippet FROM (
  SELECT *, row_number() OVER (PARTITION BY file, line ORDER BY {rank('severity')} DESC, rule_id,
  snippet) AS k FROM s WHERE {rank('severity')} >= 4) WHERE k = 1 ORDER BY file, line LIMIT 25"""

QUERIES["cap_findings"] = lambda spark, sf: fd.cap_findings(
    v.scanner_findings(spark, sf), 500).select("severity", score("risk_score"), "file", "line",
                                               "column", "id", "dropped")
SQL["cap_findings"] = f"""{_SCANNER} SELECT severity, {score1('risk_score')} AS risk_score, file, line,
  "column", rule_id AS id, (SELECT count(*) - 500 FROM s) AS dropped FROM s
ORDER BY {rank('severity')} DESC, s.risk_score DESC, file, line, "column", rule_id LIMIT 500"""

QUERIES["order_findings"] = lambda spark, sf: mt.order_findings(
    v.scanner_findings(spark, sf)).select(
    "id", "severity", "file", "line", "column", score("risk_score"))
SQL["order_findings"] = f"""{_SCANNER} SELECT rule_id AS id, severity, file, line, "column",
  {score1('risk_score')} AS risk_score FROM s
ORDER BY s.risk_score DESC, {rank('severity')} DESC, file, line, "column", rule_id"""

QUERIES["dedup_summary"] = lambda spark, sf: fd.dedup_summary(
    v.scanner_findings(spark, sf), fd.dedup_findings(v.scanner_findings(spark, sf)))
SQL["dedup_summary"] = f"""{_SCANNER} SELECT (SELECT count(*) FROM s) AS original_total,
  (SELECT count(*) FROM ({dedup_sql('s')})) AS deduped_total, 'normalized' AS dedup_mode"""

QUERIES["should_fail"] = lambda spark, sf: fd.should_fail(v.scanner_findings(spark, sf))
SQL["should_fail"] = f"{_SCANNER} SELECT count(*) > 0 AS fail FROM s"

QUERIES["review_summary"] = lambda spark, sf: fd.review_summary(v.scanner_findings(spark, sf))
SQL["review_summary"] = f"""{_SCANNER} SELECT count(*) AS total, {severity_counts()},
  floor(avg(ai_confidence::DOUBLE) * 10 + 0.5) / 10 AS avg_ai_confidence,
  count(*) FILTER (WHERE ai_confidence >= 70) AS ai_estimated,
  (count(*) FILTER (WHERE ai_confidence >= 70) * 100 // count(*))::BIGINT AS ai_generated_pct FROM s"""

# Baselines -----------------------------------------------------------------------------------


def _baseline(spark, sf) -> DataFrame:
    return v.scanner_findings(spark, sf).where("flag = 'R' AND tax > 0.05").select(
        F.upper("file").alias("file"), "line", "category")


_BASE = f"""b AS (SELECT DISTINCT {lower('file')} AS bf, line AS bl,
  lower(coalesce(category, 'uncategorized')) AS bc FROM s WHERE flag = 'R' AND tax > 0.05::DOUBLE),
k AS (SELECT *, EXISTS (SELECT 1 FROM b WHERE bf = {lower('file')} AND bl = line
  AND bc = lower(coalesce(category, 'uncategorized'))) AS known FROM s)"""
_PLACE = ["id", "file", "line", "column", "category"]

QUERIES["minus_baseline"] = lambda spark, sf: fd.minus_baseline(
    v.scanner_findings(spark, sf), _baseline(spark, sf)).select(*_PLACE)
SQL["minus_baseline"] = f"""{_SCANNER}, {_BASE} SELECT rule_id AS id, file, line, "column", category
FROM k WHERE NOT known"""

QUERIES["in_baseline"] = lambda spark, sf: fd.in_baseline(
    v.scanner_findings(spark, sf), _baseline(spark, sf)).select(*_PLACE)
SQL["in_baseline"] = f"""{_SCANNER}, {_BASE} SELECT rule_id AS id, file, line, "column", category
FROM k WHERE known"""

# Union and enrichment ------------------------------------------------------------------------


def _union(spark, sf) -> DataFrame:
    corpus = v.code_corpus(spark, sf)
    hits = mt.scored_findings(corpus, rules(spark, CODE_RULES))
    routes = unguarded_routes(corpus, "ACME-")
    both = fd.union_findings(hits.select(*routes.columns), routes)
    return both.groupBy("category", F.col("id").startswith("ACME-").alias("route")).agg(
        F.count("*").alias("n"))


QUERIES["union_findings"] = _union
SQL["union_findings"] = f"""{hits_cte(CODE, CODE_RULES)}, {route_parts()},
u AS (SELECT category, false AS route FROM hits UNION ALL SELECT 'auth', true FROM routes)
SELECT category, route, count(*) AS n FROM u GROUP BY 1, 2"""

def _case(which: int, on: str, table: dict) -> str:
    return f"CASE {on} " + " ".join(f"WHEN '{k}' THEN '{x[which]}'" for k, x in table.items()) + " END"


def _enriched(which: int, given: str) -> str:
    seg = "CASE " + " ".join(f"WHEN contains(upper(long_id), '{p}') THEN '{x[which]}'"
                             for p, x in BY_SEGMENT) + " END"
    tags = (f"list_filter(list_transform(string_split(tags_text, ','), lambda t: "
            f"{_case(which, 'lower(trim(t))', BY_TAG)}), lambda x: x IS NOT NULL)[1]")
    return f"coalesce({given}, {tags}, {_case(which, 'lower(category)', BY_CATEGORY)}, {seg})"


QUERIES["enrich_compliance"] = lambda spark, sf: enrich_compliance(
    v.scanner_findings(spark, sf), "long_id").select(
    "long_id", "file", "line", "column", "cwe_id", "owasp_category")
SQL["enrich_compliance"] = f"""{_SCANNER} SELECT long_id, file, line, "column",
  {_enriched(0, 'cwe_id')} AS cwe_id, {_enriched(1, 'owasp_category')} AS owasp_category FROM s"""

# Remediation ---------------------------------------------------------------------------------

_FIXABLE = ", ".join(f"'{r}'" for r in rm.FIXES)

QUERIES["fix_candidates"] = lambda spark, sf: rm.fix_candidates(code_findings(spark, sf)).select(
    F.col("id").alias("rule_id"), "file", "line", "column")
SQL["fix_candidates"] = f"""{scored_cte(CODE, CODE_RULES)} SELECT rid AS rule_id, path AS file, line, "column" FROM (
  SELECT *, row_number() OVER (PARTITION BY path, rid ORDER BY rs DESC, line, "column") AS k
  FROM scored WHERE rid IN ({_FIXABLE})) WHERE k = 1"""


def _fixes(spark, sf) -> DataFrame:
    corpus = v.code_corpus(spark, sf)
    return rm.fix_files(corpus, rules(spark, CODE_RULES))


def _fold_sql() -> str:
    """The ordered replacements as nested replace calls, counting by removed bytes."""
    steps = [(r, a, b) for r in sorted(rm.FIXES) for a, b in rm.FIXES[r]
             if any(x["id"] == r for x in CODE_RULES)]
    esc = lambda x: x.replace("'", "''")
    ctes = [f"""f0 AS (SELECT path, any_value(content) AS t, list(DISTINCT rid) AS rs, 0::BIGINT AS n
  FROM (SELECT hits.path, rid, content FROM hits JOIN corpus ON hits.path = corpus.path
        WHERE rid IN ({_FIXABLE})) GROUP BY path)"""]
    for i, (r, a, b) in enumerate(steps):
        on = f"list_contains(rs, '{r}')"
        ctes.append(f"""f{i + 1} AS (SELECT path, rs, CASE WHEN {on} THEN replace(t, '{esc(a)}', '{esc(b)}')
  ELSE t END AS t, n + CASE WHEN {on} THEN (strlen(t) - strlen(replace(t, '{esc(a)}', '')))
  // {len(a)} ELSE 0 END AS n FROM f{i})""")
    return ",\n".join(ctes) + f", fixed AS (SELECT * FROM f{len(steps)})"


QUERIES["apply_fixes"] = lambda spark, sf: _fixes(spark, sf)
SQL["apply_fixes"] = f"""{hits_cte(CODE, CODE_RULES)}, {_fold_sql()}
SELECT path AS file, t AS fixed, n::BIGINT AS replacements FROM fixed WHERE n > 0"""

QUERIES["fix_totals"] = lambda spark, sf: rm.fix_totals(_fixes(spark, sf))
SQL["fix_totals"] = f"""{hits_cte(CODE, CODE_RULES)}, {_fold_sql()}
SELECT count(*) AS files, sum(n)::BIGINT AS replacements FROM fixed WHERE n > 0"""


def _preview(spark, sf) -> DataFrame:
    corpus = v.code_corpus(spark, sf)
    return rm.preview_files(corpus, rules(spark, CODE_RULES))


def _steps_sql() -> str:
    rows = [(r, i, a, b) for r in rm.FIXES for i, (a, b) in enumerate(rm.FIXES[r])]
    esc = lambda x: x.replace("'", "''")
    return "steps(sid, step, a, b) AS (VALUES " + ", ".join(
        f"('{r}', {i}, '{esc(a)}', '{esc(b)}')" for r, i, a, b in rows) + ")"


def _cut(x: str) -> str:
    return f"CASE WHEN strlen({x}) <= 110 THEN {x} ELSE substr({x}, 1, 107) || '...' END"


QUERIES["preview_fixes"] = _preview
SQL["preview_fixes"] = f"""{hits_cte(CODE, CODE_RULES)}, {_steps_sql()},
c AS (SELECT DISTINCT path, rid FROM hits),
p AS (SELECT c.path AS file, rid AS id, row_number() OVER (PARTITION BY c.path, rid
    ORDER BY step, line) AS shown, line, {_cut(trim('text'))} AS before,
    {_cut(trim('replace(text, a, b)'))} AS after
  FROM c JOIN steps ON rid = sid JOIN numbered ON c.path = numbered.path AND contains(text, a))
SELECT file, id, shown::INT AS shown, line::INT AS line, before, after FROM p WHERE shown <= 4"""


def _context(spark, sf) -> DataFrame:
    corpus = v.code_corpus(spark, sf)
    return rm.hits_in_context(corpus, rules(spark, CODE_RULES), 2)


_CTX = f"""{hits_cte(CODE, CODE_RULES)}, x AS (SELECT h.path AS file, h.rid AS rule_id, h.line,
  any_value(h.title) AS title, any_value(h.severity) AS severity, any_value(h.language) AS language,
  any_value(h.fix_suggestion) AS fix, string_agg(n.text, chr(10) ORDER BY n.line) AS context,
  greatest(h.line - 2, 1)::INT AS context_start
  FROM hits h JOIN numbered n ON h.path = n.path AND n.line BETWEEN h.line - 2 AND h.line + 2
  GROUP BY h.path, h.rid, h.line)"""

QUERIES["code_context"] = lambda spark, sf: _context(spark, sf).select(
    "file", F.col("id").alias("rule_id"), "line", "context", "context_start")
SQL["code_context"] = f"{_CTX} SELECT file, rule_id, line, context, context_start FROM x"

QUERIES["fix_prompts"] = lambda spark, sf: rm.fix_prompts(_context(spark, sf)).select(
    "file", F.col("id").alias("rule_id"), "line", "prompt")
SQL["fix_prompts"] = f"""{_CTX} SELECT file, rule_id, line,
  'Rule ' || rule_id || ' (' || title || ', ' || severity || ') reports line ' || line || ' of '
  || file || '.' || chr(10) || '```' || language || chr(10) || context || chr(10) || '```' || chr(10)
  || 'Advice: ' || coalesce(fix, 'choose the safest common practice') || chr(10)
  || 'Rewrite these lines so that the rule no longer applies and callers notice no change. '
  || 'Answer with the lines alone.' AS prompt FROM x"""

QUERIES["normalize_snippet"] = lambda spark, sf: code_findings(spark, sf).select(
    "file", "line", F.col("id").alias("rule_id"), _normalized().alias("normalized"))
SQL["normalize_snippet"] = f"""{hits_cte(CODE, CODE_RULES)} SELECT path AS file, line, rid AS rule_id,
  {norm_sql('snippet')} AS normalized FROM hits"""


def _normalized():
    from riskloom.functions.text import normalize_snippet
    return normalize_snippet("snippet")

