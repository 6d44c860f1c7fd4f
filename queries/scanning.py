"""Queries over corpora: rule matching, scoring, routes, dedup, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from queries import views as v
from queries.rulebook import CODE_RULES, PAGE_RULES, TEXT_RULES, rules
from queries import sqlparts as q
from queries.sqlparts import hits_cte, lines_cte, lower, rank, score1, scored_cte, severity_counts
from riskloom.functions import scoring as sc
from riskloom.functions import text as tx
from riskloom.functions import textsignals as ts
from riskloom.operators import findings as fd
from riskloom.operators import matching as mt
from riskloom.operators import routes as rt
from riskloom.plans.scan import ScanOptions, scan, scan_many, scan_summary
from riskloom.sources import corpus as cp

QUERIES: dict = {}
SQL: dict = {}
DOC, PAGE, CODE = (v.strip_braces(x) for x in (v.DOC_CORPUS, v.PAGE_CORPUS, v.CODE_CORPUS))


def score(name: str):
    return F.round(F.col(name).cast("double"), 1).alias(name)


def hit_rows(df: DataFrame) -> DataFrame:
    return df.select("path", F.col("id").alias("rule_id"), "severity", "line", "column", "snippet")


def code_findings(spark, sf) -> DataFrame:
    """Scored findings of the small source files."""
    return mt.scored_findings(v.code_corpus(spark, sf), rules(spark, CODE_RULES))


def flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("rule_id"), "title", "severity", "file", "line", "column",
                     "snippet", score("ai_confidence"), score("risk_score"), "category", "cwe_id",
                     "owasp_category", F.array_join("tags", ",").alias("tags"), "ai_tendency",
                     "fix_suggestion")


_HIT_COLS = 'path, rid AS rule_id, severity, line, "column", snippet'
FLAT_COLS = (f'rid AS rule_id, title, severity, path AS file, line, "column", snippet, '
              f"{score1('ai')} AS ai_confidence, {score1('rs')} AS risk_score, category, cwe_id, "
              "owasp_category, array_to_string(tags, ',') AS tags, ai_tendency, fix_suggestion")

QUERIES["match_rules"] = lambda spark, sf: hit_rows(
    mt.match_rules(v.doc_corpus(spark, sf), rules(spark, TEXT_RULES)))
SQL["match_rules"] = f"{hits_cte(DOC, TEXT_RULES)} SELECT {_HIT_COLS} FROM hits"

QUERIES["match_rules_pages"] = lambda spark, sf: hit_rows(
    mt.match_rules(v.page_corpus(spark, sf), rules(spark, PAGE_RULES)))
SQL["match_rules_pages"] = f"{hits_cte(PAGE, PAGE_RULES)} SELECT {_HIT_COLS} FROM hits"

QUERIES["match_rules_code"] = lambda spark, sf: hit_rows(
    mt.match_rules(v.code_corpus(spark, sf), rules(spark, CODE_RULES)))
SQL["match_rules_code"] = f"{hits_cte(CODE, CODE_RULES)} SELECT {_HIT_COLS} FROM hits"

QUERIES["scan_code"] = lambda spark, sf: flat(code_findings(spark, sf))
SQL["scan_code"] = f"{scored_cte(CODE, CODE_RULES)} SELECT {FLAT_COLS} FROM scored"

QUERIES["scan_documents"] = lambda spark, sf: flat(
    mt.scored_findings(v.doc_corpus(spark, sf), rules(spark, TEXT_RULES)))
SQL["scan_documents"] = f"{scored_cte(DOC, TEXT_RULES)} SELECT {FLAT_COLS} FROM scored"

QUERIES["summarize_findings"] = lambda spark, sf: fd.summarize_findings(code_findings(spark, sf))
SQL["summarize_findings"] = (f"{hits_cte(CODE, CODE_RULES)} SELECT count(*) AS total, "
                             f"{severity_counts()} FROM hits")


# Paths and lines -----------------------------------------------------------------------------

# Fixed values, stated here again so that the twin does not follow a wrong list of the library.
_LANG = """WHEN ext IN ('py') THEN 'python'
  WHEN ext IN ('js', 'jsx', 'ts', 'tsx', 'mjs', 'cjs') THEN 'javascript' WHEN ext = 'go' THEN 'go'
  WHEN ext = 'rs' THEN 'rust' WHEN ext = 'java' THEN 'java' WHEN ext = 'cs' THEN 'csharp'
  WHEN ext = 'rb' THEN 'ruby' WHEN ext IN ('php', 'phtml') THEN 'php' WHEN ext IN ('kt', 'kts') THEN 'kotlin'
  WHEN ext = 'swift' THEN 'swift' WHEN ext IN ('tf', 'hcl') THEN 'terraform'"""
_WORKFLOWS = [".github/workflows", ".github\\workflows"]
_CLUSTER = ["k8s", "kube", "kubernetes", "deployment", "daemonset", "statefulset", "service", "ingress",
            "pod", "cronjob", "helm", "manifest"]


def _paths(spark, sf) -> DataFrame:
    return v.view(spark, sf, v.PATHS).select("c_custkey", F.concat("head", "tail").alias("path"))


QUERIES["with_language"] = lambda spark, sf: cp.with_language(_paths(spark, sf))
SQL["with_language"] = f"""WITH p AS (SELECT c_custkey, head || tail AS path FROM
  ({v.strip_braces(v.PATHS)})),
n AS (SELECT *, {lower('path')} AS low, {lower("list_extract(string_split(path, '/'), -1)")} AS name FROM p),
e AS (SELECT *, regexp_extract(name, '^.+\\.([^.]*)$', 1) AS ext FROM n)
SELECT c_custkey, path, language FROM (SELECT c_custkey, path, CASE
  WHEN name = 'dockerfile' OR starts_with(name, 'dockerfile.') THEN 'dockerfile' {_LANG}
  WHEN ext IN ('yaml', 'yml') AND {q.any_in('low', _WORKFLOWS)} THEN 'github-actions'
  WHEN ext IN ('yaml', 'yml') AND {q.any_in('low', _CLUSTER)} THEN 'kubernetes' END AS language
  FROM e) WHERE language IS NOT NULL"""

QUERIES["relative_path"] = lambda spark, sf: cp.with_relative_path(
    _paths(spark, sf), "root/MACHINERY/").select("c_custkey", "file")
SQL["relative_path"] = f"""SELECT c_custkey, CASE WHEN head = 'root/MACHINERY/' THEN tail
  ELSE head || tail END AS file FROM ({v.strip_braces(v.PATHS)})"""

QUERIES["exclude_paths"] = lambda spark, sf: cp.exclude_paths(
    v.doc_corpus(spark, sf), ["SRC1/", "doc_7", ""]).select("path")
SQL["exclude_paths"] = f"""WITH c AS ({DOC}) SELECT path FROM c
WHERE NOT contains(lower(path), 'src1/') AND NOT contains(lower(path), 'doc_7')"""


def _changed(spark, sf) -> DataFrame:
    docs = v.view(spark, sf, v.DOC_CORPUS).withColumn(
        "doc_id", F.regexp_extract("path", "doc_([0-9]+)", 1).cast("bigint"))
    return docs.join(v.load(spark, sf, "labels").where("quality = 1"), "doc_id",
                     "left_semi").select("path")


QUERIES["only_changed"] = lambda spark, sf: cp.only_changed(
    v.doc_corpus(spark, sf), _changed(spark, sf), "src/src1").select("path")
SQL["only_changed"] = f"""WITH c AS ({DOC}) SELECT path FROM c WHERE path LIKE 'src/src1/%' AND
regexp_extract(path, 'doc_([0-9]+)', 1)::BIGINT IN (SELECT doc_id FROM labels WHERE quality = 1)"""

QUERIES["explode_lines"] = lambda spark, sf: cp.explode_lines(v.doc_corpus(spark, sf)).select(
    "path", "line", "text_lower")
SQL["explode_lines"] = f"""WITH {lines_cte(DOC)} SELECT path, line::INT AS line,
  low AS text_lower FROM numbered"""

# Rule subsets --------------------------------------------------------------------------------

QUERIES["rules_for"] = lambda spark, sf: mt.rules_for(v.part_rules(spark, sf), "Python").select("id")
SQL["rules_for"] = f"""WITH {v.WITH_RULES} SELECT id FROM rules
WHERE list_contains(languages, 'python')"""

QUERIES["filter_rules"] = lambda spark, sf: mt.filter_rules(
    v.part_rules(spark, sf), ["auth", "Economy"]).select("id")
SQL["filter_rules"] = f"""WITH {v.WITH_RULES} SELECT id FROM rules WHERE lower(category) = 'economy'
OR list_contains(list_transform(tags, lambda t: lower(t)), 'auth')"""

QUERIES["ai_only"] = lambda spark, sf: mt.ai_only(v.part_rules(spark, sf), 0.70).select("id")
SQL["ai_only"] = f"WITH {v.WITH_RULES} SELECT id FROM rules WHERE confidence >= 0.7::REAL"

QUERIES["rulepack_coverage"] = lambda spark, sf: fd.rulepack_coverage(v.part_rules(spark, sf))
SQL["rulepack_coverage"] = f"""WITH {v.WITH_RULES} SELECT language, count(DISTINCT id) AS rules FROM
(SELECT id, unnest(languages) AS language FROM rules) GROUP BY 1"""

QUERIES["rulepack_by_category"] = lambda spark, sf: fd.rulepack_coverage(
    v.part_rules(spark, sf), "category")
SQL["rulepack_by_category"] = f"""WITH {v.WITH_RULES} SELECT
  coalesce(category, 'uncategorized') AS category, count(DISTINCT id) AS rules FROM rules GROUP BY 1"""

# Suppression ---------------------------------------------------------------------------------


def _code_lines(spark, sf) -> DataFrame:
    rows = cp.explode_lines(v.code_corpus(spark, sf)).withColumn("rule_id", F.lit("PY-INJ-003"))
    return rows.withColumn("previous_lower", F.lag("text_lower").over(
        Window.partitionBy("path").orderBy("line")))


QUERIES["suppress_lines"] = lambda spark, sf: mt.suppress_lines(_code_lines(spark, sf)).select(
    "path", "line")
SQL["suppress_lines"] = f"""WITH {lines_cte(CODE)}, r AS (SELECT *, 'PY-INJ-003' AS rid FROM numbered)
SELECT path, line::INT AS line FROM r WHERE NOT {q.line_suppressed('low')}
AND NOT coalesce({q.line_suppressed('prev')}, false)"""

QUERIES["suppress_files"] = lambda spark, sf: mt.suppress_files(v.code_corpus(spark, sf).withColumn(
    "rule_id", F.lit("PY-CRYPTO-001"))).select("path")
SQL["suppress_files"] = f"""WITH {lines_cte(CODE)}, r AS (SELECT *, 'PY-CRYPTO-001' AS rid FROM numbered)
SELECT path FROM corpus WHERE path NOT IN (SELECT path FROM r
WHERE {q.applies('low', q.MARK + '-file')})"""

# Routes --------------------------------------------------------------------------------------

_DQ = q.trim("regexp_extract(text, '^[^\"]*\"([^\"]*)\"', 1)")
_SQ = q.trim("regexp_extract(text, '^[^'']*''([^'']*)''', 1)")
_SEG = f"""(CASE WHEN regexp_matches(text, '^[^"]*"[^"]*"') THEN
  CASE WHEN {_DQ} <> '' THEN {_DQ} ELSE {_SQ} END ELSE '' END)"""
_SENS = q.any_in(lower(_SEG), rt.SENSITIVE)


def _route_rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("rule_id"), "file", "line", "snippet",
                     score("ai_confidence"), score("risk_score"), "ai_tendency", "fix_suggestion")


def _route_sql(check: rt.RouteCheck, guarded: str) -> str:
    texts = [t.replace("'", "''") for t in (check.tendency, check.suggestion)]
    return f"""SELECT '{check.rule_id}' AS rule_id, path AS file, line::INT AS line,
  {q.trim('text')} AS snippet, {check.likelihood}::DOUBLE AS ai_confidence,
  {check.risk}::DOUBLE AS risk_score, '{texts[0]}' AS ai_tendency, '{texts[1]}' AS fix_suggestion
FROM flagged WHERE language = '{check.language}' AND {q.any_in('low', check.routes)} AND {_SENS}
  AND NOT ({guarded})"""


def _near(check: rt.RouteCheck) -> str:
    return (f"coalesce(bool_or({q.any_in('low', check.guards)}) OVER (PARTITION BY path ORDER BY line "
            f"ROWS BETWEEN {check.before} PRECEDING AND {check.after} FOLLOWING), false)")


_HINT = q.any_in("low", rt.AUTH_HINTS)
_FLAGS = f"""flagged AS (SELECT *, {_near(rt.PYTHON)} AS py_near,
  {_near(rt.JAVA)} AS java_near, bool_or({q.any_in('low', rt.JS.guards)} AND {_HINT})
  OVER (PARTITION BY path ORDER BY line) AS js_above FROM numbered)"""
_JS_SQL = _route_sql(rt.JS, f"{_HINT} OR js_above")
_PY_SQL, _JAVA_SQL = _route_sql(rt.PYTHON, "py_near"), _route_sql(rt.JAVA, "java_near")


def route_parts() -> str:
    """flagged and routes: all unguarded routes."""
    return f"{_FLAGS}, routes AS ({_JS_SQL} UNION ALL {_PY_SQL} UNION ALL {_JAVA_SQL})"


for _name, _fn, _sql in [("unguarded_routes_js", rt.unguarded_routes_js, _JS_SQL),
                         ("unguarded_routes_py", rt.unguarded_routes_py, _PY_SQL),
                         ("unguarded_routes_java", rt.unguarded_routes_java, _JAVA_SQL)]:
    QUERIES[_name] = lambda spark, sf, fn=_fn: _route_rows(fn(v.code_corpus(spark, sf)))
    SQL[_name] = f"WITH {lines_cte(CODE)}, {_FLAGS} {_sql}"

QUERIES["quoted_segment"] = lambda spark, sf: cp.explode_lines(v.code_corpus(spark, sf)).select(
    "path", "line", rt.quoted_segment(F.col("text")).alias("segment"),
    rt.is_sensitive(rt.quoted_segment(F.col("text"))).alias("sensitive")).where("segment <> ''")
SQL["quoted_segment"] = f"""WITH {lines_cte(CODE)} SELECT * FROM (SELECT path, line::INT AS line,
  {_SEG} AS segment, {_SENS} AS sensitive FROM numbered) WHERE segment <> ''"""

# Whole scan ----------------------------------------------------------------------------------

OPTIONS = ScanOptions(categories=["crypto", "auth", "injection"], exclude=["tests/"],
                      cross_file=True, profile="pragmatic", dedup="normalized")


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace({lower(x)}, '[^a-z0-9]+', ' ', 'g'))"


def dedup_sql(source: str) -> str:
    return f"""SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY {lower('file')}, line,
  {lower("coalesce(category, 'uncategorized')")}, {norm_sql('snippet')} ORDER BY risk_score DESC,
  {rank('severity')} DESC, ai_confidence DESC, rule_id, "column", title) AS k FROM {source}) WHERE k = 1"""


QUERIES["scan"] = lambda spark, sf: flat(scan(
    v.code_corpus(spark, sf), rules(spark, CODE_RULES), OPTIONS))


def _routes_full(sql: str) -> str:
    return f"""SELECT rule_id, '{rt.TITLE}' AS title, 'high' AS severity, file, line, 1 AS "column",
  snippet, ai_confidence, risk_score, 'auth' AS category, NULL AS cwe_id, NULL AS owasp_category,
  'auth,cross-file,heuristic' AS tags, ai_tendency, fix_suggestion FROM ({sql})"""


_SCAN_RULES = [r for r in CODE_RULES if r["confidence"] >= 0.5
               and (r["category"] in OPTIONS.categories
                    or set(r["tags"]) & set(OPTIONS.categories))]
SQL["scan"] = f"""{scored_cte(CODE, _SCAN_RULES)}, {_FLAGS},
u AS (SELECT {FLAT_COLS} FROM scored UNION ALL {_routes_full(_JS_SQL)}
  UNION ALL {_routes_full(_PY_SQL)} UNION ALL {_routes_full(_JAVA_SQL)}),
d AS ({dedup_sql(f"(SELECT * FROM u WHERE NOT contains(lower(file), 'tests/') AND {rank('severity')} >= 4)")})
SELECT * FROM d"""

QUERIES["scan_many"] = lambda spark, sf: flat(scan_many(
    [v.code_corpus(spark, sf), v.doc_corpus(spark, sf)], rules(spark, [*CODE_RULES, *TEXT_RULES]))
).select("rule_id", "file", "line", "risk_score")
SQL["scan_many"] = f"""{scored_cte(CODE + ' UNION ALL ' + DOC, [*CODE_RULES, *TEXT_RULES])}
SELECT rid AS rule_id, path AS file, line, {score1('rs')} AS risk_score FROM scored"""

QUERIES["scan_summary"] = lambda spark, sf: scan_summary(
    code_findings(spark, sf), v.code_corpus(spark, sf), rules(spark, CODE_RULES))
SQL["scan_summary"] = (
    f"{hits_cte(CODE, CODE_RULES)} SELECT count(*) AS total, {severity_counts()}, "
    f"(SELECT count(*) FROM corpus) AS scanned_files, {len(CODE_RULES)} AS matched_rules FROM hits")

# Scores --------------------------------------------------------------------------------------


def _parts(spark, sf) -> DataFrame:
    hits = sc.lowered(mt.match_rules(v.code_corpus(spark, sf), rules(spark, CODE_RULES)))
    p, s, cat = F.col("_p"), F.col("_s"), F.col("category")
    return hits.select(
        F.col("id").alias("rule_id"), "path", "line",
        F.round(sc.ai_likelihood(F.col("confidence"), p, s).cast("double"), 1).alias("likelihood"),
        sc.context_risk(p, cat, s).cast("double").alias("context"),
        sc.exploitability(F.col("id"), F.col("tags"), cat, p, s).cast("double").alias("exploit"))


QUERIES["score_parts"] = _parts
SQL["score_parts"] = f"""{hits_cte(CODE, CODE_RULES)} SELECT rid AS rule_id, path, line,
  {score1(q.likelihood('prior', 'path', 'snippet'))} AS likelihood,
  {q.context('path', 'category', 'snippet')}::DOUBLE AS context,
  {q.exploit('rid', 'tags', 'category', 'path', 'snippet')}::DOUBLE AS exploit FROM hits"""


def _blend_sql(c: sc.Calibration, p: str, h: str) -> str:
    x = (f"least(greatest(least(greatest({p}, 0::REAL), 1::REAL) * {c.scale}::REAL + ({c.bias})::REAL, "
         f"{c.min_probability}::REAL), {c.max_probability}::REAL) * 100::REAL")
    w = f"({c.model_weight}::REAL + {c.heuristic_weight}::REAL)"
    m = f"(({x}) * {c.model_weight}::REAL + {h} * {c.heuristic_weight}::REAL) / {w}"
    mixed = score1(q.round1(f"least(greatest({m}, 0::REAL), 100::REAL)"))
    return f"CASE WHEN {p} IS NULL THEN round({h}::DOUBLE, 1) ELSE {mixed} END"


_P = "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_tax * 12 AS FLOAT) END"
_HEUR = "CAST(l_discount * 1000 AS FLOAT)"


def _blend(spark, sf) -> DataFrame:
    rows = v.load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.expr(_P).alias("p"), F.expr(_HEUR).alias("h"))
    mixed = {name: sc.blend(F.col("p"), F.col("h"), name) for name in sc.CALIBRATION}
    mixed["tuned"] = sc.blend(F.col("p"), F.col("h"), "balanced", bias=0.9, scale=1.5)
    return rows.select("l_orderkey", "l_linenumber", *[
        F.round(c.cast("double"), 1).alias(name) for name, c in mixed.items()])


QUERIES["blend"] = _blend
SQL["blend"] = (f"WITH r AS (SELECT l_orderkey, l_linenumber, {_P} AS p, {_HEUR} AS h FROM lineitem) "
                "SELECT l_orderkey, l_linenumber, " + ", ".join(
                    f"{_blend_sql(c, 'p', 'h')} AS {n}" for n, c in sc.CALIBRATION.items())
                + f", {_blend_sql(sc.CALIBRATION['balanced'].tuned(bias=0.9, scale=1.5), 'p', 'h')} "
                "AS tuned FROM r")

_GRADED = """SELECT *, CASE WHEN score >= 95 THEN 'A+' WHEN score >= 85 THEN 'A' WHEN score >= 70
  THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 25 THEN 'D' ELSE 'F' END AS grade"""
_POINTS = "greatest(0, least(100, 100 - (critical * 25 + high * 10 + medium * 3 + low))) AS score"

QUERIES["grade"] = lambda spark, sf: fd.grade(code_findings(spark, sf))
SQL["grade"] = f"""{hits_cte(CODE, CODE_RULES)}, c AS (SELECT count(*) AS total, {severity_counts()}
  FROM hits), g AS (SELECT *, {_POINTS} FROM c)
{_GRADED}, CASE WHEN score >= 95 THEN 'brightgreen' WHEN score >= 85 THEN 'green'
  WHEN score >= 70 THEN 'yellowgreen' WHEN score >= 50 THEN 'yellow' WHEN score >= 25 THEN 'orange'
  ELSE 'red' END AS color FROM g"""


def _grades(spark, sf) -> DataFrame:
    from riskloom.functions.severity import severity_counts as counts
    per = code_findings(spark, sf).groupBy("file").agg(*counts())
    points = sc.grade_points(*[F.col(c) for c in ("critical", "high", "medium", "low")])
    return per.select("file", points.alias("score")).withColumn(
        "grade", sc.grade_label(F.col("score")))


QUERIES["grade_per_file"] = _grades
SQL["grade_per_file"] = f"""{hits_cte(CODE, CODE_RULES)}, c AS (SELECT path AS file, {severity_counts()}
  FROM hits GROUP BY 1), g AS (SELECT file, {_POINTS} FROM c) {_GRADED} FROM g"""

# Text signals --------------------------------------------------------------------------------

_COMMENT = "regexp_matches({}, '^(//|#|\\*)')"
QUERIES["code_features"] = lambda spark, sf: ts.code_features(
    cp.spread(v.load(spark, sf, "documents").select("doc_id", "text")), "text").select(
    "doc_id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in
                ("comment_density", "mean_line_length", "keyword_score")])
_TEXTS = "SELECT doc_id AS path, 'x' AS language, text AS content FROM documents"
_WORDS = " + ".join(f"contains(lower(text), '{k}')::INT" for k in (
    "generated by", "openai", "chatgpt", "copilot", "anthropic", "claude", "here is the code", "sure,"))
SQL["code_features"] = f"""WITH {lines_cte(_TEXTS)}, a AS (SELECT path, count(*) AS n,
  count(*) FILTER (WHERE {_COMMENT.format(q.trim('text'))}) AS c, sum(strlen(text)) AS b
  FROM numbered GROUP BY 1)
SELECT doc_id, round((CASE WHEN n IS NULL THEN 0::REAL ELSE c::REAL / n::REAL END)::DOUBLE, 4)
  AS comment_density, round((CASE WHEN n IS NULL THEN 0::REAL
  ELSE least(b::REAL / n::REAL, 200::REAL) END)::DOUBLE, 4) AS mean_line_length,
  CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE ({_WORDS})::DOUBLE END AS keyword_score
FROM documents LEFT JOIN a ON doc_id = path"""

_PASTE = """CASE turn % 5 WHEN 0 THEN 'Here is the solution: ' || text || chr(10) || '// foo' || chr(10)
  || '# bar' || chr(10) || ' * baz' || chr(10) || '// x' || chr(10) || '//' WHEN 1 THEN
  text || ' hope this HELPS `x`' WHEN 2 THEN 'I' || chr(39) || 've fixed the code' || text
  WHEN 3 THEN 'an example of doSomething ' || text ELSE text END"""


def _paste(spark, sf) -> DataFrame:
    rows = v.view(spark, sf, f"SELECT conv_id, turn, {_PASTE} AS pasted FROM {{conversations}}")
    return cp.spread(rows).select(
        "conv_id", "turn", ts.paste_signal(F.col("pasted")).alias("score"),
        ts.line_count(F.col("pasted")).alias("lines"), tx.short_hash("pasted").alias("hash"))


QUERIES["paste_signal"] = _paste
_NAMES = " + ".join(f"contains(t, '{p}')::INT" for p in (
    "foo", "bar", "baz", "example", "myFunction", "doSomething"))
_TRIMMED = _COMMENT.format(f"trim(z, {q.JS_WS})")
SQL["paste_signal"] = f"""WITH r AS (SELECT conv_id, turn, {_PASTE} AS t FROM conversations),
x AS (SELECT *, string_split(t, chr(10)) AS ls FROM r),
y AS (SELECT *, len(list_filter(ls, lambda z: {_TRIMMED})) AS c FROM x)
SELECT conv_id, turn, len(regexp_split_to_array(t, '\\r\\n|\\r|\\n'))::INT AS lines,
  substr(sha1(t), 1, 8) AS hash,
  (CASE WHEN regexp_matches(t, '(?i)here is the (code|solution|fix)') THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(t, '(?i)I(''ve| have) (updated|fixed|refactored) the code') THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(t, '(?i)hope this helps') THEN 1 ELSE 0 END
  + CASE WHEN ({_NAMES}) >= 2 THEN 1 ELSE 0 END
  + CASE WHEN len(ls) > 5 AND c::DOUBLE / len(ls) > 0.4 THEN 1 ELSE 0 END
  + CASE WHEN contains(t, '`') THEN 2 ELSE 0 END)::INT AS score FROM y"""
