"""The engine's inputs as views on the driver tables.

One SQL text per view serves Spark and the SQL check; names in braces are the driver tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import apply_settings
from riskloom.sources.corpus import spread, with_relative_path

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

SMALL = {"region", "nation", "part", "customer", "supplier"}

#: A row of orders is a few bytes, but as a source file it costs a scan half a millisecond.
FILES_PER_TASK = 20_000

FINDINGS = """
SELECT CAST(l_orderkey AS STRING) AS scan_id, l_linenumber AS line_number, p_brand AS rule_id,
       p_type AS rule_title, 'src/mod_' || CAST(l_partkey % 97 AS STRING) || '.py' AS file_path,
       CASE WHEN l_quantity >= 45 THEN 'critical' WHEN l_quantity >= 30 THEN 'high'
            WHEN l_quantity >= 15 THEN 'medium' WHEN l_quantity >= 5 THEN 'low'
            ELSE 'info' END AS severity,
       CAST(l_discount * 10 AS FLOAT) AS ai_confidence,
       CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'CWE-' || CAST(p_size AS STRING) END AS cwe_id,
       CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN ''
            ELSE 'A0' || CAST(p_size % 7 AS STRING) || ':2021' END AS owasp_category,
       CASE WHEN p_size % 4 = 0 THEN 'Typical Copilot completion'
            WHEN p_size % 4 = 1 THEN 'ChatGPT habit' WHEN p_size % 4 = 2 THEN 'claude style'
            ELSE NULL END AS ai_tendency,
       p_name || ' = ' || CAST(l_linenumber AS STRING) AS snippet, l_shipdate AS seen_at,
       l_returnflag AS flag
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

SCANS = """
SELECT CAST(o_orderkey AS STRING) AS scan_id,
       o_orderdate + (o_custkey % 1440) * INTERVAL '1' MINUTE AS ts, r_name AS org_id,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END AS team_id,
       CASE WHEN n_nationkey = 3 THEN NULL ELSE n_name END AS repo_id,
       'repo-' || n_name AS repo_name, 'src/' AS target_path, o_orderstatus AS branch,
       'c' || CAST(o_custkey AS STRING) AS commit_sha,
       CAST(coalesce(t, 0) AS INT) AS total_findings, CAST(coalesce(c, 0) AS INT) AS critical_count,
       CAST(coalesce(h, 0) AS INT) AS high_count, CAST(coalesce(m, 0) AS INT) AS medium_count,
       CAST(coalesce(w, 0) AS INT) AS low_count, CAST(coalesce(i, 0) AS INT) AS info_count,
       CAST(coalesce(a, 0) AS INT) AS ai_estimated_count,
       CAST(CASE WHEN coalesce(t, 0) > 0 THEN CAST(a AS DOUBLE) / t ELSE 0 END AS FLOAT)
           AS ai_ratio,
       CAST((o_custkey * 7) % 4000 AS INT) AS scan_duration_ms
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
LEFT JOIN (
  SELECT l_orderkey, count(*) AS t, sum(CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END) AS c,
         sum(CASE WHEN l_quantity >= 30 AND l_quantity < 45 THEN 1 ELSE 0 END) AS h,
         sum(CASE WHEN l_quantity >= 15 AND l_quantity < 30 THEN 1 ELSE 0 END) AS m,
         sum(CASE WHEN l_quantity >= 5 AND l_quantity < 15 THEN 1 ELSE 0 END) AS w,
         sum(CASE WHEN l_quantity < 5 THEN 1 ELSE 0 END) AS i,
         sum(CASE WHEN CAST(l_discount * 10 AS FLOAT) >= CAST(0.7 AS FLOAT) THEN 1 ELSE 0 END) AS a
  FROM {lineitem} GROUP BY l_orderkey) counts ON o_orderkey = l_orderkey
"""

# Free text as source files; the language picks the extension.
DOC_CORPUS = """
SELECT 'src/' || source || '/doc_' || CAST(doc_id AS STRING)
       || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.java'
                    ELSE '.go' END AS path,
       CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'javascript' WHEN 'de' THEN 'java'
                 ELSE 'go' END AS language,
       text AS content
FROM {documents}
"""

PAGE_CORPUS = """
SELECT 'web/' || CAST(page_id AS STRING) || '/' || url AS path, 'php' AS language, html AS content
FROM {pages}
"""

# Small source files whose statements, guards and markers follow the columns of an order.
CODE_CORPUS = """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'svc/auth/' WHEN '2-HIGH' THEN 'svc/api/'
            WHEN '3-MEDIUM' THEN 'tests/' WHEN '5-LOW' THEN 'docs/Generated/' ELSE 'core/' END
       || 'unit_' || CAST(o_orderkey AS STRING)
       || CASE o_orderkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.java'
               ELSE '.go' END AS path,
       CASE o_orderkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'java'
            ELSE 'go' END AS language,
       CASE o_orderkey % 4
       WHEN 0 THEN
         CASE WHEN o_custkey % 11 = 0 THEN '# riskloom:ignore-file PY-CRYPTO-001'
              ELSE 'import os' END || chr(10)
         || CASE WHEN o_custkey % 5 = 0 THEN '@login_required' ELSE '# entry Éa' END || chr(10)
         || '@app.route("/' || CASE o_orderstatus WHEN 'F' THEN 'admin/' WHEN 'O' THEN 'health/'
              ELSE 'user/' END || CAST(o_custkey AS STRING) || '")' || chr(10)
         || 'def handle_request(value):' || chr(10)
         || '    DIGEST = hashlib.md5(value); other = hashlib.sha1(value)'
         || CASE WHEN o_custkey % 7 = 0 THEN '  # riskloom:ignore' ELSE '' END || chr(10)
         || CASE WHEN o_custkey % 3 = 0 THEN '    # riskloom:ignore PY-INJ-003' ELSE '    pass' END
         || chr(13) || chr(10)
         || '    subprocess.run(cmd, shell=True)  # TODO quick fix' || chr(10)
         || CASE WHEN o_custkey % 13 = 0 THEN '    check = compare_digest(token, other)'
              ELSE '    if token == provided_password: return True' END || chr(10)
         || '    requests.get(url_' || CAST(o_custkey AS STRING) || ', verify=False)' || chr(10)
       WHEN 1 THEN
         CASE WHEN o_custkey % 4 = 0 THEN 'app.use(requireAuth)' ELSE 'const app = express()' END
         || chr(10) || 'router.use(logger)' || chr(10)
         || 'app.get("/' || CASE o_orderstatus WHEN 'F' THEN 'admin/' WHEN 'O' THEN 'status/'
              ELSE 'billing/' END || CAST(o_custkey AS STRING) || '", '
         || CASE WHEN o_custkey % 6 = 0 THEN 'passport.check, ' ELSE '' END || 'show)' || chr(10)
         || CASE WHEN o_custkey % 9 = 0 THEN 'router.use(verifyToken)' ELSE '' END || chr(10)
         || 'router.post("", ' || chr(39) || '/private/' || chr(39) || ', save)' || chr(10)
         || 'éa = "x"; node.innerHTML = eval(input_value_number)' || chr(10)
         || 'const digest = createHash(' || chr(39) || 'md5' || chr(39) || ')' || chr(10)
         || CASE WHEN o_custkey % 5 = 0 THEN '// riskloom:ignore: js-inj-003, js-crypto-001'
              ELSE '//' END || chr(10)
         || 'exec(' || chr(39) || 'ls' || chr(39) || '); const debugSettings = { debug: true }'
       WHEN 2 THEN
         'public class Unit' || CAST(o_custkey AS STRING) || ' {' || chr(10)
         || CASE WHEN o_custkey % 3 = 0 THEN '  @PreAuthorize("x")' ELSE '' END || chr(10)
         || '  @GetMapping("/' || CASE o_orderstatus WHEN 'F' THEN 'profile' WHEN 'O' THEN 'ping'
              ELSE 'internal/users' END || '")' || chr(10)
         || '  Object run() { return MessageDigest.getInstance("MD5"); }' || chr(10)
         || '  boolean same() { if (secret == provided) return new Random().nextBoolean(); }'
         || chr(10) || '}' || chr(10)
       ELSE
         'package main' || chr(10)
         || CASE WHEN o_custkey % 8 = 0 THEN '// constanttimecompare( is used' || chr(10)
              ELSE '' END
         || 'sum := md5.Sum(data)' || chr(10) || 'if secret == incoming {' || chr(10)
         || '  query := "SELECT * FROM accounts WHERE id = " + id_' || CAST(o_custkey AS STRING)
         || chr(10) || '}' || chr(10)
       END AS content
FROM {orders}
"""


# Scanner findings with copies of the same place; the scores are on the 0-100 scale.
SCANNER = """
SELECT p_brand AS id, p_type AS title,
       CASE WHEN l_quantity >= 45 THEN 'critical' WHEN l_quantity >= 30 THEN 'high'
            WHEN l_quantity >= 15 THEN 'medium' WHEN l_quantity >= 5 THEN 'low'
            ELSE 'info' END AS severity,
       'src/Mod_' || CAST(l_partkey % 97 AS STRING) || '.py' AS file, l_linenumber AS line,
       CAST(l_suppkey % 40 + 1 AS INT) AS col_no,
       p_name || CASE WHEN l_tax > 0.04 THEN ' -- X' ELSE '  (x)' END AS snippet,
       CAST(l_discount * 1000 AS FLOAT) AS ai_confidence,
       CAST(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1001 AS DOUBLE) / 10 AS FLOAT)
           AS risk_score,
       CASE WHEN p_size % 6 = 0 THEN NULL WHEN p_size % 6 = 1 THEN 'Crypto'
            WHEN p_size % 6 = 2 THEN 'auth' ELSE p_type END AS category,
       CASE WHEN p_size % 9 = 0 THEN 'CWE-' || CAST(p_size AS STRING) END AS cwe_id,
       CASE WHEN p_size % 8 = 0 THEN 'A0' || CAST(p_size % 7 AS STRING) || ':2021' END
           AS owasp_category,
       CASE WHEN p_size % 5 = 0 THEN 'xss, Secrets ' WHEN p_size % 5 = 1 THEN 'cors,debug'
            WHEN p_size % 5 = 2 THEN 'other' ELSE '' END AS tags_text,
       CASE WHEN p_size % 4 = 0 THEN 'ACME' || '-INJ-' || p_brand WHEN p_size % 4 = 1
            THEN 'ACME-misc-' || p_brand ELSE p_brand END AS long_id,
       l_returnflag AS flag, l_orderkey AS orderkey, l_tax AS tax
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

# Rules whose ids, languages and needles come from the parts.
RULES = """
SELECT 'PART-' || CAST(p_partkey AS STRING) AS id, p_name AS title,
       CASE WHEN p_size > 40 THEN 'critical' WHEN p_size > 30 THEN 'high'
            WHEN p_size > 20 THEN 'medium' ELSE 'low' END AS severity,
       CAST(CAST(p_size AS DOUBLE) / 50 AS FLOAT) AS confidence,
       split(CASE WHEN p_size % 3 = 0 THEN 'python' WHEN p_size % 3 = 1 THEN 'javascript,go'
             ELSE 'java,python,rust' END, ',') AS languages,
       CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END AS category,
       split(CASE WHEN p_size % 4 = 0 THEN 'Auth,' || p_brand ELSE p_brand END, ',') AS tags,
       split(p_name, ' ') AS pattern_any
FROM {part}
"""

# Paths of every kind the language tagger tells apart.
PATHS = """
SELECT c_custkey, CASE c_custkey % 24
  WHEN 0 THEN 'svc/main.py' WHEN 1 THEN 'svc/App.JSX' WHEN 2 THEN 'a/b.tsx' WHEN 3 THEN 'x.mjs'
  WHEN 4 THEN 'cmd/run.go' WHEN 5 THEN 'src/lib.rs' WHEN 6 THEN 'A.java' WHEN 7 THEN 'P.cs'
  WHEN 8 THEN 'r.rb' WHEN 9 THEN 'page.phtml' WHEN 10 THEN 'm.kts' WHEN 11 THEN 'v.swift'
  WHEN 12 THEN 'main.hcl' WHEN 13 THEN 'Dockerfile' WHEN 14 THEN 'img/dockerfile.prod'
  WHEN 15 THEN '.github/workflows/ci.yml' WHEN 16 THEN 'deploy/Service.YAML'
  WHEN 17 THEN 'conf/plain.yaml' WHEN 18 THEN 'notes.txt' WHEN 19 THEN 'dir.py/readme'
  WHEN 20 THEN '.py' WHEN 21 THEN 'a.tar.gz' WHEN 22 THEN 'helm/values.yml' ELSE 'x.d.ts' END
  AS tail, 'root/' || c_mktsegment || '/' AS head
FROM {customer}
"""


def strip_braces(sql: str) -> str:
    """The view for the SQL check, where the tables are views of the same name."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, sql: str, dealt: bool = False, rows: int | None = None) -> DataFrame:
    """A view as a DataFrame over the tables in a folder. ``dealt`` spreads tables that come in
    fewer splits than there are task slots, for views with much work per row; ``rows`` bounds a task."""
    apply_settings(spark)
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    quoted = "".join(part if re.fullmatch(r"\{\w+\}", part)
                     else part.replace("{", "{{").replace("}", "}}")
                     for part in re.split(r"(\{\w+\})", sql))
    tables = {n: load(spark, sf, n) for n in names}
    if dealt:
        tables = {n: t if n in SMALL else spread(t, rows) for n, t in tables.items()}
    return spark.sql(quoted, **tables)


def findings(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, FINDINGS)


def scans(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, SCANS).withColumnRenamed("ts", "timestamp")


def _files(df: DataFrame) -> DataFrame:
    return with_relative_path(df, ".").select("path", "file", "language", "content")


def doc_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return _files(view(spark, sf, DOC_CORPUS, dealt=True))


def page_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return _files(view(spark, sf, PAGE_CORPUS, dealt=True))


def code_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return _files(view(spark, sf, CODE_CORPUS, dealt=True, rows=FILES_PER_TASK))


def scanner_findings(spark: SparkSession, sf: str) -> DataFrame:
    df = view(spark, sf, SCANNER, dealt=True).withColumnRenamed("col_no", "column")
    empty = F.lit(None).cast("string")
    return df.withColumns({"tags": F.split("tags_text", ","), "ai_tendency": empty,
                           "fix_suggestion": empty})


def part_rules(spark: SparkSession, sf: str) -> DataFrame:
    df = view(spark, sf, RULES)
    empty, none = F.array().cast("array<string>"), F.lit(None).cast("string")
    return df.withColumns({
        "pattern_all": empty, "pattern_not": empty, "negative_patterns": empty, "cwe_id": none,
        "owasp_category": none, "ai_tendency": none, "fix_suggestion": none})


WITH_SCANNER = "scanner AS (" + strip_braces(SCANNER) + ")"
WITH_RULES = "rules AS (" + strip_braces(RULES) + ")"
WITH_FINDINGS = "findings AS (" + strip_braces(FINDINGS) + ")"
WITH_SCANS = "scans AS (" + strip_braces(SCANS) + ")"
WITH_BOTH = f"WITH {WITH_FINDINGS}, {WITH_SCANS}"
