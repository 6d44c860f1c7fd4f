"""Queries for ingest, upsert, validation, upkeep and the streaming twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import views as v
from queries.dashboards import AS_OF, with_r6
from queries.rulebook import CODE_RULES, TEXT_RULES, rules
from queries.scanning import CODE, DOC, FLAT_COLS, dedup_sql, flat
from queries.sqlparts import rank, scored_cte, severity_counts
from riskloom.functions import text as tx
from riskloom.operators import ingest as ig
from riskloom.operators.statistics import count_different
from riskloom.plans.scan import ScanOptions, scan
from riskloom.session import shared_dir
from riskloom.sinks.tables import write_tables
from riskloom.sources.reports import parse_ingest
from riskloom.streaming import streams as st
from riskloom.streaming.files import last_findings, start_files

QUERIES: dict = {}
SQL: dict = {}

# One payload per line item; some lack a required field, some hold a second finding.
PAYLOADS = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS scan_id, l_orderkey,
  l_linenumber, l_shipdate AS received_at, l_suppkey, l_partkey,
  l_quantity, l_discount, l_tax, l_returnflag
FROM {lineitem}
"""
_BAD = "l_suppkey % 50 = 0"
_TWO = "l_linenumber % 3 = 0"
_SEV = ("CASE WHEN l_quantity >= 45 THEN 'Critical' WHEN l_quantity >= 30 THEN 'High' "
        "WHEN l_quantity >= 15 THEN 'Medium' ELSE 'Low' END")


def _payloads(spark, sf) -> DataFrame:
    rows = v.view(spark, sf, PAYLOADS, dealt=True)
    one = F.struct(
        F.concat(F.lit("R-"), (F.col("l_partkey") % 30).cast("string")).alias("rule_id"),
        F.expr(_SEV).alias("severity"),
        F.concat(F.lit("src/f"), (F.col("l_partkey") % 9).cast("string")).alias("file_path"),
        F.when(F.col("l_linenumber") != 5, F.col("l_linenumber")).alias("line_number"),
        (F.col("l_discount") * 1000).alias("ai_confidence"),
        F.when(F.col("l_linenumber") == 2, "  ").otherwise(" CWE-79 ").alias("cwe_id"),
        F.lit(None).cast("string").alias("owasp_category"))
    listed = F.when(F.expr(_TWO), F.array(one, one)).otherwise(F.array(one))
    result = F.struct(
        F.size(listed).alias("total_findings"), F.lit(0).alias("critical"),
        F.lit(1).alias("high"), F.lit(0).alias("medium"), F.lit(0).alias("low"),
        F.lit(0).alias("info"), (F.col("l_linenumber") % 2).alias("ai_estimated_count"),
        F.lit(12).alias("scan_duration_ms"), listed.alias("findings"))
    payload = F.struct(
        F.col("l_returnflag").alias("org_id"), F.lit("acme/app").alias("repo_id"),
        F.when(~F.expr(_BAD), F.lit("app")).alias("repo_name"), F.lit(".").alias("target_path"),
        result.alias("scan_result"))
    return rows.select("scan_id", "received_at", F.to_json(payload).alias("payload"))


QUERIES["parse_ingest"] = lambda spark, sf: parse_ingest(_payloads(spark, sf)).select(
    "scan_id", "accepted", F.size("p.scan_result.findings").alias("findings"))
SQL["parse_ingest"] = f"""SELECT l_orderkey || '-' || l_linenumber AS scan_id, NOT ({_BAD}) AS accepted,
  (CASE WHEN {_TWO} THEN 2 ELSE 1 END)::INT AS findings FROM lineitem"""

QUERIES["ingest_scans"] = lambda spark, sf: ig.ingest(_payloads(spark, sf)).scans.select(
    "scan_id", F.col("timestamp").alias("at"), "org_id", "repo_name", "total_findings", "high_count",
    "ai_estimated_count", F.round(F.col("ai_ratio").cast("double"), 6).alias("ai_ratio"), "scan_date")
_P = f"p AS ({v.strip_braces(PAYLOADS)})"
SQL["ingest_scans"] = f"""WITH {_P} SELECT scan_id, received_at AS at, l_returnflag AS org_id,
  'app' AS repo_name, (CASE WHEN {_TWO} THEN 2 ELSE 1 END)::INT AS total_findings, 1 AS high_count,
  (l_linenumber % 2)::INT AS ai_estimated_count,
  round((l_linenumber % 2) / (CASE WHEN {_TWO} THEN 2 ELSE 1 END)::DOUBLE, 6) AS ai_ratio,
  received_at::DATE AS scan_date FROM p WHERE NOT ({_BAD})"""

_ROW = f"""SELECT scan_id, 'R-' || l_partkey % 30 AS rule_id, lower({_SEV}) AS severity,
  'src/f' || l_partkey % 9 AS file_path, CASE WHEN l_linenumber <> 5 THEN l_linenumber END AS line_number,
  CASE WHEN (l_discount * 1000)::REAL > 1 THEN ((l_discount * 1000)::REAL / 100::REAL)::REAL
       ELSE (l_discount * 1000)::REAL END AS conf,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE 'CWE-79' END AS cwe_id, received_at
FROM p, (SELECT unnest([0, 1]) AS copy) WHERE NOT ({_BAD}) AND (copy = 0 OR {_TWO})"""
_HASH = "sha256(scan_id || '::' || file_path || '::' || coalesce(line_number, 0) || '::' || rule_id)"

QUERIES["ingest_findings"] = lambda spark, sf: ig.ingest(_payloads(spark, sf)).findings.select(
    "scan_id", "finding_hash", "rule_id", "severity", "file_path", "line_number",
    F.round(F.col("ai_confidence").cast("double"), 6).alias("ai_confidence"), "cwe_id",
    F.col("first_seen").alias("seen"), "fingerprint")
SQL["ingest_findings"] = f"""WITH {_P}, r AS ({_ROW}) SELECT scan_id, {_HASH} AS finding_hash, rule_id,
  severity, file_path, line_number, round(conf::DOUBLE, 6) AS ai_confidence, cwe_id,
  received_at AS seen, sha256('acme/app::' || file_path || '::' || coalesce(line_number, 0) || '::'
  || rule_id) AS fingerprint FROM r"""

QUERIES["ingest_rejects"] = lambda spark, sf: ig.ingest(_payloads(spark, sf)).rejects.select(
    "received_at")
SQL["ingest_rejects"] = f"SELECT l_shipdate AS received_at FROM lineitem WHERE {_BAD}"

# From a scan to the dashboards ------------------------------------------------------------------


def _scan_to_tables(spark, sf) -> DataFrame:
    """Files are scanned, one scan per language, stored by date, read back and summarised."""
    corpus = v.code_corpus(spark, sf)
    found = scan(corpus, rules(spark, CODE_RULES), ordered=False).withColumn(
        "scan_id", F.regexp_extract("file", r"\.([a-z]+)$", 1))
    heads = v.load(spark, sf, "region").select(
        F.get(F.array(*map(F.lit, ["py", "js", "java", "go", "none"])), F.col("r_regionkey"))
        .alias("scan_id"), F.lit("2001-07-15 08:00:00").cast("timestamp").alias("timestamp"),
        F.col("r_name").alias("org_id"), F.lit("app").alias("repo_name"), F.lit(".").alias("target_path"))
    done = ig.scan_tables(found, heads)
    path = f"{shared_dir(spark).rstrip('/')}/scan-{uuid.uuid4().hex}"
    write_tables(done.scans, done.findings, path, moved=False)
    scans, stored = (spark.read.parquet(f"{path}/{t}") for t in ("scans", "findings"))
    hits = count_different(stored, ["scan_id", "scan_date"], "finding_hash").select(
        "scan_id", "scan_date", F.col("different").alias("hashes"), F.col("n").alias("stored"))
    return scans.join(hits, ["scan_id", "scan_date"], "left").select(
        "scan_id", "scan_date", "org_id", "total_findings", "critical_count", "high_count",
        "medium_count", "low_count", "info_count", "ai_estimated_count",
        F.coalesce("stored", F.lit(0)).alias("stored"),
        (F.coalesce("hashes", F.lit(0)) <= F.coalesce("stored", F.lit(0))).alias("hashed"))


QUERIES["scan_to_tables"] = _scan_to_tables
SQL["scan_to_tables"] = f"""{scored_cte(CODE, CODE_RULES)}, c AS (
  SELECT regexp_extract(path, '[.]([a-z]+)$', 1) AS scan_id, count(*) AS n, {severity_counts()},
         count(*) FILTER (WHERE ai >= 70) AS ai FROM scored GROUP BY 1)
SELECT s.scan_id, DATE '2001-07-15' AS scan_date, r_name AS org_id,
  coalesce(n, 0)::INT AS total_findings, coalesce(critical, 0)::INT AS critical_count,
  coalesce(high, 0)::INT AS high_count, coalesce(medium, 0)::INT AS medium_count,
  coalesce(low, 0)::INT AS low_count, coalesce(info, 0)::INT AS info_count,
  coalesce(ai, 0)::INT AS ai_estimated_count, coalesce(n, 0) AS stored, true AS hashed
FROM (SELECT r_name, ['py', 'js', 'java', 'go', 'none'][r_regionkey + 1] AS scan_id FROM region) s
LEFT JOIN c ON s.scan_id = c.scan_id"""

# Upsert --------------------------------------------------------------------------------------


def _upsert(spark, sf) -> DataFrame:
    found = ig.ingest(_payloads(spark, sf)).findings
    old = found.where("first_seen < '1998-01-01'")
    new = found.where("first_seen >= '1998-01-01'")
    folded = ig.upsert_findings(ig.upsert_findings(old.limit(0), old), new)
    return folded.select("scan_id", "finding_hash", "rule_id", F.col("first_seen").alias("first"),
                         F.col("last_seen").alias("last"), "times_seen")


QUERIES["upsert_findings"] = _upsert
SQL["upsert_findings"] = f"""WITH {_P}, r AS ({_ROW}), h AS (SELECT *, {_HASH} AS finding_hash FROM r)
SELECT scan_id, finding_hash, any_value(rule_id) AS rule_id, min(received_at) AS first,
  max(received_at) AS last, count(*) AS times_seen FROM h GROUP BY 1, 2"""

QUERIES["finding_hash"] = lambda spark, sf: v.findings(spark, sf).select(
    "scan_id", "line_number", tx.scan_hash(F.col("scan_id"), F.col("file_path"),
                                           F.col("line_number"), F.col("rule_id")).alias("h"),
    tx.fingerprint(F.lit("repo"), F.col("file_path"), F.col("line_number"),
                   F.col("rule_id")).alias("f"))
SQL["finding_hash"] = f"""WITH {v.WITH_FINDINGS} SELECT scan_id, line_number,
  sha256(scan_id || '::' || file_path || '::' || line_number || '::' || rule_id) AS h,
  sha256('repo::' || file_path || '::' || line_number || '::' || rule_id) AS f FROM findings"""

# Validation ----------------------------------------------------------------------------------

_DIRTY_F = """SELECT CAST(l_orderkey AS STRING) AS scan_id, CAST(l_linenumber AS STRING) AS finding_hash,
  CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE 'R' END AS rule_id,
  CASE WHEN l_returnflag = 'R' THEN 'High' ELSE 'high' END AS severity, 'f' AS file_path,
  CAST(l_linenumber - CASE WHEN l_tax > 0.07 THEN 3 ELSE 0 END AS INT) AS line_number,
  CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_discount * 12 AS FLOAT) END AS ai_confidence,
  l_shipdate AS first_seen, CAST(l_suppkey % 19 AS BIGINT) AS times_seen,
  l_linestatus = 'F' AS is_fixed,
  CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate END AS fixed_at FROM {lineitem}"""
_CHECKS = [("required", "rule_id IS NOT NULL"), ("unique_per_scan", "NOT later"),
           ("valid_severity", "severity IN ('critical', 'high', 'medium', 'low', 'info')"),
           ("valid_confidence", "ai_confidence >= 0 AND ai_confidence <= 1"),
           ("valid_line_number", "line_number > 0"), ("valid_times_seen", "times_seen > 0"),
           ("fixed_at_requires_is_fixed",
            "(is_fixed AND fixed_at IS NOT NULL) OR (NOT is_fixed AND fixed_at IS NULL)")]


def _failed(checks) -> str:
    return "concat_ws(',', " + ", ".join(
        f"CASE WHEN NOT coalesce({c}, true) THEN '{n}' END" for n, c in checks) + ")"


QUERIES["validate_findings"] = lambda spark, sf: ig.check_findings(
    v.view(spark, sf, _DIRTY_F)).select(
    "scan_id", "finding_hash", F.col("first_seen").alias("seen"), "times_seen",
    F.array_join("violations", ",").alias("violations"))
SQL["validate_findings"] = f"""WITH d AS ({v.strip_braces(_DIRTY_F)}), x AS (SELECT *,
  first_seen > min(first_seen) OVER (PARTITION BY scan_id, finding_hash) AS later FROM d)
SELECT scan_id, finding_hash, first_seen AS seen, times_seen, {_failed(_CHECKS)} AS violations FROM x"""

_DIRTY_S = """SELECT CAST(o_custkey AS STRING) AS scan_id, o_orderdate AS timestamp_,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE '.' END AS target_path,
  CAST(o_orderkey % 13 - 1 AS INT) AS total_findings, CAST(o_orderkey % 7 - 1 AS INT) AS critical_count,
  1 AS high_count, 0 AS medium_count, 0 AS low_count, 0 AS info_count,
  CAST(o_orderkey % 5 AS INT) AS ai_estimated_count, o_orderkey FROM {orders}"""
_CHECKS_S = [("required", "target_path IS NOT NULL"), ("scan_id_unique", "NOT later"),
             ("valid_findings", "total_findings >= 0"), ("valid_severity_counts", "critical_count >= 0"),
             ("valid_ai_count", "ai_estimated_count <= total_findings")]

QUERIES["validate_scans"] = lambda spark, sf: ig.check_scans(v.view(
    spark, sf, _DIRTY_S).withColumnRenamed("timestamp_", "timestamp")).select(
    "scan_id", "o_orderkey", F.array_join("violations", ",").alias("violations"))
SQL["validate_scans"] = f"""WITH d AS ({v.strip_braces(_DIRTY_S)}), x AS (SELECT *,
  timestamp_ > min(timestamp_) OVER (PARTITION BY scan_id) AS later FROM d)
SELECT scan_id, o_orderkey, {_failed(_CHECKS_S)} AS violations FROM x"""


def _accepted(spark, sf) -> DataFrame:
    ok, rejected = ig.validate(ig.check_findings(v.view(spark, sf, _DIRTY_F)))
    return ok.agg(F.count("*").alias("n")).select(F.lit("accepted").alias("kind"), "n").unionAll(
        rejected.select(F.explode("violations").alias("kind")).groupBy("kind").agg(
            F.count("*").alias("n")))


QUERIES["validate"] = _accepted
SQL["validate"] = f"""WITH d AS ({v.strip_braces(_DIRTY_F)}), x AS (SELECT *,
  first_seen > min(first_seen) OVER (PARTITION BY scan_id, finding_hash) AS later FROM d),
y AS (SELECT {_failed(_CHECKS)} AS violations FROM x)
SELECT 'accepted' AS kind, count(*) AS n FROM y WHERE violations = ''
UNION ALL SELECT kind, count(*) FROM (SELECT unnest(string_split(violations, ',')) AS kind FROM y
  WHERE violations <> '') GROUP BY 1"""

# Upkeep --------------------------------------------------------------------------------------

QUERIES["apply_retention"] = lambda spark, sf: ig.apply_retention(
    v.scans(spark, sf), AS_OF).select("scan_id")
SQL["apply_retention"] = f"""WITH {v.WITH_SCANS} SELECT scan_id FROM scans
WHERE ts >= TIMESTAMP '{AS_OF} 00:00:00' - INTERVAL 2 YEAR"""

QUERIES["backfill_flags"] = lambda spark, sf: ig.backfill_flags(
    v.findings(spark, sf).withColumn("is_ai_generated", F.col("flag") == "A"),
    "owasp_category").select("scan_id", "line_number", "rule_id", "flag", "is_ai_generated")
SQL["backfill_flags"] = f"""WITH {v.WITH_FINDINGS} SELECT scan_id, line_number, rule_id, flag,
  CASE WHEN owasp_category <> '' THEN true ELSE flag = 'A' END AS is_ai_generated FROM findings"""

QUERIES["with_ai_ratio"] = lambda spark, sf: ig.with_ai_ratio(v.scans(spark, sf).drop(
    "ai_ratio")).select("scan_id", F.round(F.col("ai_ratio").cast("double"), 6).alias("ai_ratio"))
SQL["with_ai_ratio"] = f"""WITH {v.WITH_SCANS} SELECT scan_id, round(ai_ratio::DOUBLE, 6) AS ai_ratio
FROM scans"""

# Streaming twins: the same rows, read as a stream and collected in a table ---------------------


def _drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to its end into a table of the shared folder and read that."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/drain-{uuid.uuid4().hex}"
    query = (stream.writeStream.format("parquet").outputMode(mode)
             .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _stream_of(spark, sf, sql: str) -> DataFrame:
    """A view on streams of the driver's tables."""
    import re

    v.apply_settings(spark)
    for name in sorted(set(re.findall(r"\{(\w+)\}", sql))):
        schema = v.load(spark, sf, name).schema
        # A table is one file or a folder of files; a pattern takes either, a stream's plain path only folders.
        (spark.readStream.schema(schema).parquet(f"{sf}/{{{name}}}.parquet")
         .createOrReplaceTempView(f"{name}_stream"))
    return spark.sql(re.sub(r"\{(\w+)\}", r"\1_stream", sql))


def _stream_scan(spark, sf) -> DataFrame:
    """The operator on a stream of texts, with the dedup that needs all findings of a file."""
    corpus = _stream_of(spark, sf, v.DOC_CORPUS).withColumn("file", F.col("path"))
    folder = f"{shared_dir(spark).rstrip('/')}/stream-scan-{uuid.uuid4().hex}"
    options = ScanOptions(dedup="normalized", severity="low")
    writer = st.stream_scan(corpus, rules(spark, [*TEXT_RULES, TEXT_RULES[0]]), folder, options)
    writer.trigger(availableNow=True).start().awaitTermination()
    return flat(st.scanned(spark, folder))


QUERIES["stream_scan"] = _stream_scan
SQL["stream_scan"] = f"""{scored_cte(DOC, TEXT_RULES)}, u AS (SELECT {FLAT_COLS} FROM scored
  WHERE {rank('severity')} >= 2)
{dedup_sql('u')}"""

def _stream_files(spark, sf) -> DataFrame:
    """Three waves of changes: every third text arrives first as a draft, every second one a second time
    unchanged, then the drafts in their last form beside late rows of an older time."""
    corpus = v.doc_corpus(spark, sf)
    folder = f"{shared_dir(spark).rstrip('/')}/stream-files-{uuid.uuid4().hex}"
    third = F.crc32(F.col("path").cast("binary")) % 3 == 0
    draft = corpus.withColumn("content", F.when(third, F.concat(
        F.lit("draft eval( todo the\n"), "content")).otherwise(F.col("content")))
    waves = [draft, draft.where(F.crc32(F.col("path").cast("binary")) % 2 == 0),
             corpus.where(third).withColumn("changed", F.lit(3)).unionByName(corpus.where(third).withColumns(
                 {"content": F.lit("late todo the"), "changed": F.lit(0)}))]
    options = ScanOptions(dedup="normalized", severity="low")
    for i, wave in enumerate(waves, 1):  # a wave has any number of files and is one run of the stream
        if "changed" not in wave.columns:
            wave = wave.withColumn("changed", F.lit(i))
        wave.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(wave.schema).parquet(f"{folder}/in")
        start_files(stream, rules(spark, [*TEXT_RULES, TEXT_RULES[0]]), f"{folder}/out", options,
                    f"files-{uuid.uuid4().hex}", availableNow=True).awaitTermination()
    return flat(last_findings(spark, f"{folder}/out"))


QUERIES["stream_files"] = _stream_files
SQL["stream_files"] = SQL["stream_scan"]

_STREAM_SCANS = """SELECT CAST(event_id % 4000 AS STRING) AS scan_id,
  CAST(ts AS TIMESTAMP) AS timestamp, event_type AS org_id, CAST(user_id % 50 AS INT) AS total_findings,
  CAST(user_id % 3 AS INT) AS critical_count, CAST(user_id % 7 AS INT) AS high_count,
  CAST(user_id % 11 AS INT) AS medium_count, CAST(value AS FLOAT) AS ai_ratio FROM {events}"""


def _stream_trend(spark, sf) -> DataFrame:
    """The closed hours of a trend over events; every event is one scan, every third is sent
    twice."""
    sent = _STREAM_SCANS.replace("event_id % 4000", "event_id")
    rows = _stream_of(spark, sf, f"{sent} UNION ALL {sent} WHERE event_id % 3 = 0")
    out = _drain(st.stream_trend(rows, "1 hour"))
    return with_r6(out.withColumn("hour", F.col("hour").cast("timestamp_ntz")), "ai_ratio")


QUERIES["stream_trend"] = _stream_trend
SQL["stream_trend"] = """WITH s AS (SELECT event_type AS org_id, date_trunc('hour', ts)::TIMESTAMP AS hour,
  user_id, value, ts, (SELECT max(ts) FROM events) AS last FROM events)
SELECT org_id, hour, count(*) AS scans, sum(user_id % 50)::BIGINT AS findings,
  sum(user_id % 3)::BIGINT AS critical, sum(user_id % 7)::BIGINT AS high,
  sum(user_id % 11)::BIGINT AS medium, round(avg(value::REAL::DOUBLE), 6) AS ai_ratio FROM s
WHERE hour + INTERVAL 1 HOUR <= last - INTERVAL 1 HOUR GROUP BY 1, 2"""


def _stream_ingest(spark, sf) -> DataFrame:
    """Payloads of a stream into the two tables, then the current findings."""
    rows = _stream_of(spark, sf, "SELECT l_orderkey, l_linenumber, l_shipdate FROM {lineitem}")
    number = F.col("l_linenumber").cast("string")
    finding = F.struct(F.lit("R").alias("rule_id"), F.lit("HIGH").alias("severity"),
                       F.concat(F.lit("f"), number).alias("file_path"),
                       F.col("l_linenumber").alias("line_number"))
    zero = [F.lit(0).alias(n) for n in ("critical", "high", "medium", "low", "info",
                                        "ai_estimated_count")]
    result = F.struct(F.lit(1).alias("total_findings"), *zero, F.array(finding).alias("findings"))
    payload = F.to_json(F.struct(F.lit("app").alias("repo_name"), F.lit(".").alias("target_path"),
                                 result.alias("scan_result")))
    payloads = rows.select(F.col("l_orderkey").cast("string").alias("scan_id"),
                           F.col("l_shipdate").alias("received_at"), payload.alias("payload"))
    folder = f"{shared_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    writer = st.stream_ingest(payloads, folder, f"ingest-{uuid.uuid4().hex}")
    writer.trigger(availableNow=True).start().awaitTermination()
    st.compact_findings(spark, folder)
    found = st.current_findings(spark, folder)
    return found.select("scan_id", "line_number", "severity", F.col("first_seen").alias("first"),
                        F.col("last_seen").alias("last"), "times_seen")


QUERIES["stream_ingest"] = _stream_ingest
SQL["stream_ingest"] = """SELECT l_orderkey::VARCHAR AS scan_id, l_linenumber AS line_number,
  'high' AS severity, min(l_shipdate) AS first, max(l_shipdate) AS last, count(*) AS times_seen
FROM lineitem GROUP BY 1, 2"""
