"""Findings, history, statistics, ingest, packages, reports, sinks and streams."""

import json
import statistics

import pytest
from pyspark.sql import functions as F

from queries import inventory, intake, views
from riskloom import schemas
from riskloom.operators import analytics as an
from riskloom.operators import findings as fd
from riskloom.operators import history as hs
from riskloom.operators import ingest as ig
from riskloom.operators import packages as pk
from riskloom.operators import statistics as st
from riskloom.operators.compliance import enrich_compliance
from riskloom.plans import seed
from riskloom.plans.rollups import read_rollups, refresh_rollups
from riskloom.sinks import documents as doc
from riskloom.sinks import notices as nt
from riskloom.sinks import tables as tb
from riskloom.sources import reports as rp
from riskloom.sources.history import parse_history, read_history
from riskloom.sources.manifests import read_advisories, read_manifests
from riskloom.streaming import streams as sm

BLANK = {"title": "t", "severity": "high", "column": 1, "snippet": "s", "ai_confidence": 50.0,
         "risk_score": 50.0, "category": None, "cwe_id": None, "owasp_category": None, "tags": [],
         "ai_tendency": None, "fix_suggestion": None}


def findings(spark, rows):
    full = [{**BLANK, **r} for r in rows]
    return spark.createDataFrame([tuple(r[n] for n in schemas.FINDING.fieldNames()) for r in full],
                                 schemas.FINDING)


# Findings ------------------------------------------------------------------------------------

def test_dedup_keeps_the_strongest(spark):
    same = {"file": "A.py", "line": 3}
    df = findings(spark, [
        {**same, "id": "R-2", "risk_score": 70.0, "snippet": "a == b;"},
        {**same, "id": "R-1", "risk_score": 70.0, "snippet": "A  ==  B"},
        {**same, "id": "R-3", "risk_score": 60.0, "file": "a.PY", "severity": "critical"},
        {**same, "id": "R-4", "category": "auth"},
        {**same, "id": "R-5", "risk_score": 70.0, "snippet": "a == b", "severity": "low"}])
    got = fd.dedup_findings(df)
    assert sorted(r["id"] for r in got.collect()) == ["R-1", "R-3", "R-4"]
    assert fd.dedup_findings(df, "none").count() == 5


def test_dedup_limits_rows_before_the_shuffle(spark, sf, capsys):
    fd.dedup_findings(views.scanner_findings(spark, sf)).explain("formatted")
    plan = capsys.readouterr().out
    limit = plan.index("WindowGroupLimit")
    assert "Exchange hashpartitioning" not in plan[:limit] and "Partial" in plan


def test_baseline_from_both_formats(spark):
    native = json.dumps({"summary": {}, "findings": [{"file": "A.py", "line": 3, "category": "Auth"},
                                                     {"file": "b.py"}]})
    sarif = json.dumps({"runs": [{"results": [{"ruleId": "x", "locations": [{"physicalLocation": {
        "artifactLocation": {"uri": "C.py"}, "region": {"startLine": 9}}}],
        "properties": {"category": "crypto"}}, {"ruleId": "y"}]}]})
    df = spark.createDataFrame([(native,), (sarif,)], "payload string")
    keys = rp.baseline_rows(df)
    assert sorted(tuple(r) for r in keys.collect()) == [
        ("a.py", 3, "auth"), ("b.py", 1, "uncategorized"), ("c.py", 9, "crypto"),
        ("unknown", 1, "uncategorized")]
    found = findings(spark, [{"id": "1", "file": "a.PY", "line": 3, "category": "AUTH"},
                             {"id": "2", "file": "a.py", "line": 4, "category": "auth"},
                             {"id": "3", "file": "b.py", "line": 1}])
    assert [r["id"] for r in fd.minus_baseline(found, keys).collect()] == ["2"]
    assert sorted(r["id"] for r in fd.in_baseline(found, keys).collect()) == ["1", "3"]


def test_enrichment_order(spark):
    df = findings(spark, [
        {"id": "X-INJ-1", "file": "a", "line": 1, "tags": ["odd", " Secrets ", "cors"]},
        {"id": "X-INJ-1", "file": "b", "line": 1, "category": "Auth"},
        {"id": "x-misc-1", "file": "c", "line": 1},
        {"id": "X", "file": "d", "line": 1},
        {"id": "X", "file": "e", "line": 1, "cwe_id": "CWE-1", "tags": ["debug"]}])
    got = {r["file"]: (r["cwe_id"], (r["owasp_category"] or "")[:3]) for r in
           enrich_compliance(df).collect()}
    assert got == {"a": ("CWE-798", "A07"), "b": ("CWE-287", "A07"), "c": ("CWE-16", "A05"),
                   "d": (None, ""), "e": ("CWE-1", "A05")}


def test_small_summaries(spark):
    df = findings(spark, [{"id": i, "file": f"f{n}", "line": n, "severity": s} for n, (i, s) in
                          enumerate([("B", "high"), ("A", "low"), ("B", "high"), ("A", "critical")])])
    assert fd.mode_rule(df, "largest").first()["top_rule"] == "B"
    assert fd.mode_rule(df, "smallest").first()["top_rule"] == "A"
    g = fd.grade(df).first()
    assert (g["score"], g["grade"], g["color"]) == (54, "C", "yellow")
    assert fd.by_severity_map(df).first()["by_severity"] == {
        "critical": 1, "high": 2, "medium": 0, "low": 1, "info": 0}
    assert fd.should_fail(df).first()["fail"] is True
    assert fd.should_fail(df.limit(0)).first()["fail"] is False
    empty = fd.review_summary(df.limit(0)).first()
    assert (empty["total"], empty["avg_ai_confidence"], empty["ai_generated_pct"]) == (0, 0.0, 0)


# History -------------------------------------------------------------------------------------

LOG = ["1700000000|repo-a|8|1|2|3|1|1|2|PY-CRYPTO-001", "1700003600|repo-b|5|0|3|1|1|0|1|JS-INJ-001",
       "1700086400|repo-a|4|0|2|1|1|0|1|PY-CRYPTO-001", "bad|line", "1|a|x|1|1|1|1|1|1|R", ""]


def test_history(spark, tmp_path):
    (tmp_path / "log").write_text("\n".join(LOG))
    rows = read_history(spark, str(tmp_path / "log"))
    s = hs.history_summary(rows).first()
    assert (s["scans"], s["findings"], s["high_or_above"], s["ai_estimated"],
            s["avg_findings_per_scan"], s["ai_ratio"]) == (3, 17, 8, 4, 5.67, 0.2353)
    series = hs.history_series(rows).collect()
    assert [(r["day"], r["findings"]) for r in series] == [("2023-11-14", 13), ("2023-11-15", 4)]
    assert tuple(hs.history_top_rules(rows, 1).first()) == ("PY-CRYPTO-001", 2)
    t = hs.history_top_targets(rows, 2).first()
    assert (t["target"], t["findings"], t["scans"]) == ("repo-a", 12, 2)
    assert hs.history_window(rows, 1700086400, 1).count() == 3
    assert hs.history_window(rows, 1700086401, 1).count() == 2
    d = hs.history_dashboard(rows, 1700086400 + 40000, 1).first()
    assert (d["scans"], d["previous_window_scans"], d["scans_delta_pct"]) == (1, 2, -50.0)
    with pytest.raises(ValueError):
        hs.parse_days("0d")
    assert hs.parse_days(" 30D ") == 30


def test_history_round_trip(spark, tmp_path):
    line = "1700000000|repo%7Capi%252Fv1|10|1|3|4|1|1|2|R%25"
    rows = parse_history(spark.createDataFrame([(line,)], "value string"))
    assert rows.first()["target"] == "repo|api%2Fv1" and rows.first()["top_rule"] == "R%"
    tb.write_history(rows, str(tmp_path / "h"))
    tb.write_history(rows, str(tmp_path / "h"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "h")).collect()] == [line, line]


# Statistics ----------------------------------------------------------------------------------

def test_quantiles_against_python(spark):
    values = [float((i * 7919) % 1009) / 8 for i in range(3000)]
    values += [5.0] * 2000  # one value holds a large part of all rows
    df = spark.createDataFrame([("a" if i % 3 else "b", v) for i, v in enumerate(values)],
                               "k string, v double")
    got = {r["k"]: r for r in st.sample_stats(df, "v", ("k",)).collect()}
    for key in "ab":
        mine = [v for i, v in enumerate(values) if ("a" if i % 3 else "b") == key]
        cuts = statistics.quantiles(mine, n=100, method="inclusive")
        r = got[key]
        assert r["min"] == min(mine) and r["max"] == max(mine)
        assert r["median"] == pytest.approx(statistics.median(mine))
        assert r["p95"] == pytest.approx(cuts[94])
        assert r["stddev"] == pytest.approx(statistics.pstdev(mine))
    small = spark.createDataFrame([(x,) for x in (10.0, 20.0, 30.0, 40.0)], "v double")
    assert st.sample_stats(small, "v").first()["p95"] == pytest.approx(38.5)
    assert st.nearest_rank(small, "v", 0.95).first()["value"] == 40.0
    assert st.nearest_rank(small, "v", 0.5).first()["value"] == 20.0


def test_gates(spark):
    row = spark.createDataFrame([(2.5, 900.0, None, 60.0)], "error_rate_pct double, summary_p95_ms "
                                "double, compliance_p95_ms double, coverage_pct double")
    limits = dict(max_error_rate_pct=1.0, max_summary_p95_ms=1500.0, max_compliance_p95_ms=1500.0,
                  min_coverage_pct=70.0)
    got = [r[0] for r in st.evaluate_gates(row, **limits).collect()]
    assert got == ["error_rate_pct 2.50% > max_error_rate_pct 1.00%",
                   "compliance_p95_ms is unavailable (no successful compliance probe)",
                   "coverage_pct 60.00% < min_coverage_pct 70.00%"]
    assert st.evaluate_gates(row, **limits, missing="skip").count() == 2
    assert st.evaluate_gates(row).count() == 0


# Ingest --------------------------------------------------------------------------------------

def payload(**over):
    result = {"total_findings": 2, "critical": 0, "high": 1, "medium": 1, "low": 0, "info": 0,
              "ai_estimated_count": 1, "findings": [
                  {"rule_id": "R", "severity": "High", "file_path": "a.py", "line_number": 3,
                   "ai_confidence": 87.5, "cwe_id": " "},
                  {"rule_id": "R", "severity": "high", "file_path": "a.py", "line_number": 3,
                   "ai_confidence": 0.5}]}
    return json.dumps({"repo_name": "app", "target_path": ".", "repo_id": "h/o/app",
                       "scan_result": result, **over})


def test_ingest_upsert_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(payload(),), (payload(repo_name=None),), ("{bad",)], "payload string")
    df = df.withColumn("received_at", F.lit("2025-01-02 03:04:05").cast("timestamp"))
    out = ig.ingest(df)
    scan = out.scans.first()
    assert out.scans.count() == 1 and out.rejects.count() == 2
    assert scan["ai_ratio"] == 0.5 and str(scan["scan_date"]) == "2025-01-02"
    assert len(scan["scan_id"]) == 36
    rows = out.findings.collect()
    assert [r["severity"] for r in rows] == ["high", "high"] and rows[0]["cwe_id"] is None
    assert sorted(r["ai_confidence"] for r in rows) == [0.5, 0.875]
    folded = ig.upsert_findings(out.findings.limit(0), out.findings)
    assert [r["times_seen"] for r in folded.collect()] == [2]
    later = folded.withColumn("last_seen", F.lit("2025-02-01").cast("timestamp")).withColumn(
        "times_seen", F.lit(1).cast("bigint")).withColumn("severity", F.lit("low"))
    again = ig.upsert_findings(folded, later).first()
    assert (again["times_seen"], again["severity"], str(again["last_seen"])[:10]) == (
        3, "high", "2025-02-01")
    tb.write_tables(out.scans, out.findings, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "scans")).where("scan_date = '2025-01-02'").count() == 1
    assert spark.read.parquet(str(tmp_path / "t" / "findings")).count() == 2


def test_an_upsert_moves_folded_rows_once(spark):
    rows = spark.range(400).select(
        F.when(F.col("id") % 20 > 0, (F.col("id") % 20).cast("string")).alias("scan_id"),
        (F.col("id") % 7).cast("string").alias("finding_hash"), F.col("id").cast("string").alias("rule_id"),
        F.timestamp_seconds(F.col("id")).alias("first_seen"), F.timestamp_seconds(F.col("id")).alias("last_seen"),
        F.lit(1).cast("bigint").alias("times_seen"))
    old, new = rows.where("rule_id % 3 > 0"), rows.where("rule_id % 3 = 0").drop("rule_id")
    out = ig.upsert_findings(ig.upsert_findings(old.limit(0), old), new)
    got = {(r["scan_id"], r["finding_hash"]): (r["rule_id"], r["times_seen"]) for r in out.collect()}
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (int(r["rule_id"]) % 3 == 0, int(r["rule_id"]))):
        key = r["scan_id"], r["finding_hash"]
        held = r["rule_id"] if int(r["rule_id"]) % 3 else None
        want[key] = (want[key][0], want[key][1] + 1) if key in want else (held, 1)
    assert got == want and any(k[0] is None for k in got)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("Union")]


def test_reports_are_parsed_once(spark):
    rows = spark.createDataFrame([('{"findings": [{"id": "A"}], "runs": []}', 1), ("{bad", 1), (None, 1)],
                                 "payload string, k int").withColumn("payload", F.upper("payload")).where("k > 0")
    for found in (rp.report_findings(rows), rp.sarif_results(rows),
                  *(rp.external_findings(rows, e) for e in ("semgrep", "bandit", "eslint"))):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_validation(spark):
    seeded = seed.seed_findings(seed.seed_scans(spark, 20))
    ok, bad = ig.validate(ig.check_findings(seeded.dropDuplicates(["scan_id", "finding_hash"])))
    assert ok.count() > 0 and bad.count() == 0
    twice = seeded.limit(1).unionAll(seeded.limit(1).withColumn(
        "first_seen", F.col("first_seen") + F.expr("interval 1 day")))
    bad = ig.validate(ig.check_findings(twice))[1].collect()
    assert [r["violations"] for r in bad] == [["unique_per_scan"]]


def test_seeds_are_stable(spark):
    first = seed.seed_scans(spark, 100).orderBy("scan_id").collect()
    assert first == seed.seed_scans(spark, 100).repartition(7).orderBy("scan_id").collect()
    ok, bad = ig.validate(ig.check_scans(seed.seed_scans(spark, 100)))
    assert ok.count() == 100 and bad.count() == 0
    per = seed.seed_findings(seed.seed_scans(spark, 50)).groupBy("scan_id").count().agg(
        F.min("count").alias("lo"), F.max("count").alias("hi")).first()
    assert per["lo"] >= 3 and per["hi"] <= 10
    history = seed.seed_history(spark, 10, 2)
    assert history.count() == 20 and hs.history_stats(history).first()["scans"] == 20


def test_a_partial_refresh_keeps_every_other_row(spark, tmp_path):
    from datetime import date, timedelta

    scans = seed.seed_scans(spark, 400)
    found = seed.seed_findings(scans)
    path = str(tmp_path / "roll")
    refresh_rollups(found, scans, "2025-02-01", path)

    def state():
        return {n: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r])
                          for r in df.select(sorted(df.columns)).collect())
                for n, df in read_rollups(spark, path).items()}

    whole = state()
    days = [r[0] for r in scans.select(F.to_date("timestamp")).distinct().collect()]
    spread = max(days)
    # the last days of a month, then a week that reaches into the next month
    month_end = spread.replace(day=1) - timedelta(1)
    for first, last in ((spread - timedelta(2), spread), (month_end, month_end),
                        (date(2000, 1, 1), date(2000, 1, 2))):
        refresh_rollups(found, scans, "2025-02-01", path, first, last)
        assert state() == whole
    # scans that came later change their own weeks and nothing else
    more = scans.limit(5).withColumn("scan_id", F.concat(F.lit("x"), F.col("scan_id").cast("string")))
    grown = scans.withColumn("scan_id", F.col("scan_id").cast("string")).unionByName(more)
    at = more.agg(F.min(F.to_date("timestamp")), F.max(F.to_date("timestamp"))).first()
    refresh_rollups(found, grown, "2025-02-01", path, at[0], at[1])
    partial = state()
    refresh_rollups(found, grown, "2025-02-01", path)
    assert partial == state() and partial != whole


def test_a_refresh_computes_its_scans_once(spark, tmp_path):
    from datetime import date

    scans = seed.seed_scans(spark, 60)
    found = seed.seed_findings(scans)
    rows = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(n):
        rows.add(1)
        return n

    counted_scans = scans.withColumn("total_findings", counted("total_findings"))
    refresh_rollups(found, counted_scans, "2025-02-01", str(tmp_path / "roll"))
    assert rows.value == 60
    refresh_rollups(found, counted_scans, "2025-02-01", str(tmp_path / "roll"), date(2000, 1, 1),
                    date(2030, 1, 1))
    assert rows.value == 120


def test_windows_prune_both_tables(spark, tmp_path):
    scans = seed.seed_scans(spark, 60)
    scans = scans.withColumn("scan_date", F.to_date("timestamp"))
    path = str(tmp_path / "tables")
    tb.write_tables(scans, seed.seed_findings(scans), path)
    stored_scans, stored_found = (spark.read.parquet(f"{path}/{t}") for t in ("scans", "findings"))
    as_of = str(scans.agg(F.max("timestamp")).first()[0])
    df = an.top_rules(stored_found, stored_scans, as_of, 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = [x for x in plan.split("PartitionFilters: [")[1:]]
    assert len(filters) >= 2 and all("scan_date >=" in x or "scan_date#" in x.split("]")[0] for x in filters)
    want = an.top_rules(seed.seed_findings(scans), scans.drop("scan_date"), as_of, 3)
    assert df.collect() == want.collect()
    window = an.window_days(stored_scans, as_of, 20, 15)._jdf.queryExecution().executedPlan()
    part = window.toString().split("PartitionFilters: [")[1].split("]")[0]
    assert ">=" in part and "<=" in part


def test_pages(spark):
    scans = seed.seed_scans(spark, 25).withColumn("commit_sha", F.lit("c"))
    first = an.list_scans(scans, 10).collect()
    rest = an.list_scans(scans, 10, after=(str(first[-1]["scanned_at"]), first[-1]["scan_id"]))
    assert rest.collect() == an.list_scans(scans, 10, 10).collect()
    with pytest.raises(ValueError):
        an.list_scans(scans, 1001)


# A third of all findings in one scan: same totals for any number of partitions ----------------

def test_hot_scan(spark):
    scans = seed.seed_scans(spark, 30)
    hot = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "7").otherwise((F.col("id") % 30).cast("string")).alias("scan_id"),
        F.lit("R").alias("rule_id"), F.lit("T").alias("rule_title"), F.lit("high").alias("severity"),
        F.concat(F.lit("f"), (F.col("id") % 5).cast("string")).alias("file_path"),
        F.lit(0.5).cast("float").alias("ai_confidence"), F.lit("CWE-1").alias("cwe_id"),
        F.lit("").alias("owasp_category"))
    a = an.top_rules(hot, scans, "2025-02-01", 365).collect()
    b = an.top_rules(hot.repartition(9), scans.repartition(3), "2025-02-01", 365).collect()
    assert a == b and a[0]["count"] == 3000
    daily = an.top_rules_daily(hot, scans).agg(F.sum("total_occurrences")).first()[0]
    assert daily == 3000


def test_windows_read_only_their_days(spark, tmp_path, capsys):
    scans = seed.seed_scans(spark, 80).withColumn("scan_date", F.to_date("timestamp"))
    tb.write_by_date(scans, str(tmp_path / "scans"))
    stored = spark.read.parquet(str(tmp_path / "scans"))
    recent = an.org_rollup(stored, "2025-01-31", 5)
    recent.explain("formatted")
    assert "PartitionFilters: [isnotnull(scan_date" in capsys.readouterr().out
    want = an.org_rollup(scans.drop("scan_date"), "2025-01-31", 5)
    key = lambda rows: sorted((r["org_id"], r["scans"], r["findings"]) for r in rows)
    assert key(recent.collect()) == key(want.collect())


# Packages ------------------------------------------------------------------------------------

def test_manifest_tree(spark, tmp_path):
    texts = inventory.TEXTS
    for folder in ("app", "node_modules/x", "lib/target/y"):
        for name, text in texts.items():
            path = tmp_path / folder / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text.replace("<c>", "1").replace("<a>", "2").replace("<b>", "3").replace(
                "<bad>", ""))
    manifests = read_manifests(spark, str(tmp_path))
    assert sorted({r["manifest_file"] for r in manifests.collect()}) == sorted(
        f"app/{n}" for n in inventory.DECLARED)
    fill = lambda x: x.replace("<c>", "1").replace("<a>", "2").replace("<b>", "3")
    got = sorted((r["name"], r["version"], r["manifest_file"]) for r in pk.packages(manifests).collect())
    assert got == sorted((fill(n), fill(x), f"app/{k}") for k, rows in inventory.DECLARED.items()
                         for n, x in rows)


def test_version_order(spark):
    order = ["1.0.dev3", "1.0-alpha", "1.0-alpha.1", "1.0-alpha.beta", "1.0-beta.2", "1.0-beta.11",
             "1.0-rc1", "1.0-rc2", "1.0", "1.0.post1", "1.0.1", "1.0.2", "1.0.2k", "1.2",
             "1.2.3.4.5.6.7.8.1", "1.2.3.4.5.6.7.8.9", "1.2.3.4.5.6.7.8.10", "1.10", "v2.0", "10.0",
             "10.1000000000000000000000001", "10.1000000000000000000000002"]
    df = spark.createDataFrame([(x,) for x in reversed(order)], "v string")
    got = df.orderBy(pk.version_key(F.col("v"))).collect()
    assert [r["v"] for r in got] == order
    same = [("1.0", "1.0.0"), ("v1.2", "1.2+build5"), ("1.0.Final", "1"), ("2.0a1", "2.0-alpha.1"),
            ("01.2", "1.02"), ("1.0c1", "1.0rc1")]
    pairs = spark.createDataFrame(same, "a string, b string")
    assert pairs.where(pk.version_key(F.col("a")) == pk.version_key(F.col("b"))).count() == len(same)
    assert spark.range(1).select(pk.version_key(F.lit(None).cast("string")).isNull()).first()[0]


def test_advisories(spark, tmp_path):
    adv = {"id": "A-1", "summary": "s", "severity": [{"score": "CVSS:3.1/x"}, {"score": "9.8"}],
           "affected": [{"package": {"name": "left", "ecosystem": "npm"}, "ranges": [{"events": [
               {"introduced": "0"}, {"fixed": "1.2.0"}, {"introduced": "2.0.0"},
               {"last_affected": "2.1.0"}]}]}]}
    (tmp_path / "adv.json").write_text(json.dumps(adv))
    table = read_advisories(spark, str(tmp_path / "adv.json"))
    versions = ["1.1.9", "1.2.0", "1.9", "2.0.0", "2.1.0", "2.1.1"]
    pkgs = spark.createDataFrame([("left", x, "npm", "package.json") for x in versions], schemas.PACKAGE)
    got = pk.match_advisories(pkgs, table).collect()
    assert sorted(r["version"] for r in got) == ["1.1.9", "2.0.0", "2.1.0"]
    assert {(r["severity"], r["fixed_version"]) for r in got} == {("CRITICAL", "1.2.0")}


# Reports -------------------------------------------------------------------------------------

def test_report_summaries(spark):
    full = {"summary": {"total": 7, "ai_estimated": 2, "top_pattern": "X", "by_severity": {
        "critical": 1, "high": 2, "medium": 3, "low": 1, "info": 0}}, "findings": []}
    sarif = {"runs": [{"results": [
        {"ruleId": "A", "level": "error", "properties": {"aiConfidence": 90}},
        {"ruleId": "A", "level": "warning", "properties": {"aiConfidence": 30}},
        {"ruleId": "B", "level": "note", "properties": {"aiConfidence": 80}}]}]}
    df = spark.createDataFrame([(1, json.dumps(full)), (2, json.dumps(sarif)), (3, "[]")],
                               "i int, payload string")
    got = {r["i"]: tuple(r)[1:] for r in rp.summarize_report(df).collect()}
    assert got == {1: (7, 1, 2, 3, 1, 0, 2, "X"), 2: (3, 0, 1, 1, 1, 0, 2, "A")}


def texts(rows):
    """The documents of all targets, put together in the order of the rows."""
    out = {}
    for r in rows.collect():
        out[r["target"]] = out.get(r["target"], "") + r["value"]
    return out


def test_documents_hold_every_finding(spark):
    df = findings(spark, [{"id": f"R{i % 7}", "file": f"f{i}.py", "line": i + 1, "title": "q\"\x01",
                           "risk_score": float(i % 90)} for i in range(250)])
    p = json.loads(texts(doc.report_json(df, 9, 3))[""])
    assert len(p["findings"]) == 250
    assert p["summary"]["total"] == 250 and p["summary"]["by_severity"]["high"] == 250
    risks = [f["risk_score"] for f in p["findings"]]
    assert risks == sorted(risks, reverse=True)
    assert p["findings"][0]["title"] == 'q" '
    run = json.loads(texts(doc.report_sarif(df))[""])["runs"][0]
    assert len(run["results"]) == 250 and len(run["tool"]["driver"]["rules"]) == 7
    assert run["results"][0]["level"] == "error"
    empty = json.loads(texts(doc.report_json(df.limit(0)))[""])
    assert empty["findings"] == [] and empty["summary"]["top_pattern"] == "none"
    assert json.loads(texts(doc.report_sarif(df.limit(0)))[""])["runs"][0]["results"] == []


def test_documents_per_target(spark, tmp_path):
    df = findings(spark, [{"id": f"R{i % 3}", "file": f"f{i % 4}.py", "line": 1,
                           "risk_score": float(i % 5)} for i in range(60)]).withColumn(
        "target", F.when(F.col("file") == "f1.py", "b").otherwise("a"))
    asked = spark.createDataFrame([("none",), ("a",)], "target string")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        rows = doc.report_json(df, by="target", targets=asked)
        found = {t: json.loads(x) for t, x in texts(rows).items()}
        assert {t: p["summary"]["total"] for t, p in found.items()} == {"a": 45, "b": 15, "none": 0}
        assert {f["file"] for f in found["b"]["findings"]} == {"f1.py"}
        assert len(found["a"]["findings"]) == 45  # equal findings are all there
        sarif = {t: json.loads(x)["runs"][0] for t, x in texts(doc.report_sarif(df, by="target")).items()}
        assert {t: len(r["results"]) for t, r in sarif.items()} == {"a": 45, "b": 15}
        doc.write_documents(rows, str(tmp_path / "reports"))
        for target, p in found.items():
            parts = sorted((tmp_path / "reports" / f"target={target}").glob("part-*"))
            assert json.loads("".join(x.read_text() for x in parts)) == p
        alerts = {json.loads(r[0])["target"]: json.loads(r[0])["summary"]["alert_findings"]
                  for r in nt.alert_payload(df, "low", by="target").collect()}
        assert alerts == {"a": 45, "b": 15}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_document_rows_are_the_array_form(spark):
    df = findings(spark, [{"id": f"R{i}", "file": "a.py", "line": i % 4} for i in range(12)] * 2)
    entry = doc.entries_of(doc.report_json(df), 1)
    ordered = [r.entry for r in entry.collect()]
    assert texts(doc.report_json(df))[""].endswith('"findings":[' + ",".join(ordered) + "]}")
    assert len(ordered) == 24


def test_report_files(spark, tmp_path):
    native = {"summary": {}, "findings": [{"id": "A", "severity": "high"}]}
    (tmp_path / "a.json").write_text(json.dumps(native, indent=1))
    (tmp_path / "s.sarif").write_text(json.dumps({"runs": [{"results": [{"ruleId": "S"}]}]}, indent=1))
    (tmp_path / "e.json").write_text(json.dumps([{"filePath": "x.js", "messages": [
        {"ruleId": "no-eval", "message": "m", "line": 2, "column": 5, "severity": 2}]}], indent=1))
    one = rp.read_report_json(spark, str(tmp_path / "a.json")).first()
    assert (one["id"], one["file"], one["line"]) == ("A", "unknown", 1)
    assert rp.read_sarif(spark, str(tmp_path / "s.sarif")).first()["id"] == "S"
    e = rp.read_external(spark, str(tmp_path / "e.json"), "eslint").first()
    assert (e["id"], e["severity"], e["risk_score"], e["line"]) == ("SAST-ESLINT-NO_EVAL", "high", 80.0, 2)


def test_annotations_and_alert(spark):
    df = findings(spark, [{"id": "R", "file": "a:b.py", "line": i, "severity": "medium",
                           "risk_score": 10.0 + i} for i in range(1, 4)])
    lines = [r[0] for r in nt.report_annotations(df, 2).collect()]
    assert lines[0] == ("::warning file=a%3Ab.py,line=3,col=1,title=[R] t::"
                        "t (AI confidence 50.0%25, risk 13.0)")
    assert [r[0] for r in nt.annotation_trailer(df, limit=2).collect()] == [
        "::notice::truncated annotations to first 2 findings (of 3).",
        "summary: total=3 dedup_mode=normalized original_total=3 deduped_total=3"]
    assert nt.annotation_trailer(df.limit(0)).first()[0] == "No vulnerabilities detected."
    assert nt.alert_payload(df, "high").count() == 0
    alert = json.loads(nt.alert_payload(df, "medium", "src").first()[0])
    assert alert["summary"]["alert_findings"] == 3 and alert["top_findings"][0]["line"] == 3


def test_compliance_csv(spark, tmp_path):
    scans = seed.seed_scans(spark, 40)
    found = seed.seed_findings(scans).withColumns({"cwe_id": F.lit("CWE-1"), "owasp_category": F.lit("")})
    report = an.compliance_report(found, scans, "acme", "2025-01-01", "2025-01-31")
    tb.write_compliance_csv(report, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert back.columns == list(tb.COMPLIANCE_COLUMNS) and back.count() == report.count() > 0
    dates = [r["Scan Date"] for r in back.collect()]
    assert dates == sorted(dates, reverse=True)


def test_stored_tables_have_an_owner(spark):
    import os

    from riskloom.session import release, scratch, shared_dir, stored
    df = stored(spark.range(5).withColumn("k", F.col("id") % 2), by="k")
    folder = os.path.dirname(scratch(spark))
    assert df.count() == 5 and len(os.listdir(folder)) >= 1
    assert folder.startswith(shared_dir(spark)) and shared_dir(spark) == shared_dir(spark)
    release(spark)
    assert not os.path.exists(folder)


# Streams -------------------------------------------------------------------------------------

def test_stream_trend_equals_the_batch(spark, tmp_path):
    scans = seed.seed_scans(spark, 300, "2025-01-31")
    scans.unionAll(scans.limit(40)).write.parquet(str(tmp_path / "in"))  # forty scans come twice
    stream = spark.readStream.schema(scans.schema).parquet(str(tmp_path / "in"))
    query = (sm.stream_trend(stream).writeStream.format("memory").queryName("trend")
             .outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    got = {(r["org_id"], r["hour"]): (r["scans"], r["findings"]) for r in
           spark.table("trend").collect()}
    batch = {(r["org_id"], r["hour"]): (r["scans"], r["findings"]) for r in
             an.trend_hourly(scans, "2025-02-01", 60).collect()}
    assert got and all(batch[k] == x for k, x in got.items())
    assert len(got) >= len(batch) - 6  # only hours the watermark has not passed are missing


def test_stream_ingest_survives_a_repeated_batch(spark, tmp_path):
    df = spark.createDataFrame([(payload(),)], "payload string").withColumn(
        "received_at", F.lit("2025-01-02").cast("timestamp"))
    write = sm.ingest_writer(str(tmp_path / "t"))
    for batch in (0, 0, 1):
        write(df, batch)
    assert spark.read.parquet(str(tmp_path / "t" / "scans")).count() == 2
    assert [r["times_seen"] for r in sm.current_findings(spark, str(tmp_path / "t")).collect()] == [4]


def test_ingest_starts_again_and_compacts(spark, tmp_path):
    def drop():
        spark.createDataFrame([(payload(),)], "payload string").withColumn(
            "received_at", F.lit("2025-01-02").cast("timestamp")).write.mode("append").parquet(
                str(tmp_path / "in"))

    def run(out):
        rows = spark.readStream.schema("payload string, received_at timestamp").parquet(
            str(tmp_path / "in"))
        sm.stream_ingest(rows, out, "run").trigger(availableNow=True).start().awaitTermination()
        return [r["times_seen"] for r in sm.current_findings(spark, out).collect()]

    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    drop()
    first = run(one)
    assert run(one) == first and run(two) == first  # two outputs share no checkpoint
    sm.compact_findings(spark, one)
    assert run(one) == first
    drop()
    assert run(one) == [2 * n for n in first]
    sm.compact_findings(spark, one)
    sm.compact_findings(spark, one)
    assert run(one) == [2 * n for n in first]
    # a lost checkpoint starts a new run beside the old one and overwrites nothing
    import shutil
    shutil.rmtree(f"{one}/_checkpoint")
    assert run(one) == [4 * n for n in first]


def test_a_compaction_is_read_as_it_is(spark, tmp_path):
    df = spark.createDataFrame([(payload(),)], "payload string").withColumn(
        "received_at", F.lit("2025-01-02").cast("timestamp"))
    path = str(tmp_path / "t")
    write = sm.ingest_writer(path)
    write(df, 0)
    want = sm.current_findings(spark, path).collect()
    sm.compact_findings(spark, path)
    now = sm.current_findings(spark, path)
    assert [r.asDict() for r in now.collect()] == [r.asDict() for r in want]
    assert "Aggregate" not in now._jdf.queryExecution().executedPlan().toString()
    write(df, 1)
    assert [r["times_seen"] for r in sm.current_findings(spark, path).collect()] == [4]


def test_stream_scan_with_every_option(spark, sf):
    from queries.rulebook import TEXT_RULES, rules
    from queries.scanning import flat
    from riskloom.plans.scan import ScanOptions, scan
    batch = sorted(map(str, intake.QUERIES["stream_scan"](spark, sf).collect()))
    want = flat(scan(views.doc_corpus(spark, sf), rules(spark, [*TEXT_RULES, TEXT_RULES[0]]),
                     ScanOptions(dedup="normalized", severity="low")))
    assert batch and batch == sorted(map(str, want.collect()))
