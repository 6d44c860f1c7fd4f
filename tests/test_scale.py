"""Inputs in other shapes and sizes than the small tables."""

import json
import os

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from queries import intake, inventory, scanning, views
from queries.views import TABLES
from riskloom.functions import text
from riskloom.operators import packages, routes, statistics
from riskloom.sources.manifests import parse_advisories


def flat_rows(df):
    return sorted(map(str, df.collect()))


def in_folders(spark, sf, folder):
    """The tables of ``sf`` below ``folder``, the documents as a folder of three files."""
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{sf}/{t}.parquet", f"{folder}/{t}.parquet")
    spark.read.parquet(f"{sf}/documents.parquet").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_streams_read_a_table_that_is_a_folder(spark, sf, tmp_path):
    """a folder of part files was skipped, and the stream ended without any findings to read."""
    got = flat_rows(intake.QUERIES["stream_scan"](spark, in_folders(spark, sf, tmp_path)))
    assert got and got == flat_rows(intake.QUERIES["stream_scan"](spark, sf))


def test_code_is_dealt_by_files(spark, sf, monkeypatch):
    """a split of stored bytes was one task, however many files its rows make."""
    monkeypatch.setattr(views, "FILES_PER_TASK", 100)
    files = views.code_corpus(spark, sf)
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    sizes = [s for s in files.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()]
    assert sum(sizes) == n and len(sizes) == -(-n // 100) and max(sizes) <= 200


def test_no_fused_code_beyond_what_the_jvm_compiles(spark, sf):
    """F8: a fused method of over 8,000 bytes stayed interpreted."""
    views.code_corpus(spark, sf)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_a_wave_of_changes_is_written_by_many_tasks(spark, sf, tmp_path, monkeypatch):
    """every wave went through one task into one file."""
    monkeypatch.setattr(intake, "shared_dir", lambda spark: str(tmp_path))
    got = flat_rows(intake.QUERIES["stream_files"](spark, sf))
    assert got == flat_rows(intake.QUERIES["stream_scan"](spark, sf))
    assert len(list(tmp_path.glob("stream-files-*/in/*.parquet"))) > 3


def test_the_sort_of_many_scans_reads_stored_findings(spark, sf, capsys):
    """the sort's sample ran all scans, and the sort ran them again."""
    scanning.QUERIES["scan_many"](spark, sf).explain()
    plan = capsys.readouterr().out
    assert "rangepartitioning" in plan and "documents.parquet" not in plan and "Generate" not in plan


def test_a_manifest_and_an_advisory_are_parsed_once(spark, sf, capsys):
    """TOML was parsed once per branch of its rows, an advisory again in a filter on its fields, and all
    advisories of a small file of rows in one task."""
    inventory.QUERIES["pinned_packages"](spark, sf).explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 2
    known = inventory.advisories(spark, sf)
    assert known.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    known.selectExpr("explode(affected) AS a").explain("extended")
    plan = capsys.readouterr().out
    assert "size(from_json" not in plan[plan.index("Optimized Logical Plan"):]


def test_lines_and_routes_of_a_text_are_cut_once(spark, sf, capsys):
    """a text was split twice, and a route was cut out of its line again for every word looked for."""
    df = spark.createDataFrame([("a\r\nB\n",), ("É\r\r\nZ",), ("",), ("\r\n",), (None,)], "t string")
    got = [r[0] for r in df.select(text.lines_of(text.text_lower("t"))).collect()]
    assert got == [["a", "b"], ["É\r", "z"], [], [""], None]
    df.select(text.lines_of("t").alias("x")).explain("extended")
    plan = capsys.readouterr().out
    assert plan[plan.index("Optimized Logical Plan"):plan.index("Physical Plan")].count("split(") == 1
    routes.unguarded_routes(views.code_corpus(spark, sf)).explain("extended")
    plan = capsys.readouterr().out
    assert plan[plan.index("Optimized Logical Plan"):plan.index("Physical Plan")].lower().count("rlike(") < 10


def test_findings_are_stored_where_they_are_made(spark, sf, tmp_path, monkeypatch):
    """all findings crossed a shuffle before they were written, and all their hashes another one."""
    monkeypatch.setattr(intake, "shared_dir", lambda spark: str(tmp_path))
    df = intake.QUERIES["scan_to_tables"](spark, sf)
    files = [pq.ParquetFile(f) for f in tmp_path.glob("scan-*/findings/*/*.parquet")]
    assert sum(f.metadata.num_rows for f in files) == sum(r["stored"] for r in df.collect()) > 0
    assert len(files) >= spark.sparkContext.defaultParallelism
    assert {f.metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.split("Exchange hashpartitioning(")[1:] if "finding_hash" in x.split(")")[0]]
    assert all("LeftSemi" in x for x in moved)  # only hashes that share their eight bytes


def test_different_values_are_counted_exactly(spark, monkeypatch):
    """values that share their eight bytes are compared; here a digest has three values only."""
    df = spark.range(60).select((F.col("id") % 2).alias("k"), F.when(
        F.col("id") > 5, F.concat(F.lit("v"), (F.col("id") % 22).cast("string"))).alias("v")).unionByName(
            spark.createDataFrame([(None, "x"), (None, "y"), (None, "x"), (3, None)], "k bigint, v string"))
    want = flat_rows(df.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("v").alias("different")))
    assert flat_rows(statistics.count_different(df, ["k"], "v")) == want
    monkeypatch.setattr(statistics, "_digest", lambda c: F.pmod(F.xxhash64(c), F.lit(3)))
    assert flat_rows(statistics.count_different(df, ["k"], "v")) == want


def test_matches_of_a_hot_package_are_made_by_many_tasks(spark, monkeypatch):
    """all rows of a package, manifests times advisories, were made by one task."""
    names = ["hot"] * 300 + ["cold", "cold", "unknown", None]
    rows = [(n, "1.0", "npm", f"m{i}" if i % 9 == 0 else "same") for i, n in enumerate(names)]
    pkgs = spark.createDataFrame(rows, "name string, version string, ecosystem string, manifest_file string")
    known = [("hot", i) for i in range(10)] + [("cold", 10), ("absent", 11), ("hot", 3)]
    df = spark.createDataFrame([(json.dumps({"id": f"A{i}", "affected": [{
        "package": {"name": n, "ecosystem": "npm"}, "versions": ["1.0"]}]}),) for n, i in known], "payload string")
    want = sorted((n, f"A{i}", m) for n, _, _, m in rows for k, i in dict.fromkeys(known) if n == k)
    for most in (20_000_000, 100):
        monkeypatch.setattr(packages, "MATCHES_PER_TASK", most, raising=False)
        found = packages.match_advisories(pkgs, parse_advisories(df))
        assert sorted(found.select("package", "vuln_id", "manifest_file").toArrow().to_pandas().itertuples(
            index=False, name=None)) == want
    sizes = found.rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).collect()
    assert sum(sizes) == 3002 and max(sizes) < 1000
