"""Any model through one call, and streams with a state per file."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import model as md
from riskloom.plans.scan import ScanOptions, scan
from riskloom.sources.rules import rules_from_rows
from riskloom.streaming.files import changed_files, last_findings, start_files, PROVIDER, STORE


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = [(i, float(a), float(b), float(c), int(a + c / 9 > 0.6)) for i, (a, b, c) in enumerate(zip(
        rng.random(400), rng.random(400) * 90, rng.integers(0, 8, 400)))]
    return spark.createDataFrame(
        data, "doc_id long, comment_density double, mean_line_length double, keyword_score double, "
              "label long")


def test_a_forest_is_a_loader(rows):
    model = md.train_classifier(rows.where("doc_id % 2 = 0"))
    unseen = rows.where("doc_id % 2 = 1")
    want = {r.doc_id: r.model_score for r in md.model_probability(unseen, model).collect()}
    got = {r.doc_id: r.model_score for r in md.with_model(unseen, md.forest_loader(model)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    right = sum((got[r.doc_id] >= 0.5) == bool(r.label) for r in unseen.collect())
    assert right > 0.85 * len(got)


def test_any_model_and_nulls(spark, rows):
    def load():
        seen = []
        def score(matrix):
            seen.append(len(matrix))
            assert matrix.shape[1] == 2 and len(matrix) <= 4096
            return matrix[:, 0] + matrix[:, 1]
        return score

    two = md.Manifest(("comment_density", "keyword_score"))
    some = rows.withColumn("keyword_score", F.when(F.col("doc_id") != 3, F.col("keyword_score")))
    got = {r.doc_id: r for r in md.with_model(some, load, two).collect()}
    assert got[3].model_score is None
    assert got[4].model_score == pytest.approx(got[4].comment_density + got[4].keyword_score, rel=1e-6)


def test_manifest(spark, tmp_path):
    path = tmp_path / "model.json"
    path.write_text(json.dumps({"profile": "aggressive", "calibration": {"bias": 0.1}}, indent=1))
    m = md.read_manifest(spark, str(path))
    assert (m.profile, m.calibration, list(m.features)) == ("aggressive", {"bias": 0.1}, md.FEATURES)
    path.write_text(json.dumps({"profile": "bold"}))
    with pytest.raises(ValueError):
        md.read_manifest(spark, str(path))


FILE = "path string, file string, language string, content string, changed long"


def _wave(spark, folder, rows):
    spark.createDataFrame([(p, p, "python", c, t) for p, c, t in rows], FILE).coalesce(1).write.mode(
        "append").parquet(str(folder))


def test_changed_content_alone_is_scanned(spark, tmp_path):
    text = "x = 'lorem'\n# todo the and\n"
    _wave(spark, tmp_path / "in", [("a.py", "the todo\n", 1), ("b.py", text, 1), ("c.py", None, 1)])
    _wave(spark, tmp_path / "in", [("a.py", "the todo\n", 2), ("a.py", text, 3), ("a.py", "old", 0)])
    _wave(spark, tmp_path / "in", [("b.py", text, 4), ("c.py", None, 5), ("a.py", text, 6)])
    stream = spark.readStream.schema(FILE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    needles = rules_from_rows(spark, [
        {"id": f"T-{w}", "title": w, "languages": ["python"], "pattern_any": [w]} for w in ("todo", "lorem")])
    out = str(tmp_path / "out")
    start_files(stream, needles, out, ScanOptions(dedup="normalized"), "per-file",
                availableNow=True).awaitTermination()
    versions = sorted((r.path, r.changed) for r in spark.read.parquet(f"{out}/versions").collect())
    assert versions == [("a.py", 1), ("a.py", 3), ("b.py", 1), ("c.py", 1)]
    last = spark.createDataFrame([("a.py", "a.py", "python", text), ("b.py", "b.py", "python", text)],
                                 "path string, file string, language string, content string")
    want = scan(last, needles, ScanOptions(dedup="normalized"), ordered=False)
    assert sorted(map(str, last_findings(spark, out).select(*want.columns).collect())) == sorted(
        map(str, want.collect())) != []


def test_a_file_waits_for_quiet(spark, tmp_path):
    spark.conf.set(PROVIDER, STORE)
    try:
        folder = tmp_path / "in"
        _wave(spark, folder, [("a.py", "one", 1), ("b.py", "b", 1)])
        stream = spark.readStream.schema(FILE).parquet(str(folder))
        query = (changed_files(stream, 15_000).writeStream.format("memory").queryName("quiet")
                 .outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
                 .trigger(processingTime="500 milliseconds").start())
        def until(done):
            end = time.time() + 40
            while not done() and time.time() < end:
                time.sleep(0.3)

        # a stream with timers is never idle, so its progress is asked instead
        read = lambda: sum(p.numInputRows for p in query.recentProgress)
        until(lambda: read() >= 2)
        assert spark.table("quiet").count() == 0
        _wave(spark, folder, [("a.py", "two", 2)])
        until(lambda: spark.table("quiet").count() >= 2)
        query.stop()
        assert sorted((r.path, r.content) for r in spark.table("quiet").collect()) == [
            ("a.py", "two"), ("b.py", "b")]
    finally:
        spark.conf.unset(PROVIDER)
