"""The tree source: deep and wide branches, dealt again until none is left."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from riskloom.sources.corpus import read_corpus
from riskloom.sources.files import read_texts
from riskloom.sources.rules import load_rules
from riskloom.sources.tree import tree, walked


@pytest.fixture(scope="module")
def deep(tmp_path_factory):
    """All files in one branch, 20 levels deep, 40 directories wide there."""
    root = tmp_path_factory.mktemp("tree")
    branch = root.joinpath(*[f"d{i}" for i in range(20)])
    for i in range(40):
        leaf = branch / f"x{i}" / "y"
        leaf.mkdir(parents=True)
        for j in range(5):
            (leaf / f"f{j}.{'py' if j % 2 else 'txt'}").write_text(f"{i} {j}\n")
    for name in ("node_modules", ".git"):
        (branch / name).mkdir()
        (branch / name / "hidden.py").write_text("no")
    (root / "__init__.py").write_text("")
    return root


@pytest.mark.parametrize("budget", [1, 7, 1000])
def test_every_file_once(spark, deep, budget):
    found = walked(spark, f"file://{deep}", ("node_modules", ".git"), budget)
    names = sorted(r.path for r in found.collect())
    assert names == sorted(str(p) for p in deep.rglob("*") if p.is_file() and p.name != "hidden.py")


def test_filters_are_pushed(spark, deep):
    found = tree(spark, f"file://{deep}").where(F.col("path").endswith(".txt") & (F.col("size") > 0))
    assert found.count() == 40 * 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EndsWith" not in plan.split("BatchScan")[0] or "PushedFilters" in plan
    assert tree(spark, f"file://{deep}").where(F.col("name").isin("f1.py", "f0.txt")).count() == 80


def test_texts_are_dealt_evenly(spark, deep):
    corpus = read_corpus(spark, str(deep), budget=3)
    assert corpus.count() == 81 and corpus.where("language = 'python'").count() == 81
    sizes = [r["count"] for r in corpus.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * median(sizes)
    assert corpus.where("file = '__init__.py' AND content = ''").count() == 1


def test_rules_are_parsed_once(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"r{i}.yaml").write_text(
            f"id: R-{i}\ntitle: t\nlanguages: [python]\npattern:\n  any:\n    - eval(\n")
    rules = load_rules(spark, str(tmp_path))
    (tmp_path / "r0.yaml").unlink()
    assert rules.count() == 3
    plan = rules._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "BatchScan" not in plan


def test_small_texts_leave_a_task_together(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"f{i}").write_bytes(b"\xff" if i == 7 else f"Text {i} é".encode())
    paths = spark.createDataFrame([(str(tmp_path / f"f{i}"),) for i in range(61)], "path string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        texts = read_texts(paths, f"file://{tmp_path}")

        # A table per file was the cost of reading; Spark joins what leaves a worker, so only the plan tells.
        assert "MapInPandas" not in texts._jdf.queryExecution().optimizedPlan().toString()

        def sizes(batches):
            for batch in batches:
                yield batch.from_pydict({"n": [batch.num_rows]})

        assert [r.n for r in texts.mapInArrow(sizes, "n long").collect()] == [59]
        got = {r.path.rsplit("/f")[-1]: r.content for r in texts.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {str(i): f"Text {i} é" for i in range(60) if i != 7}
