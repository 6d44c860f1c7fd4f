"""Search by trigrams against the scan form, and the files that a rare word leaves."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators.findings import search
from riskloom.operators.searchindex import files_of, indexed_search, trigrams, write_searchable


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("search"))
    n = F.col("id")
    rows = spark.range(3000).select(
        F.concat(F.lit("RULE-"), (n % 40).cast("string")).alias("id"),
        F.when(n == 77, "Überraschung im Log").otherwise(F.concat(F.lit("Title "), n % 11)).alias("title"),
        F.when(n % 9 > 0, F.concat(F.lit("src/Mod_"), n % 60, F.lit(".py"))).alias("file"),
        (n % 50).cast("int").alias("line"), F.lit(1).alias("column"),
        F.when(n % 3 == 0, "critical").otherwise("low").alias("severity"))
    write_searchable(rows, path, 12)
    return path


@pytest.mark.parametrize("query", [
    "rule-7", "MOD_9 critical", "Überraschung", "log", ":3:1 title", "zz", "a", "", "no such words",
    "rule-12 .py low"])
def test_same_rows_as_the_scan(spark, stored, query):
    want = search(spark.read.parquet(f"{stored}/findings"), query)
    got = indexed_search(spark, stored, query)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rare_words_leave_few_files(spark, stored):
    every = spark.read.parquet(f"{stored}/findings").select("_metadata.file_path").distinct().count()
    assert every >= 10
    assert len(files_of(spark, stored, "raschung")) == 1
    assert 0 < len(files_of(spark, stored, "rule-39")) <= 3
    assert files_of(spark, stored, "nowhere") == [] and files_of(spark, stored, "ab c") is None
    assert len(files_of(spark, stored, "critical")) == every


def test_a_batch_leaves_each_trigram_once(spark):
    texts = ["abcd", "ab", "", "Überlog ", "abcab", "😀ab"] * 400
    rows = spark.createDataFrame([(f"p{i % 2}", t) for i, t in enumerate(texts)], "part string, text string")
    got = [tuple(r) for r in trigrams(rows.coalesce(1)).collect()]
    assert set(got) == {(f"p{i % 2}", t[j:j + 3]) for i, t in enumerate(texts) for j in range(len(t) - 2)}
    assert len(got) <= 2 * len(set(got))
