"""Operator 12 against grouping by the whole text."""

from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from riskloom.llm.exact import SQL, exact_groups, without_copies
from riskloom.llm.words import LOWER, UPPER

FOLD = str.maketrans(UPPER, LOWER)


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r.text or "").translate(FOLD)].append(r.doc_id)
    out = Counter()
    for text, ids in groups.items():
        best = max(ids, key=lambda i: (i is not None, i))
        stays = ids.index(best)
        for i, doc_id in enumerate(ids):
            out[doc_id, best, len(ids), i == stays, sha256(text.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("which", ["edges", "documents", "nothing"])
def test_against_grouping(request, which):
    docs = request.getfixturevalue(which)
    assert Counter(map(tuple, exact_groups(docs).collect())) == plain(docs.collect())


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_groups_over_many_partitions(spark, parts):
    texts = ["Same Text " * 9, "same text " * 9, "same text " * 9 + "x", "", None, "ÉCOLE", "école"]
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.element_at(
        F.array(*map(F.lit, texts)), F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(
            (F.col("id") % 7 + 1).cast("int"))).alias("text")).repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = Counter(map(tuple, exact_groups(docs).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == plain(docs.collect())


def test_rows_that_stay(edges):
    stay = without_copies(edges)
    assert stay.columns == edges.columns
    kept = [r for r in exact_groups(edges).collect() if r.kept]
    assert Counter(r.doc_id for r in stay.collect()) == Counter(r.doc_id for r in kept)


def test_twin(documents, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert Counter(con.execute(SQL).fetchall()) == Counter(
        map(tuple, exact_groups(documents).collect()))
