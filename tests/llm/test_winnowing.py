"""Operator 7 against a count of all windows and against its SQL twin."""

import re
from collections import Counter
from hashlib import sha256

import duckdb
import pytest

from riskloom.llm.winnowing import SQL, decontaminate, without_contaminated

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def cut(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return WORD.findall(lowered)


def plain(docs, items):
    windows = {}
    for r in items:
        w = cut(r.text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + k]), set()).add(r.item_id)
    lengths = {len(w) for w in windows}
    out = []
    for r in docs:
        w = cut(r.text)
        hit, found = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(w[i:i + k])]
        names = sorted(str(i) for i in found if i is not None)
        out.append((r.doc_id, len(w), len(hit), len(names),
                    sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.fixture(scope="module")
def benchmark(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_documents(documents, benchmark, limit):
    want = plain(documents.collect(), benchmark.collect())
    assert sum(1 for r in want if r[5]) >= 3  # the small table has three
    got = decontaminate(documents, benchmark, broadcast_bytes=limit)
    assert Counter(map(tuple, got.collect())) == want


def test_twin(documents, sf, benchmark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = Counter(map(tuple, decontaminate(documents, benchmark).collect()))
    assert Counter(con.execute(SQL).fetchall()) == got


@pytest.mark.parametrize("which", ["edges", "nothing"])
def test_edges(spark, request, which):
    docs = request.getfixturevalue(which)
    items = spark.createDataFrame(
        [(1, "one two THREE"), (2, "mot " * 12), (None, "id here"), (3, None), (4, "  "), (5, "a"),
         (5, "a"), (6, "ÉCOLE"), (7, "THREE two"), (10, "caf́e é x"), (8, "mot " * 4)],
        "item_id long, text string")
    want = plain(docs.collect(), items.collect())
    assert Counter(map(tuple, decontaminate(docs, items).collect())) == want
    kept = without_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == sum(n for r, n in want.items() if not r[5])


def test_no_benchmark(spark, edges):
    none = spark.createDataFrame([], "item_id long, text string")
    assert Counter(map(tuple, decontaminate(edges, none).collect())) == plain(edges.collect(), [])


def test_no_python_in_the_plan(documents, benchmark):
    plan = decontaminate(documents, benchmark)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
