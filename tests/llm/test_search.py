"""Operator 11 against scoring every document with every item."""

import math
import re
from collections import Counter

import duckdb
import pytest

from riskloom.llm import search
from riskloom.llm.search import SQL, ranked_search, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans(search.UPPER, search.LOWER)


def cut(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(docs, items, top=10):
    held = [(d.doc_id, Counter(cut(d.text))) for d in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    count, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = Counter()
    for item_id, text in {(r.item_id, r.text) for r in items}:
        asked = Counter(cut(text))
        scored = []
        for doc_id, c, n in held:
            m = 25 + 75 * n * count // total
            score = sum(
                times * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if c[t])
            if score:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, none, doc_id) in enumerate(sorted(scored)[:top], 1):
            out[item_id, rank, None if none else doc_id, -score] += 1
    return out


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, "one two THREE"), (2, "mot mot a"), (None, "id here"), (3, None), (4, " !! "), (5, "A"),
         (5, "A"), (6, "ÉCOLE école tab"), (7, "9e8 345 12 w"), (8, "日本語 no\x1cbreak line")],
        "item_id long, text string")


def test_terms():
    for text in ("don't  STOP 12.5e3", "É-É \x85x\xa0y", "", "__a__b"):
        assert [t.decode() for t in terms(text.encode())] == cut(text)


@pytest.mark.parametrize("which", ["edges", "documents", "nothing"])
def test_against_every_pair(request, items, which):
    docs = request.getfixturevalue(which)
    assert Counter(map(tuple, ranked_search(docs, items).collect())) == plain(
        docs.collect(), items.collect())


def test_slices_and_small_batches(documents, items, monkeypatch):
    monkeypatch.setattr(search, "CELLS", 40)
    got = ranked_search(documents, items, top=3, items_bytes=200)
    assert Counter(map(tuple, got.collect())) == plain(documents.collect(), items.collect(), 3)


def test_ties_and_copies(spark, items):
    docs = spark.createDataFrame([(i, "one two") for i in range(40, 0, -1)] + [(None, "one two")],
                                 "doc_id long, text string").repartition(6)
    got = [r for r in ranked_search(docs, items).collect() if r.item_id == 1]
    assert sorted((r.rank, r.doc_id) for r in got) == [(i, i) for i in range(1, 11)]
    assert Counter(map(tuple, ranked_search(docs, items).collect())) == plain(
        docs.collect(), items.collect())


def test_no_items(documents, items):
    assert ranked_search(documents, items.limit(0)).count() == 0


def test_twin(spark, documents, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = ranked_search(documents, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert Counter(con.execute(SQL).fetchall()) == Counter(map(tuple, got.collect()))
