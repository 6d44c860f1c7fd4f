"""Operator 13 against counting every phrase, and its parts against their definitions."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from riskloom.llm import phrases
from riskloom.llm.phrases import SQL, collocations, numbered, paths
from riskloom.llm.words import LOWER, UPPER

FOLD = str.maketrans(UPPER, LOWER)


def plain(rows, least, top=2000):
    f, words = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r.lang is None else r.lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r.text or "").translate(FOLD)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f[lang][tuple(ws[i:i + k])] += 1
    out = Counter()
    for lang, count in f.items():
        often = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i:i + k]] = max(longer[p[i:i + k]], a)
        scored = []
        for p, a in often.items():
            if longer[p] and 100 * longer[p] >= 80 * a:
                continue
            score, _, left, right = min(
                (2000000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]])
                for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out[lang, rank, p.decode(), -a, left, right, words[lang], -score] += 1
    return out


@pytest.mark.parametrize("which,least", [("edges", 2), ("documents", 4), ("nothing", 30)])
def test_against_every_phrase(request, which, least):
    docs = request.getfixturevalue(which)
    want = plain(docs.collect(), least)
    assert bool(want) == (which != "nothing")
    assert Counter(map(tuple, collocations(docs, least=least).collect())) == want


def test_copies_repeats_and_languages(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 300)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 2000)
    rng = random.Random(2)
    passage = " ".join(f"w{i}" for i in range(60)) + ". And then; ha ha ha ha ha ha, New York New York"
    texts = [passage] * 35 + [" ".join(rng.choices(["the", "of", "New", "York", "w1", "w2", "ha"], k=40))
                              for _ in range(80)] + [None, "", " \t. ", "A-Z\tand É É É"]
    rows = [(i, t, rng.choice(["en", "de", None, "und"])) for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    for least, top in ((30, 2000), (5, 9)):
        got = collocations(docs, least=least, top=top)
        assert Counter(map(tuple, got.collect())) == plain(docs.collect(), least, top)


def test_paths(spark):
    rows = [("en", 4, " ".join(f"x{j}" for j in range(i, i + 4)), 9) for i in range(11)]
    rows += [("en", 3, " ".join(f"x{j}" for j in range(i, i + 3)), 12 if i == 5 else 9)
             for i in range(12)]
    found = spark.createDataFrame(rows, "lang string, size int, phrase string, f long")
    got = sorted(r.path for r in paths(found, 4).collect())
    assert got == [" ".join(f"x{j}" for j in range(8)),
                   " ".join(f"x{j}" for j in range(5, 14))]


def test_numbered():
    ids, words = numbered([b"One two. two", b"", b"\tOne,one"])
    assert [words[i] for i in ids] == [b"one", b"two", b".", b"two", b".", b".", b"one", b".", b"one"]


def test_packing():
    values = np.array([0, 1, 70_000, 2**31], np.uint32)
    assert phrases.unpack(phrases.pack(values)).tolist() == values.tolist()


def test_twin(documents, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert Counter(con.execute(SQL).fetchall()) == Counter(map(tuple, collocations(documents).collect()))
