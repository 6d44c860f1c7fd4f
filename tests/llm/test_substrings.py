"""Operator 2 and its index against counts of all windows."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from riskloom.llm.fmindex import FMIndex
from riskloom.llm.substrings import segments, substring_dedup, without_repeats


def plain(rows, window):
    """(doc_id, n_words, n_removed, kept_sha256) from a count of every window."""
    tokens = [(r.text or "").encode().split() for r in rows]
    count = Counter(tuple(t[i:i + window]) for t in tokens for i in range(len(t) - window + 1))
    out = []
    for r, t in zip(rows, tokens):
        gone = {k for i in range(len(t) - window + 1) if count[tuple(t[i:i + window])] > 1
                for k in range(i, i + window)}
        kept = [w for i, w in enumerate(t) if i not in gone]
        out.append((r.doc_id, len(t), len(gone), sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"crowd": 2}, {"shard_words": 300}, {"crowd": 0}])
def test_documents(documents, options):
    rows = documents.collect()
    want = plain(rows, 35)
    assert sum(1 for r in want if r[2]) > 20
    assert Counter(map(tuple, substring_dedup(documents, **options).collect())) == want


@pytest.mark.parametrize("which", ["edges", "nothing"])
def test_edges(request, which):
    docs = request.getfixturevalue(which)
    want = plain(docs.collect(), 35)
    assert Counter(map(tuple, substring_dedup(docs).collect())) == want


@pytest.mark.parametrize("options", [{}, {"crowd": 5}])
def test_few_words_many_repeats(spark, options):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(None, rows[3][1]), rows[9], rows[9], (77, "z " * 30), (78, "x y " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for window, gram in ((6, 2), (9, 3), (5, 5)):
        want = plain(docs.collect(), window)
        got = substring_dedup(docs, window=window, gram=gram, **options)
        assert Counter(map(tuple, got.collect())) == want


def test_without_repeats(documents):
    got = {r.doc_id: r for r in without_repeats(documents, "n_chars").collect()}
    for r in documents.collect():
        want = next(iter(plain([r], 35)))
        assert want  # the row itself may repeat
        if r.doc_id in got:
            assert len(got[r.doc_id].text) == got[r.doc_id].n_chars or got[r.doc_id].text == r.text
    assert without_repeats(documents).columns == documents.columns


def test_segments_cover_every_window_once():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 500).astype(np.uint64)
    for window, gram in ((35, 8), (10, 4), (7, 7)):
        first, n, mini = segments(hashes, window, gram)
        assert first[0] == 0 and (first[1:] == (first + n)[:-1]).all()
        assert (first + n)[-1] == 500 - window + 1 and n.max() <= window - gram + 1


def test_index_reports_all_repeats():
    rng = random.Random(6)
    for _ in range(30):
        sigma = rng.choice([2, 3, 20])
        texts = [np.array([rng.randrange(sigma) for _ in range(rng.randint(1, 40))])
                 for _ in range(rng.randint(1, 12))]
        window = rng.randint(2, 7)
        count = Counter(tuple(t[i:i + window]) for t in map(np.ndarray.tolist, texts)
                        for i in range(len(t) - window + 1))
        for text, spans in zip(texts, FMIndex(texts, sigma).repeats(texts, window)):
            t = text.tolist()
            want = {k for i in range(len(t) - window + 1) if count[tuple(t[i:i + window])] > 1
                    for k in range(i, i + window)}
            got = {k for a, b in zip(spans[::2], spans[1::2]) for k in range(a, b)}
            assert got == want
