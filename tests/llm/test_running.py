"""Operator 8 over the running text against the plain tree of test_ctw, and its view across words."""

import math
import random
from collections import Counter

import pytest

from riskloom.llm.ctw import DEPTH, END, marked
from riskloom.llm.running import block_keys, block_table, block_words, running_scores, word_counts
from test_ctw import Plain, compare, is_held


def plain(rows, depth, groups):
    seen = Counter(r.lang for r in rows if groups and r.lang and not is_held(r.doc_id))
    number = {v: i for i, v in enumerate(sorted(seen, key=lambda v: (-seen[v], v)), 1)}
    marks = [bytes([number.get(r.lang, 0)]) for r in rows]
    tokens = [(r.text or "").encode().lower().split() + [END] for r in rows]
    train = Counter(t for r, ts in zip(rows, tokens) if not is_held(r.doc_id) for t in ts)
    whole = [m + b" ".join(ts) for m, ts in zip(marks, tokens)]
    learned = Counter({w: 0 for w in whole})
    learned.update(w for r, w in zip(rows, whole) if not is_held(r.doc_id))
    n, v = sum(train.values()), len(train)
    model = Plain(learned, depth + 1)
    out = []
    for r, ts, w in zip(rows, tokens, whole):
        base = sum(math.log10((train[t] + .1) / (n + .1 * (v + 1))) for t in ts)
        out.append((str(r.doc_id), is_held(r.doc_id), len(ts), sum(train[t] > 0 for t in ts), n,
                    base, model.token(w)))
    return sorted(out)


@pytest.mark.parametrize("groups", [False, True])
def test_edges(edges, groups):
    few = edges.where("text IS NULL OR length(text) < 1000")
    got = running_scores(few, 3, "lang" if groups else None).collect()
    compare(got, plain(few.collect(), 3, groups))


def test_many_partitions(spark, documents):
    few = documents.where("length(text) < 700").limit(60)
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        got = running_scores(few.repartition(64), 2).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    compare(got, plain(few.collect(), 2, False))


def test_held_out_text_needs_fewer_bits_than_single_bytes(documents):
    held = {r.doc_id: r for r in running_scores(documents, group="lang").collect() if r.held_out}
    texts = {r.doc_id: (r.text or "").encode().lower() for r in documents.collect()}
    seen = Counter(b for i, t in texts.items() if i not in held for b in t)
    bits = [-math.log2((seen[b] + .5) / (seen.total() + 128)) for i in held for b in texts[i]]
    sizes = sum(len(texts[i]) for i in held)
    assert sum(r.bits_per_byte * len(texts[i]) for i, r in held.items()) / sizes \
        < sum(bits) / sizes / 1.6


def test_order_of_words_counts(spark):
    rng = random.Random(3)
    words = "alpha beta gamma delta".split()
    rows = [(i, " ".join(words * 20)) for i in range(1, 40)]
    mixed = words * 20
    rng.shuffle(mixed)
    rows.append((1000, " ".join(mixed)))
    got = {r.doc_id: r.score for r in running_scores(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000] < got[1] - 5


def test_words_and_contexts_travel_packed(documents):
    """A row per block and part, no row per word or context, and far fewer bytes than the texts have."""
    texts = marked(documents, None, {})
    stored, parts = block_table(texts), 3
    blocks = stored.count()
    words, keys = block_words(stored, parts), block_keys(stored, DEPTH, parts)
    assert words.count() <= blocks * parts and keys.count() <= blocks * parts
    size = sum(len(r.text) for r in texts.collect())
    assert sum(len(r.words) + len(r.counts) for r in words.collect()) < size / 4
    assert sum(len(r.keys) + len(r.counts) for r in keys.collect()) < size * 1.5
    assert sum(len(r.data) for r in stored.collect()) < size / 1.5
    train = Counter(t for r in documents.collect() if not is_held(r.doc_id)
                    for t in (r.text or "").encode().lower().split() + [END])
    got = word_counts(words).collect()
    assert sum(r.known for r in got) == len(train) and sum(r.total for r in got) == train.total()


def test_no_document(nothing):
    assert running_scores(nothing).count() == 0
