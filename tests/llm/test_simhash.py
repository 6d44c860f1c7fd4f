"""Operator 1 against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from riskloom.llm.components import components
from riskloom.llm.simhash import anchors, fingerprints, links, near_duplicates, one_per_group


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64)
               if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) and hashes)


def groups(prints, ids):
    """Smallest id of each print's component, by comparing all pairs."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    distinct = sorted(set(prints))
    for i, p in enumerate(distinct):
        for q in distinct[:i]:
            if (p ^ q).bit_count() <= 2:
                root[find(p)] = find(q)
    first = {}
    for p, i in zip(prints, ids):
        if i is not None:
            first[find(p)] = min(first.get(find(p), i), i)
    return [first.get(find(p)) for p in prints]


@pytest.mark.parametrize("which", ["documents", "edges", "nothing"])
def test_near_duplicates(request, which):
    docs = request.getfixturevalue(which)
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_print(r.text) for r in rows]
    want = sorted((str(r.doc_id), f"{p:016x}", c) for r, p, c in zip(
        rows, prints, groups(prints, [r.doc_id for r in rows])))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id)
                 for r in near_duplicates(docs).collect())
    assert got == want


def test_shingle_hash_is_sparks(spark):
    docs = spark.createDataFrame([(1, "Él naïve Words")], "doc_id long, text string")
    want = docs.selectExpr("xxhash64('Él naïve words')").first()[0] & (2**64 - 1)
    assert xxhash.xxh64_intdigest("Él naïve words".encode(), 42) == want
    assert fingerprints(docs).first().fp & (2**64 - 1) == want


def test_one_home_and_every_near_pair_meets():
    rng = np.random.default_rng(3)
    a = rng.integers(-2**63, 2**63, 300, dtype=np.int64)
    row, home = anchors(a, 0)
    assert row.tolist() == list(range(300))
    for bits in (0, 1, 2):
        b = a.copy()
        for i in range(300):
            for bit in rng.choice(64, bits, replace=False):
                b[i] ^= np.int64(np.uint64(1 << int(bit)).view(np.int64))
        row, anchor = anchors(b, 2)
        seen = set(zip(row.tolist(), anchor.tolist()))
        assert all((i, h) in seen for i, h in enumerate(home.tolist()))
        assert len(seen) == len(row)


def test_links_of_a_crowded_neighbourhood(spark):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(300):
        p = base
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            p ^= 1 << bit
        prints.add(p)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = sorted((r.a, r.b) for r in links(df).collect())
    want = sorted((p, q) for p in signed for q in signed if p < q
                  and ((p ^ q) & (2**64 - 1)).bit_count() <= 2)
    assert got == want


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 180)]
    star = [(5, i) for i in range(200, 300)]
    mixed = [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(180)]
    pairs = [*chain, *star, *mixed, (7, 7), *chain]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {(x, find(x)) for x in root if find(x) != x}
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    none = components(spark.createDataFrame([], "a long, b long"))
    assert none.count() == 0


def test_one_per_group(edges):
    kept = one_per_group(edges)
    assert kept.columns == edges.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 1 and ids.count(17) == 1 and 18 not in ids and 0 in ids and 1 not in ids
