"""Operator 9 against a plain count, and its bands on planted texts."""

import re
from collections import Counter

import pytest

from riskloom.llm.quality import Bands, keep_good, quality


def plain(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    found = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if found[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


@pytest.mark.parametrize("which", ["documents", "edges", "nothing"])
def test_counts(request, which):
    docs = request.getfixturevalue(which)
    got = Counter(tuple(r)[:7] for r in quality(docs).collect())
    assert got == Counter((r.doc_id, *plain(r.text))
                          for r in docs.select("doc_id", "text").collect())


def test_bands(spark):
    import base64
    import random
    rng = random.Random(5)
    syllables = "an er in the to ba ko lim ra st ou ve qui".split()
    prose = " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(3000))
    noise = base64.b64encode(rng.randbytes(20_000)).decode()
    noise = " ".join(noise[i:i + 30] for i in range(0, len(noise), 30))
    cycle = " ".join(prose.split()[:40]) + " "
    docs = spark.createDataFrame(
        [(0, prose), (1, noise), (2, cycle * 40), (3, prose + (cycle * 200)), (4, None)],
        "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality(docs).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False, 4: False}
    assert [r.doc_id for r in keep_good(docs).collect()] == [0]
    assert keep_good(docs).columns == docs.columns


def test_bands_follow_the_length():
    bands = Bands()
    assert bands.inside(150, 0.9) and not bands.inside(15_000, 0.9)
    assert not bands.inside(300, 4.5) and bands.inside(15_000, 4.5)


ALPHABETS = {"letters and digits": "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])),
             "printable": "".join(map(chr, range(33, 127))), "hex": "0123456789abcdef"}


@pytest.mark.parametrize("alphabet, sizes", [
    ("letters and digits", (800, 1600, 3100, 5000, 12_000, 50_000)),
    ("printable", (400, 800, 1600, 3100, 5000, 12_000, 50_000)),
    ("hex", (6400, 12_000, 50_000))])
def test_noise_of_every_length(alphabet, sizes):
    import random

    from riskloom.llm.quality import judge
    rng = random.Random(7)
    for size in sizes:
        words = ["".join(rng.choices(ALPHABETS[alphabet], k=rng.randint(3, 9)))
                 for _ in range(size // 4)]
        noise = " ".join(words).encode()[:size]
        assert not judge([noise], Bands())[0][6], size


def test_every_chunk_counts():
    import random

    from riskloom.llm.quality import judge
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(700)]
    prose = " ".join(rng.choices(vocabulary, k=4000)).encode()
    noise = " ".join("".join(rng.choices(ALPHABETS["printable"], k=6)) for _ in range(900)).encode()
    for text, share in ((prose[:8000], 0), (prose[:4096] + noise[:3000], 3000 / 7096),
                        (noise[:4096] + prose[:3000], 4096 / 7096)):
        found = judge([text], Bands())[0]
        assert found[6] == (share == 0) and found[8] == pytest.approx(share)


def test_rows_that_only_the_bands_reject(spark):
    """Texts strewn with symbols are no repetition for the base rules; no text of good quality is lost."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    rows = quality(docs).collect()
    rejected = [r for r in rows if not r.base_failed and not r.kept]
    assert len(rejected) >= 10 and not good & {r.doc_id for r in rejected}
    assert all(r.n_symbols > 0.05 * r.word_chars for r in rejected)
    assert sorted(r.doc_id for r in keep_good(docs).select("doc_id").collect()) == sorted(
        r.doc_id for r in rows if r.kept)


def test_limits_of_a_corpus(spark):
    from riskloom.llm.quality import corpus_limits, size_class, weighted_median

    assert weighted_median([(3.0, 1), (1.0, 1), (2.0, 5)]) == 2.0 and weighted_median([(1.0, 4)]) == 1.0
    assert size_class(199) == -1 and size_class(1024) == 40
    rows = [(1024 + i, 512 + i // 3, 40) for i in range(60)]
    rows += [(1100, 110, 40)] * 500  # copies of one text that repeats itself
    rows += [(4096, 2048, 48), (0, 9, -1)]
    limits = corpus_limits(spark.createDataFrame(rows, "n_bytes long, packed long, size_class int"))
    assert set(limits) == {40}
    low, high = limits[40]
    assert low < 2.0 < high < 2.4
