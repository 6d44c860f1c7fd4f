"""Operator 6: round trips of the code, the segments and the files."""

from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from riskloom.llm.eliasfano import Decoder, encode
from riskloom.llm.tokenfiles import Segment, pack_segment, read_tokens, write_tokens
from riskloom.llm.tokens import tokenizer_path

WORD = tokenizer_path("word_bpe_49k.json")


@pytest.mark.parametrize("top", [0, 1, 7, 1000, 2**20, 2**40, 2**62])
@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 3000])
def test_code(top, n):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(-top // 2, top // 2 + 1, n))
    data = b"abc" + encode(values) + b"rest"
    back = Decoder(data, 3)
    assert data[back.end:] == b"rest" and back.count == n
    assert back.all().tolist() == values.tolist()
    some = rng.integers(0, n, 20) if n else np.zeros(0, np.int64)
    assert back.select(some).tolist() == values[some].tolist()


def test_code_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    assert len(encode(ends)) * 8 / len(ends) < 2 + np.log2(1000) + 1.5


def test_segment():
    ids = np.arange(10, dtype="<u4") + 7
    segment = Segment(pack_segment([None, None, 4, 4, 9], [1, 2, 3, 1, 3], ids.tobytes(), 2))
    assert segment.doc_ids == [None, None, 4, 4, 9]
    assert [segment.document(i).tolist() for i in range(5)] == [
        [7], [8, 9], [10, 11, 12], [13], [14, 15, 16]]


@pytest.mark.parametrize("which, size", [
    ("documents", 1 << 20), ("documents", 3000), ("edges", 50), ("nothing", 50)])
def test_files(spark, request, tmp_path, which, size):
    docs = request.getfixturevalue(which)
    path = str(tmp_path / "tokens")
    write_tokens(docs, path, WORD, 2, size)
    got = read_tokens(spark, path).collect()
    texts = docs.select("doc_id", "text").collect()
    encoded = Tokenizer.from_file(WORD).encode_batch([r.text or "" for r in texts],
                                                     add_special_tokens=False)
    want = Counter((r.doc_id, len(e.ids) + 1, crc32(np.array([*e.ids, 2], "<u4")))
                   for r, e in zip(texts, encoded))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
