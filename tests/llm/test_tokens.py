"""Operators 4, 6 and 10 against the tokenizer library run on whole texts."""

from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from riskloom.llm.packing import cuts, pack, sequences
from riskloom.llm.token_counts import token_counts
from riskloom.llm.tokens import Coder, tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def whole(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(
        [t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_coder_equals_library(path, documents, edges):
    texts = [r.text for r in documents.collect()] + [r.text for r in edges.collect()]
    coder = Coder(path)
    for text, want in zip(texts, whole(path, texts)):
        assert np.frombuffer(coder.ids(text or ""), "<u4").tolist() == want, text


def test_a_word_is_encoded_once_whatever_its_case_and_marks():
    class Counting:
        def __init__(self, model):
            self.model, self.asked = model, []

        def tokenize(self, text):
            self.asked.append(text)
            return self.model.tokenize(text)

    coder, text = Coder(WORD), "Straw straw STRAW, straw. Straw!! Écru écru"
    coder.model = Counting(coder.model)
    assert np.frombuffer(coder.ids(text), "<u4").tolist() == whole(WORD, [text])[0]
    assert coder.model.asked.count("straw") == 1 and len(coder.model.asked) == 5


def test_cuts_cover_and_fit():
    for total in [*range(0, 3000, 7), 2048, 4096, 1023, 1, 128]:
        got = list(cuts(total, 2048, 16, 64))
        assert sum(n for n, _ in got) == total
        assert all(0 < n * kind <= 2048 for n, kind in got)


@pytest.mark.parametrize("which", ["documents", "edges", "nothing"])
def test_pack(request, which):
    docs = request.getfixturevalue(which)
    rows = pack(docs, BYTE, with_ids=True).collect()
    texts = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, tuple(ids + [1])) for r, ids in zip(
        texts, whole(BYTE, [r.text for r in texts])))
    left = Counter()
    by_doc = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and crc32(r.ids) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.start, r.doc_tokens, ids))
    for (doc, ids), n in want.items():  # every id lies in exactly one piece
        pieces = sorted((s, i) for s, total, i in by_doc[doc] if total == len(ids))
        for s, i in pieces:
            if list(ids[s:s + len(i)]) == i:
                left[doc, ids] += len(i)
    assert all(left[k] == n * len(k[1]) for k, n in want.items())
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= sum(r.length for r in rows) / 2048 / 0.98 + 5


def test_sequences(documents):
    pieces = pack(documents, BYTE, with_ids=True)
    for r in sequences(pieces).collect():
        n = r.n_tokens
        assert len(r.ids) == 4 * (n if n & (n - 1) == 0 else 2048)


@pytest.mark.parametrize("which", ["documents", "edges", "nothing"])
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_token_counts(request, which, path):
    docs = request.getfixturevalue(which)
    texts = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), len(ids), len(ids) > 2048)
                   for r, ids in zip(texts, whole(path, [r.text for r in texts])))
    assert Counter(map(tuple, token_counts(docs, path).collect())) == want
