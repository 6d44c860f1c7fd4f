"""Operator 8 a plain recursive context tree, its probabilities and the spelling of texts."""

import math
from collections import Counter, defaultdict
from functools import lru_cache
from zlib import crc32

import numpy as np
import pytest

from riskloom.llm.ctw import BEGIN, log_kt, spell


def is_held(doc_id):
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


class Plain:
    """Context-tree weighting written as its definition, one node at a time."""

    def __init__(self, tokens, depth):
        self.depth = depth
        self.counts = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for token, times in tokens.items():
            for context, symbol in self.steps(token):
                for level in range(8):
                    node = (1 << level) | (symbol >> (8 - level))
                    for d in range(depth + 1):
                        c = context[:d]
                        self.counts[c, node][symbol >> (7 - level) & 1] += times
                        if d:
                            self.children[context[:d - 1], node].add(c)

    def steps(self, token):
        group, word = token[:1], token[1:]
        before = bytes(self.depth - 1) + bytes([BEGIN])
        for s in [*word, BEGIN]:
            yield before[::-1][:self.depth - 1] + group, s
            before += bytes([s])

    @lru_cache(None)
    def kt(self, c, node):
        a, b = self.counts.get((c, node), (0, 0))
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @lru_cache(None)
    def weighted(self, c, node):
        if len(c) == self.depth:
            return self.kt(c, node)
        below = sum(self.weighted(x, node) for x in self.children.get((c, node), ()))
        return math.log(0.5) + np.logaddexp(self.kt(c, node), below)

    @lru_cache(None)
    def token(self, token):
        total = 0.0
        for context, symbol in self.steps(token):
            for level in range(8):
                node, bit = (1 << level) | (symbol >> (8 - level)), symbol >> (7 - level) & 1
                p = seen = None
                for d in range(self.depth, -1, -1):
                    c = context[:d]
                    n = self.counts.get((c, node), (0, 0))
                    kt = (n[bit] + .5) / (sum(n) + 1)
                    if p is None or not seen:
                        p = kt
                    else:
                        own = math.exp(math.log(.5) + self.kt(c, node) - self.weighted(c, node))
                        p = own * kt + (1 - own) * p
                    seen = sum(n) > 0
                total += math.log10(p)
        return total


def compare(got, want):
    got = sorted((str(r.doc_id), *tuple(r)[1:7]) for r in got)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-7)


def test_probabilities_add_up():
    model = Plain(Counter({b"\x01ab": 5, b"\x01abc": 2, b"\x01\n": 3}), 3)
    total = 0.0
    for context in (b" \x00\x01", b"a \x01"):
        for symbol in range(256):
            p = 0.0
            model.steps = lambda token, c=context, s=symbol: [(c, s)]
            model.token.cache_clear()
            p = 10 ** model.token(b"x")
            total += p
    assert total == pytest.approx(2.0)


def test_spell():
    term, key = spell([b"\x01ab", b"\x02"], 3)
    assert term.tolist() == [0, 0, 0, 1]
    assert [int(k).to_bytes(5, "big") for k in key] == [
        b" \0\0\x01a", b"a \0\x01b", b"ba \x01 ", b" \0\0\x02 "]


def test_kt():
    a, b = np.array([0., 3, 100, 1e6]), np.array([0., 1, 0, 5])
    want = [math.lgamma(x + .5) + math.lgamma(y + .5) - math.lgamma(x + y + 1) - math.log(math.pi)
            for x, y in zip(a, b)]
    assert np.allclose(log_kt(a, b), want, rtol=1e-10, atol=1e-6)
