"""Operator 8, the context trees of language-model scores (:mod:`riskloom.llm.running` has the texts).

A byte is eight binary decisions; each decision has, at every depth from 0 to ``depth``, a node for the
last bytes before it, and at one more depth a node for the document's group, such as its language, which
is given and costs nothing. A node predicts by the Krichevsky-Trofimov estimate of its counts, and the depths are mixed as context-tree weighting
does: a node's weighted probability is half its own estimate's and half the product of its children's,
so the share of each depth follows from how well it described the training text. A context that training
never saw adds nothing: the estimate of the longest one that it saw stands.

The tree is cut by the last two bytes of the context: below, whole branches are weighted on their own where
their counts meet, and these parts answer the blocks that asked; of the two depths above only 256 * 255 nodes
can exist, which the driver weighs.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import release_shuffles
from riskloom.llm.words import whole_number

DEPTH = 6
BEGIN = 0x20
END = b"\n"  # no word holds it
GROUPS = 200
HALF = np.log(0.5)


def held_out(doc_id: int | None) -> bool:
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5: Stirling's series eight steps further on."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) \
        - 1 / (360 * y**3) + 1 / (1260 * y**5)
    steps = np.zeros_like(y)
    for i in range(8):
        steps += np.log(x + i)
    return series - steps


def _table(first: float) -> np.ndarray:
    return log_gamma(np.arange(1 << 14) + first)


#: log gamma at whole numbers plus one half and plus one, for the many small counts.
HALVES, WHOLES = _table(0.5), _table(1.0)


def _looked_up(counts: np.ndarray, table: np.ndarray, first: float) -> np.ndarray:
    small = counts < len(table)
    out = table[np.where(small, counts, 0).astype(np.int64)]
    if not small.all():
        out[~small] = log_gamma(counts[~small] + first)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log probability of a sequence with so many zeros and ones by the KT estimate."""
    return _looked_up(zeros, HALVES, 0.5) + _looked_up(ones, HALVES, 0.5) \
        - _looked_up(zeros + ones, WHOLES, 1.0) - np.log(np.pi)


def pack(values: np.ndarray) -> bytes:
    """Eight-byte values, compressed by byte planes."""
    import zstandard

    planes = np.ascontiguousarray(values.view("u1").reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1").reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def spell(terms: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(term number, key) of every symbol of the terms (a group's byte and a word): the key holds the
    ``depth`` bytes before the symbol, the latest first, the group, and the symbol itself. Before the
    token there are zeros."""
    gap = bytes(depth) + bytes([BEGIN])
    end = bytes([BEGIN])
    data = np.frombuffer(b"".join([gap + t[1:] + end for t in terms]), np.uint8)
    groups = np.fromiter((t[0] for t in terms), np.int64, len(terms))
    sizes = np.fromiter((len(t) for t in terms), np.int64, len(terms))
    starts = np.cumsum(sizes + depth + 1) - sizes
    term = np.repeat(np.arange(len(terms)), sizes)
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    context = np.zeros(len(data) - depth if len(data) else 0, np.int64)
    for back in range(1, depth + 1):
        context <<= 8
        context |= data[depth - back:len(data) - back]
    return term, (((context[at - depth] << 8) | groups[term]) << 8) | data[at]


class Branches:
    """The nodes at depth 2 and below of whole branches (contexts that end in the same two bytes, the
    first two of the key), weighted. ``depth`` counts the bytes of the key before the symbol; keys are
    distinct and ascending.

    At every depth the keys fall into pairs of a context and a symbol, fewer the shallower. Where pairs
    are in order, the pairs of a node stand side by side, so nodes are runs of pairs and need no sort.
    """

    def __init__(self, key: np.ndarray, count: np.ndarray, depth: int):
        self.key, self.depth = key, depth
        self.pairs: dict[int, np.ndarray] = {}  # depth -> number of each key's pair
        self.at: dict[int, np.ndarray] = {}  # depth -> number of the node of each pair's decisions
        self.zeros: dict[int, np.ndarray] = {}
        self.ones: dict[int, np.ndarray] = {}
        self.own: dict[int, np.ndarray] = {}  # share of the node's own estimate
        level = np.arange(8)[:, None]
        pair, weight = key, count.astype(float)
        weighted = starts = None
        for d in range(depth, 1, -1):
            if d == depth:
                up = self.pairs[d] = np.arange(len(key))
            else:
                pair, up = np.unique(((pair >> 16) << 8) | (pair & 255), return_inverse=True)
                weight = np.bincount(up, weight, len(pair))
                self.pairs[d] = up[self.pairs[d + 1]]
            symbol, context = pair & 255, pair >> 8
            node = (1 << level) | (symbol >> (8 - level))
            new = np.ones(node.shape, bool)
            new[:, 1:] = (node[:, 1:] != node[:, :-1]) | (context[1:] != context[:-1])
            first = np.flatnonzero(new)
            at = self.at[d] = (np.cumsum(new) - 1).reshape(node.shape)
            self.ones[d] = np.add.reduceat((((symbol >> (7 - level)) & 1) * weight).ravel(), first)
            self.zeros[d] = np.add.reduceat(np.tile(weight, 8), first) - self.ones[d]
            own = log_kt(self.zeros[d], self.ones[d])
            if weighted is None:
                weighted, self.own[d] = own, np.ones(len(own))
            else:
                above = at[starts // len(up), up[starts % len(up)]]
                below = np.bincount(above, weighted, len(own))
                weighted = np.logaddexp(own, below) + HALF
                self.own[d] = np.exp(own + HALF - weighted)
            starts = first  # the first pair of each node, counted on from level to level
        self.top = pd.DataFrame({
            "last": (context[first % len(pair)] >> 8) & 255, "node": node.ravel()[first],
            "zeros": self.zeros[2], "ones": self.ones[2], "weighted": weighted,
        }).groupby(["last", "node"], as_index=False).sum()

    def predictions(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the keys from ``a`` to ``b``: the node of each decision inside the byte's binary tree (8
        rows), the decision, its probability, depths 2 and up mixed, and whether the node at depth 2
        was seen."""
        symbol, level = self.key[a:b] & 255, np.arange(8)[:, None]
        node, bit = (1 << level) | (symbol >> (8 - level)), (symbol >> (7 - level)) & 1
        mixed = seen = None
        for d in range(self.depth, 1, -1):
            at = self.at[d][:, self.pairs[d][a:b]]
            zeros, ones, own = (t[d][at] for t in (self.zeros, self.ones, self.own))
            mixed, seen = mix(mixed, seen, zeros, ones, own, bit)
        return node, bit, mixed, seen


def mix(deeper, deeper_seen, zeros, ones, own, bit):
    """The decision's probability one depth up, and whether the node was seen in training."""
    kt = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)
    if deeper is None:
        return kt, zeros + ones > 0
    return np.where(deeper_seen, own * kt + (1 - own) * deeper, kt), zeros + ones > 0


def top_tables(stats: pd.DataFrame):
    """Counts and own shares at depths 0 and 1 from the sums over the branches."""
    zeros, ones, below = (np.zeros((256, 256)) for _ in range(3))
    at = (stats["last"].to_numpy(), stats["node"].to_numpy())
    zeros[at], ones[at], below[at] = stats["zeros"], stats["ones"], stats["weighted"]
    own = log_kt(zeros, ones)
    weighted = np.logaddexp(own, below) + HALF
    top = log_kt(zeros.sum(axis=0), ones.sum(axis=0))
    whole = np.logaddexp(top, weighted.sum(axis=0)) + HALF
    return zeros, ones, np.exp(own + HALF - weighted), np.exp(top + HALF - whole)


def group_numbers(docs: DataFrame, group: str | None) -> dict[str, int]:
    """A number from 1 for each of the most frequent groups of the training documents; 0 is for the
    rest."""
    if group is None:
        return {}
    counted = docs.where(~_held(docs) & F.col(group).isNotNull()).groupBy(
        F.col(group).cast("string").alias("value")).count()
    top = counted.orderBy(F.desc("count"), "value").limit(GROUPS).collect()
    return {r.value: i for i, r in enumerate(top, 1)}


def _held(docs: DataFrame) -> F.Column:
    ident = F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit(""))
    return F.crc32(ident.cast("binary")) % 10 == 0


def marked(docs: DataFrame, group: str | None, numbers: dict[str, int]) -> DataFrame:
    """``doc_id`` and ``text`` as bytes behind the byte of the document's group."""
    number = F.lit(0)
    if numbers:
        table = F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair))
        number = F.coalesce(F.element_at(table, F.coalesce(F.col(group).cast("string"), F.lit(""))),
                            F.lit(0))
    mark = F.unhex(F.lpad(F.hex(number.cast("long")), 2, "0"))
    return docs.select(whole_number("doc_id"), F.concat(
        mark, F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text"))


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a part's blocks, ascending, and their training counts."""
    key = np.concatenate([unpack(k) for k in table["keys"].to_pylist()])
    count = np.concatenate([unpack(c) for c in table["counts"].to_pylist()])
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(count, first)


#: Keys whose probabilities are mixed at once.
AT_ONCE = 1 << 13


def above(found: DataFrame, depth: int) -> pd.DataFrame:
    """The sums over the branches for the nodes of depth 1, at most 256 * 255 rows."""
    def stats(part: pa.Table) -> pa.Table:
        return pa.Table.from_pandas(Branches(*merged(part), depth + 1).top, preserve_index=False)

    return (found.select("part", "keys", "counts").groupBy("part").applyInArrow(
        stats, "last long, node long, zeros double, ones double, weighted double")
        .groupBy("last", "node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")))
        .toPandas())


def code_lengths(found: DataFrame, depth: int) -> DataFrame:
    """``found`` has a row per block and part, a part being whole branches: ``keys``, ascending, and
    ``counts``. Returns ``block``, ``part`` and ``values``, the log10 probabilities of its keys, the
    symbols in their contexts."""
    zeros, ones, own_1, own_0 = top_tables(above(found, depth))
    release_shuffles(found)
    zeros_0, ones_0 = zeros.sum(axis=0), ones.sum(axis=0)

    def lengths(part: pa.Table) -> pa.Table:
        key, count = merged(part)
        branches = Branches(key, count, depth + 1)
        log10p = np.empty(len(key))
        for a in range(0, len(key), AT_ONCE):
            b = min(a + AT_ONCE, len(key))
            node, bit, mixed, seen = branches.predictions(a, b)
            one = ((key[a:b] >> 8 * (depth + 1)) & 255, node)
            mixed, seen = mix(mixed, seen, zeros[one], ones[one], own_1[one], bit)
            mixed, _ = mix(mixed, seen, zeros_0[node], ones_0[node], own_0[node], bit)
            log10p[a:b] = np.log10(mixed).sum(axis=0)
        values = [pack(log10p[np.searchsorted(key, unpack(k))]) for k in part["keys"].to_pylist()]
        return pa.table({"block": part["block"], "part": part["part"],
                         "values": pa.array(values, pa.binary())})

    return found.groupBy("part").applyInArrow(lengths, "block long, part long, values binary")
