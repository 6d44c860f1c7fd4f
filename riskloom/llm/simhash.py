"""Operator 1, SimHash near-duplicates by anchor-point covering.

A covering code cuts the 64-bit space into balls: every fingerprint has an anchor (code word) within
the covering radius. The code here is a product of four perfect codes over the fingerprint's bits:
two binary Golay codes (23 bits, radius 3) and two repetition codes (9 bits, radius 4), 2**26 anchors
in all. Perfect codes have exactly one word within the radius, so each fingerprint has one home.

Two fingerprints that differ in at most ``threshold`` bits meet at the home of either: what lies
within the radius of an anchor in each factor reaches, with ``threshold`` further bits to spend over
the factors, the same anchor from the other fingerprint. Each distinct fingerprint is therefore sent
to every anchor within radius plus threshold (about 70 for two bits), and an anchor's homes are
compared with its visitors. Exact copies are one fingerprint and meet nobody.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other; a null
``doc_id`` stays null and is never a component's name unless all its documents lack an id; repeated
rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.components import components
from riskloom.llm.tables import keep
from riskloom.llm.words import lower_words, per_row, whole_number

GOLAY_BITS, GOLAY_RADIUS = 23, 3
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
REPEAT_BITS, REPEAT_RADIUS = 9, 4


def fingerprint(text: bytes, size: int = 3) -> int:
    """Signed 64-bit SimHash over the word shingles of a text, repeats included."""
    import xxhash

    tokens = lower_words(text)
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = len(tokens) - size + 1
    if n < 2:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], "<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        starts = np.append(0, ends[:-1])[:n].tolist()
        stops = (ends[size - 1:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], "<u8")
    bits = np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3, carried: list[F.Column] | None = None) -> DataFrame:
    """``doc_id``, or the named columns ``carried``, and ``fp`` of every document, one narrow stage."""
    columns = carried or [whole_number("doc_id")]
    given = docs.select(*columns).schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given)
    return per_row(docs, f"{schema}, fp long",
                   lambda d: [*(d[c] for c in given.names),
                              [fingerprint(t, size) for t in d["text"]]],
                   [*columns, "text"])


def _remainder(word: int) -> int:
    """The 11-bit remainder of a 23-bit word by the generator: equal inside a coset of the code."""
    for shift in range(GOLAY_BITS - 1, 10, -1):
        if word >> shift & 1:
            word ^= GOLAY << (shift - 11)
    return word


@lru_cache
def golay_tables(threshold: int):
    """Remainders by the low 12 and high 11 bits, and for each remainder the error patterns up to
    radius + threshold, lightest first: (patterns, start of a remainder, how many within a budget)."""
    unit = [_remainder(1 << i) for i in range(GOLAY_BITS)]

    def table(first: int, bits: int) -> np.ndarray:
        out = np.zeros(1 << bits, np.int64)
        for i in range(bits):
            out[1 << i:2 << i] = out[:1 << i] ^ unit[first + i]
        return out

    found: list[tuple[int, int, int]] = []
    for weight in range(GOLAY_RADIUS + threshold + 1):
        for places in combinations(range(GOLAY_BITS), weight):
            pattern = rest = 0
            for p in places:
                pattern |= 1 << p
                rest ^= unit[p]
            found.append((rest, max(0, weight - GOLAY_RADIUS), pattern))
    found.sort()
    rests, excess, patterns = (np.array(c, np.int64) for c in zip(*found))
    start = np.searchsorted(rests, np.arange(2048))
    within = np.stack([np.bincount(rests[excess <= t], minlength=2048)
                       for t in range(threshold + 1)])
    return table(0, 12), table(12, 11), patterns, excess, start, within


def anchors(values: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``values``, anchor) of every anchor within radius + ``threshold`` of each 64-bit value."""
    low, high, patterns, excess, start, within = golay_tables(threshold)
    row = np.arange(len(values))
    anchor = np.zeros(len(values), np.int64)
    budget = np.full(len(values), threshold)
    words = values.view("u8") if values.dtype == np.int64 else values

    def choices(n: np.ndarray) -> np.ndarray:
        """Number of each choice among its row's ``n``."""
        return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)

    for shift in (0, GOLAY_BITS):
        part = ((words[row] >> np.uint64(shift)) & np.uint64((1 << GOLAY_BITS) - 1)).astype(np.int64)
        rest = low[part & 4095] ^ high[part >> 12]
        n = within[budget, rest]
        pick = np.repeat(start[rest], n) + choices(n)
        row, budget = np.repeat(row, n), np.repeat(budget, n) - excess[pick]
        anchor = (np.repeat(anchor, n) << GOLAY_BITS) | (np.repeat(part, n) ^ patterns[pick])
    for shift in (2 * GOLAY_BITS, 2 * GOLAY_BITS + REPEAT_BITS):
        part = (words[row] >> np.uint64(shift)) & np.uint64((1 << REPEAT_BITS) - 1)
        ones = np.bitwise_count(part).astype(np.int64)
        bit = (ones > REPEAT_RADIUS).astype(np.int64)
        far = np.maximum(ones, REPEAT_BITS - ones) - REPEAT_RADIUS  # what the other word would cost
        n = 1 + (far <= budget)
        other = choices(n)
        row, bit, far = np.repeat(row, n), np.repeat(bit, n), np.repeat(far, n)
        budget = np.repeat(budget, n) - other * far
        anchor = (np.repeat(anchor, n) << 1) | (bit ^ other)
    return row, anchor


def at_anchors(prints: DataFrame, threshold: int, name: str) -> DataFrame:
    """``anchor`` and the fingerprint as ``name``, a row per anchor within radius + threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for i in range(0, len(values), 2000):
                part = values[i:i + 2000]
                row, anchor = anchors(part, threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(part[row])], names=["anchor", name])

    return prints.select("fp").mapInArrow(run, f"anchor long, {name} long")


def links(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """Every pair of distinct fingerprints (column ``fp``) at most ``threshold`` bits apart, once."""
    homes = at_anchors(prints, 0, "a")
    visitors = at_anchors(prints, threshold, "b")
    return (visitors.join(homes, "anchor")
            .where((F.col("a") < F.col("b"))
                   & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold))
            .select("a", "b"))


def near_duplicates(docs: DataFrame, size: int = 3, threshold: int = 2) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest doc_id that a
    chain of links reaches) of every document."""
    rows = keep(fingerprints(docs, size))
    prints = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(prints, threshold))
    rooted = (prints.join(roots, prints["fp"] == roots["node"], "left")
              .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return (rows.join(rooted.join(named, "root").select("fp", "component_id"), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id"))


def one_per_group(docs: DataFrame, size: int = 3, threshold: int = 2) -> DataFrame:
    """One row of each component, all columns: that with the smallest id and, among equal ids, the
    smallest hash of its text; rows without an id come last. Of rows equal in both one stays."""
    place = {"_none": F.col("doc_id").isNull(), "_id": F.coalesce(whole_number("doc_id"), F.lit(0)),
             "_sum": F.xxhash64(F.coalesce("text", F.lit("")))}
    carried = [c.alias(name) for name, c in place.items()]
    rows = keep(fingerprints(docs, size, carried))
    prints = keep(rows.select("fp").distinct())
    roots = components(links(prints, threshold))
    first = (rows.join(roots, rows["fp"] == roots["node"], "left")
             .groupBy(F.coalesce("root", "fp")).agg(F.min(F.struct(*place)).alias("place"))
             .select("place.*"))
    own = docs.withColumns(place)
    return own.join(first, list(place), "left_semi").dropDuplicates(list(place)).select(
        *(F.col(f"`{c}`") for c in docs.columns))
