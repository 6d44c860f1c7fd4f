"""Operator 8 over the running text: the contexts of :mod:`riskloom.llm.ctw` across the ends of words.

A document is its words in lower case with single spaces, a line end as its end, and a space after that;
the context of a byte are the bytes before it up to the model's depth, reset only where a document starts.
Texts are cut into blocks that are kept; a block sends each distinct symbol in its context once, with its
training count, packed by parts of all keys, and gets the code lengths back in the same order, so what is moved
follows the distinct contexts of a block and not its bytes. A part holds whole branches of the context trees,
which are weighted where its keys meet. The distinct words of a block travel in the same way for their counts.

Defined cases: a null, empty or blank text is its end alone; a null ``doc_id`` is held out (crc32 of the
empty text), as all documents whose crc32 leaves 0; with no training document every probability is the
estimate of no counts; repeated rows train and score as often as they occur; extra columns are ignored; an
empty table gives no rows. Without a ``group`` column all documents are one group; values beyond the
``GROUPS`` most frequent of the training documents, and null, share a group of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.ctw import (DEPTH, END, _held, code_lengths, group_numbers, held_out, marked, pack,
                              spell, unpack)
from riskloom.llm.frequencies import blocks
from riskloom.llm.tables import keep, partition_number
from riskloom.llm.words import arrow_schema, lower_words

#: Bytes of text that are spelled at once.
SLICE = 1 << 18
#: Bytes of text of a block: its distinct contexts are sorted in memory.
BLOCK_BYTES = 14 << 20
#: ``data`` is compressed here: the codecs of files and shuffles keep half as much again.
BLOCK = "block long, ids array<bigint>, bytes array<bigint>, ends array<bigint>, data binary"


def running(text: bytes) -> bytes:
    """A marked text as it is spelled, but for the last space."""
    return text[:1] + b" ".join([*lower_words(text[1:]), END])


def block_table(texts: DataFrame) -> DataFrame:
    """A row per block: the documents' ids, their sizes, their running texts and where these end."""
    target = arrow_schema(T.StructType.fromDDL(BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shrink = zstandard.ZstdCompressor(level=3).compress
        for number, ids, found in blocks(batches, BLOCK_BYTES):
            spelled = [running(t) for t in found]
            ends = np.cumsum([len(t) for t in spelled]).tolist()
            row = [[number], [ids], [[len(t) for t in found]], [ends], [shrink(b"".join(spelled))]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(row, target)], schema=target)

    return keep(texts.select("*", partition_number()).mapInArrow(run, BLOCK))


def documents(ends: list[int], data: bytes) -> list[bytes]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def slices(found: list[bytes]) -> Iterator[tuple[int, int]]:
    """First and end of runs of documents of about SLICE bytes."""
    first = size = 0
    for i, t in enumerate(found):
        size += len(t)
        if size >= SLICE:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(found):
        yield first, len(found)


def all_keys(found: list[bytes], depth: int) -> np.ndarray:
    """Every symbol in its context, in order."""
    key, done = np.empty(sum(len(t) for t in found), np.int64), 0
    for a, b in slices(found):
        _, one = spell(found[a:b], depth)
        key[done:done + len(one)] = one
        done += len(one)
    return key


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each occurs; ``key`` is sorted in place."""
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.append(first, len(key)))


def distinct_keys(found: list[bytes], learned: list[bool], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct symbols in context of a block, sorted, and their training counts."""
    known, times = distinct(all_keys([t for t, yes in zip(found, learned) if yes], depth))
    other, _ = distinct(all_keys([t for t, yes in zip(found, learned) if not yes], depth))
    key, _ = distinct(np.concatenate([known, other]))
    count = np.zeros(len(key), np.int64)
    count[np.searchsorted(key, known)] = times
    return key, count


def by_part(key: np.ndarray, depth: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys by part and inside a part as they are, and where parts begin. A part is a
    share of the branches, contexts that end in the same two bytes."""
    mixed = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    of_branch = ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.min_scalar_type(parts))
    part = of_branch[(key >> 8 * depth) & 0xFFFF]
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def packed(number: int, parts: Iterable[int], first: list[bytes], counts: list[bytes], name: str
           ) -> pa.RecordBatch:
    parts = list(parts)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(parts), number)), pa.array(parts, pa.int64()),
         pa.array(first, pa.binary()), pa.array(counts, pa.binary())],
        names=["block", "part", name, "counts"])


def block_keys(stored: DataFrame, depth: int, parts: int) -> DataFrame:
    """A row per block and part: the distinct symbols in context, sorted, and their training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                number, ids, ends, data = (c[i].as_py() for c in batch.columns)
                key, c = distinct_keys(documents(ends, data), [not held_out(d) for d in ids], depth)
                order, edges = by_part(key, depth, parts)
                key, c = key[order], c[order]
                spans = [(p, slice(a, b)) for p, (a, b) in enumerate(
                    zip(edges[:-1].tolist(), edges[1:].tolist())) if b > a]
                yield packed(number, [p for p, _ in spans], [pack(key[s]) for _, s in spans],
                             [pack(c[s]) for _, s in spans], "keys")

    return keep(stored.select("block", "ids", "ends", "data").mapInArrow(
        run, "block long, part long, keys binary, counts binary"))


def words_by_part(found: Iterable[bytes], parts: int) -> dict[int, list[bytes]]:
    """Distinct words, sorted, by part."""
    out: dict[int, list[bytes]] = {}
    for w in sorted(found):
        out.setdefault(crc32(w) % parts, []).append(w)
    return out


def block_words(stored: DataFrame, parts: int) -> DataFrame:
    """A row per block and part: the distinct words, sorted, and their training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shrink = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for i in range(len(batch)):
                number, ids, ends, data = (c[i].as_py() for c in batch.columns)
                counted: Counter[bytes] = Counter()
                other: set[bytes] = set()
                for ident, t in zip(ids, documents(ends, data)):
                    (other if held_out(ident) else counted).update(t[1:].split(b" "))
                for w in other:
                    counted.setdefault(w, 0)
                dealt = words_by_part(counted, parts)
                yield packed(number, dealt, [shrink(b" ".join(ws)) for ws in dealt.values()],
                             [pack(np.array([counted[w] for w in ws], np.int64))
                              for ws in dealt.values()], "words")

    return stored.select("block", "ids", "ends", "data").mapInArrow(
        run, "block long, part long, words binary, counts binary")


def word_counts(found: DataFrame) -> DataFrame:
    """``found`` with the training counts in all blocks as ``values``; one row of each part has the
    number of its words with a count and the sum of these counts, the others zeros."""
    def run(table: pa.Table) -> pa.Table:
        import zstandard

        grow = zstandard.ZstdDecompressor().decompress
        asked = [grow(w).split(b" ") for w in table["words"].to_pylist()]
        every: Counter[bytes] = Counter()
        for words, counts in zip(asked, table["counts"].to_pylist()):
            for w, c in zip(words, unpack(counts).tolist()):
                every[w] += c
        values = [pack(np.array([every[w] for w in words], np.int64)) for words in asked]
        rest = [0] * (len(values) - 1)
        return pa.table({"block": table["block"], "part": table["part"],
                         "values": pa.array(values, pa.binary()),
                         "known": pa.array([sum(c > 0 for c in every.values()), *rest], pa.int64()),
                         "total": pa.array([sum(every.values()), *rest], pa.int64())})

    return keep(found.groupBy("part").applyInArrow(
        run, "block long, part long, values binary, known long, total long"))


SUMS = ("doc_id long, number int, n_bytes long, n long, known long, base double, score double")


def added(stored: DataFrame, values: DataFrame, depth: int, parts: int, known: int, total: int
          ) -> DataFrame:
    """The sums of every document over its words and its symbols. ``values`` has both for each block, those
    of words under the part less ``parts``."""
    target = arrow_schema(T.StructType.fromDDL(SUMS))

    def base_of(docs: list[bytes], count: dict[int, bytes]) -> tuple[dict[bytes, float], float]:
        every: set[bytes] = set()
        for t in docs:
            every.update(t[1:].split(b" "))
        smoothed = total + 0.1 * (known + 1)
        out: dict[bytes, float] = {}
        for p, words in words_by_part(every, parts).items():
            out.update(zip(words, np.log10((unpack(count[p]) + 0.1) / smoothed).tolist()))
        return out, float(np.log10((np.zeros(1) + 0.1) / smoothed)[0])

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        given = dict(zip(found["part"].to_pylist(), found["values"].to_pylist()))
        out = []
        for row in texts.to_pylist():
            docs = documents(row["ends"], row["data"])
            key, _ = distinct(all_keys(docs, depth))
            length = np.empty(len(key))
            length[by_part(key, depth, parts)[0]] = np.concatenate(
                [unpack(given[p], np.float64) for p in range(parts) if p in given])
            score = np.zeros(len(docs))
            for a, b in slices(docs):
                place, asked = spell(docs[a:b], depth)
                order = np.argsort(asked)  # a search for sorted keys stays near the last one found
                score[a:b] = np.bincount(
                    place[order], length[np.searchsorted(key, asked[order])], b - a)
            base, unknown = base_of(docs, {p + parts: v for p, v in given.items() if p < 0})
            for ident, size, t, s in zip(row["ids"], row["bytes"], docs, score.tolist()):
                each = [base[w] for w in t[1:].split(b" ")]
                out.append((ident, t[0], size, len(each), len(each) - each.count(unknown),
                            sum(each), s))
        columns = list(zip(*out)) if out else [[]] * len(target)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    return stored.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(run, SUMS)


def running_scores(docs: DataFrame, depth: int = DEPTH, group: str | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and
    ``score`` (log10 probability of the running text, given the group) of every document, and its
    ``bits_per_byte``."""
    if not 2 <= depth <= 6:
        raise ValueError("depth from 2 to 6")
    numbers = group_numbers(docs, group)
    texts = marked(docs, group, numbers)
    stored = block_table(texts)
    # the nodes of a part are weighted in memory, some 500 bytes for a key
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = word_counts(block_words(stored, parts))
    known, total = words.agg(F.coalesce(F.sum("known"), F.lit(0)),
                             F.coalesce(F.sum("total"), F.lit(0))).first()
    keys = block_keys(stored, depth, parts)
    values = code_lengths(keys, depth).unionByName(
        words.select("block", (F.col("part") - parts).alias("part"), "values"))
    found = added(stored, values, depth, parts, known, total)
    return found.select(
        "doc_id", _held(found).alias("held_out"), F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"))
