"""Per-document term frequencies as block postings, and sums of term values back to documents.

A corpus has a row per document and term; written out one by one these rows outweigh the texts.
Here each task turns a block of documents into one row per distinct term with the documents and
frequencies inside the block packed together. Joining a table of term values to such rows moves each
term once per block, so even a term of every document is a row per block, and the values come back
as partial sums per document.

Documents are addressed by (block, place), so null and repeated ids need no care. A block's ids and
measures travel as one extra row whose term is the block's own number, which spreads these rows. Partial
sums stay packed too: a row per task and block, added up block by block at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.tables import PART, partition_number
from riskloom.llm.words import arrow_schema, utf8, whole_number

#: Bytes of text and documents after which a task closes a block; a longer text is its own block.
BLOCK_BYTES, BLOCK_DOCS = 24 << 20, 1 << 15

#: cut(texts) -> (distinct terms, term number and document place of every occurrence, both ascending
#: by place)
Cut = Callable[[list[bytes]], tuple[list[bytes], np.ndarray, np.ndarray]]


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES
           ) -> Iterator[tuple[int, list, list[bytes]]]:
    """(block number, ids, texts) of batches of an id, a text and the partition's number: block numbers
    are unique over all partitions."""
    number, ids, texts, size = -1, [], [], 0
    for batch in batches:
        if number < 0 and len(batch):
            number = batch.column(PART)[0].as_py() << 32
        for i, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= limit or len(ids) >= BLOCK_DOCS:
                yield number, ids, texts
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield number, ids, texts


def cut_words(split: Callable[[bytes], list[bytes]]) -> Cut:
    """Terms are what ``split`` returns."""
    def cut(texts: list[bytes]):
        number: dict[bytes, int] = {}
        found, sizes = [], []
        for t in texts:
            tokens = split(t)
            found.append(np.fromiter([number.setdefault(w, len(number)) for w in tokens],
                                     np.int64, len(tokens)))
            sizes.append(len(tokens))
        term = np.concatenate(found) if found else np.zeros(0, np.int64)
        return list(number), term, np.repeat(np.arange(len(texts)), sizes)
    return cut


POSTINGS = "term binary, block long, post binary"
ENTRY = np.dtype([("place", "<u2"), ("times", "u1")])  # three bytes


def block_row(number: int, ids: list[int | None], texts: list[bytes], target: pa.Schema
              ) -> pa.RecordBatch:
    """The ids and sizes of a block's documents, under a negative block number."""
    post = np.array([i or 0 for i in ids], "<i8").tobytes() \
        + np.array([len(t) for t in texts], "<i8").tobytes() + bytes(i is not None for i in ids)
    return pa.RecordBatch.from_arrays(
        [pa.array([b"\x00%d" % number], pa.binary()), pa.array([-number - 1], pa.int64()),
         pa.array([post], pa.binary())], schema=target)


def postings(docs: DataFrame, cut: Cut, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per block and term: ``post`` holds an entry for each document of the block with the
    term, its place and how often it occurs (more than 255 times: several entries); and one row per
    block with its documents."""
    schema = T.StructType.fromDDL(POSTINGS)
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, texts in blocks(batches):
            yield block_row(number, ids, texts, target)
            terms, term, place = cut(texts)
            pairs, times = np.unique(term * (1 << 16) + place, return_counts=True)
            if len(times) and times.max() > 255:
                n = -(-times // 255)
                pairs = np.repeat(pairs, n)
                full = np.full(len(pairs), 255)
                full[np.cumsum(n) - 1] = times - 255 * (n - 1)
                times = full
            term = pairs >> 16
            entries = np.empty(len(pairs), ENTRY)
            entries["place"], entries["times"] = pairs & 0xFFFF, times
            starts = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) \
                else np.zeros(0, np.int64)
            offsets = (np.append(starts, len(term)) * ENTRY.itemsize).astype("<i4")
            post = pa.Array.from_buffers(
                pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()),
                                           pa.py_buffer(entries.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array([terms[i] for i in term[starts]], pa.binary()),
                 pa.array(np.full(len(starts), number)), post], schema=target)

    return docs.select(whole_number(key), text, partition_number()).mapInArrow(run, schema)


def vocabulary(docs: DataFrame, cut: Callable[[list[bytes]], list[bytes]], text: str = "text",
               key: str = "doc_id") -> DataFrame:
    """Every distinct term that ``cut`` finds in a block's texts."""
    schema = T.StructType.fromDDL("term binary")
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cut(texts), pa.binary())], schema=target)

    return docs.select(whole_number(key), text, partition_number()).mapInArrow(
        run, schema).distinct()


#: Entries a task gathers before it adds them up and hands the sums on.
HELD = 1 << 22
PARTIAL = "block long, places binary, totals binary"


def partial_sums(joined: DataFrame, values: list[str]) -> DataFrame:
    """Sums of the values of a task's terms: a row per block, with the places (u2) and for each value
    its sums (f8) one after the other."""
    schema = T.StructType.fromDDL(PARTIAL)
    target = arrow_schema(schema)
    k = len(values)

    def added(held: list[tuple]) -> pa.RecordBatch:
        block, place = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        weights = np.concatenate([h[2] for h in held], axis=1)
        numbers, slot = np.unique(block, return_inverse=True)
        cells, at = np.unique(slot * (1 << 16) + place, return_inverse=True)
        totals = np.stack([np.bincount(at, w, len(cells)) for w in weights])
        edges = np.searchsorted(cells >> 16, np.arange(len(numbers) + 1))
        places = (cells & 0xFFFF).astype("<u2")
        spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers), pa.array([places[a:b].tobytes() for a, b in spans], pa.binary()),
             pa.array([totals[:, a:b].tobytes() for a, b in spans], pa.binary())], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            block = batch.column(0).to_numpy()
            post = batch.column(1)
            blocks_here = np.flatnonzero(block < 0)
            if len(blocks_here):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[blocks_here]), post.take(pa.array(blocks_here)),
                     pa.nulls(len(blocks_here), pa.binary())], schema=target)
                terms = np.flatnonzero(block >= 0)
                block, post = block[terms], post.take(pa.array(terms))
                weights = [batch.column(2 + j).take(pa.array(terms)) for j in range(k)]
            else:
                weights = [batch.column(2 + j) for j in range(k)]
            if not len(block):
                continue
            offsets = np.frombuffer(post.buffers()[1], "<i4")[post.offset:post.offset + len(post) + 1]
            n = np.diff(offsets) // ENTRY.itemsize
            entries = np.frombuffer(post.buffers()[2], ENTRY, int(n.sum()), int(offsets[0]))
            times = entries["times"].astype(float)
            held.append((np.repeat(block, n), entries["place"].astype(np.int64), np.stack(
                [times * np.repeat(w.to_numpy(zero_copy_only=False).astype(float), n)
                 for w in weights])))
            size += len(entries)
            if size >= HELD:
                yield added(held)
                held, size = [], 0
        if held:
            yield added(held)

    return joined.select("block", "post", *values).mapInArrow(run, schema)


def sums(joined: DataFrame, values: list[str]) -> DataFrame:
    """``joined`` is :func:`postings` with the numeric columns ``values`` of each term (null for the
    block rows): per document ``doc_id``, ``n_bytes`` and the frequency-weighted sums of the values
    as doubles, exact for whole numbers below 2**53."""
    schema = T.StructType.fromDDL(
        "doc_id long, n_bytes long, " + ", ".join(f"{v} double" for v in values))
    target = arrow_schema(schema)
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((k, BLOCK_DOCS))
        for batch in batches:
            for block, places, totals in zip(*(c.to_pylist() for c in batch.columns)):
                if block >= 0:
                    table[:, np.frombuffer(places, "<u2")] += np.frombuffer(totals).reshape(k, -1)
                    continue
                n = len(places) // 17  # a block's documents come after all its sums
                missing = np.frombuffer(places, "u1", n, 16 * n) == 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(places, "<i8", n), mask=missing),
                     pa.array(np.frombuffer(places, "<i8", n, 8 * n)),
                     *(pa.array(table[j, :n].copy()) for j in range(k))], schema=target)
                table[:] = 0

    number = F.when(F.col("block") < 0, -F.col("block") - 1).otherwise(F.col("block"))
    return (partial_sums(joined, values).withColumn("number", number)
            .repartition("number").sortWithinPartitions("number", F.col("block").desc())
            .select("block", "places", "totals").mapInArrow(run, schema))
