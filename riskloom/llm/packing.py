"""Operator 4, harmonic packing of token sequences.

Classes are reciprocals of the capacity: a bin of class j takes exactly j pieces of at most
``capacity / j`` ids, so a bin is finished by counting and no worker needs to know another's bins.
Documents may be cut, so the wide classes are met exactly: whole capacities, then halves, quarters,
... down to ``capacity / finest`` are cut off a document and fill their bins without a gap. Only the
last rest of a document goes to a class that is a little wider than it is: less than one part in
``finest`` of a bin. Rests under ``capacity / last`` share the last class. When a worker's input ends, the
pieces of its unfinished bins are poured one after the other into common bins, cut where one is
full, so a worker leaves one sequence with padding at most.

One narrow stage: nothing is shuffled, memory is the open bins (below ``capacity`` ids per class).

Defined cases: a null or empty text is the end id alone; a null ``doc_id`` stays null; repeated rows
are packed as often as they occur; an empty table gives no piece; extra columns are ignored. Sequence
ids are unique (partition number and a running number), not consecutive.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.tables import PART, partition_number
from riskloom.llm.tokens import coder
from riskloom.llm.words import arrow_schema, whole_number

PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
         "sequence_id long, `offset` long")
#: Rows per output batch.
ROWS = 20_000


class Bins:
    """The open bins of one worker."""

    def __init__(self, capacity: int, finest: int, last: int, first_id: int):
        self.capacity, self.finest, self.last = capacity, finest, last
        self.next_id = first_id
        self.open: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        """Cut a document (4 bytes per id) and deal its pieces to their classes."""
        total, start = len(ids) // 4, 0
        for length, kind in cuts(total, self.capacity, self.finest, self.last):
            piece = (doc_id, start, length, total, ids[4 * start:4 * (start + length)])
            start += length
            if kind == 1:
                self.close([piece])
                continue
            held = self.open.setdefault(kind, [])
            held.append(piece)
            if len(held) == kind:
                self.close(self.open.pop(kind))

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, length, total, ids in pieces:
            self.done.append((doc_id, start, length, crc32(ids), total, self.next_id, offset, ids))
            offset += length
        self.next_id += 1

    def pour(self) -> None:
        """Empty the unfinished bins into common ones."""
        held, room = [], self.capacity
        for kind in sorted(self.open):
            for doc_id, start, length, total, ids in self.open[kind]:
                while length:
                    part = min(length, room)
                    held.append((doc_id, start, part, total, ids[:4 * part]))
                    start, length, room, ids = start + part, length - part, room - part, ids[4 * part:]
                    if not room:
                        self.close(held)
                        held, room = [], self.capacity
        if held:
            self.close(held)
        self.open.clear()


def cuts(total: int, capacity: int, finest: int, last: int) -> Iterator[tuple[int, int]]:
    """(length, class) of each piece of a document of ``total`` ids."""
    kind = 1
    while total and kind <= finest:
        size = capacity // kind
        for _ in range(total // size):
            yield size, kind
        total %= size
        kind *= 2
    if total:
        yield total, min(last, capacity // total)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, finest: int = 16,
         last: int = 64, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place; ``with_ids`` adds the ids (little-endian
    unsigned 32-bit) for whoever writes the sequences. ``capacity`` is a multiple of ``finest``,
    ``tokenizer`` the path of a tokenizer file on every worker."""
    if capacity % finest or last < finest:
        raise ValueError("capacity must be a multiple of finest, and last at least finest")
    schema = T.StructType.fromDDL(PIECE + (", ids binary" if with_ids else ""))
    target = arrow_schema(schema)
    end = array("I", [end_id]).tobytes()

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))[:len(target)] if rows else [[]] * len(target)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, ids = None, coder(tokenizer).ids
        for batch in batches:
            if bins is None and len(batch):
                bins = Bins(capacity, finest, last, batch.column(PART)[0].as_py() << 33)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bins.add(doc_id, ids(text or "") + end)
                if len(bins.done) >= ROWS:
                    yield out(bins.done)
                    bins.done = []
        if bins is not None:
            bins.pour()
            yield out(bins.done)

    return docs.select(whole_number("doc_id"), "text", partition_number()).mapInArrow(run, schema)


def sequences(pieces: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """The sequences themselves from ``pack(..., with_ids=True)``: ``ids`` as bytes, padded to the
    capacity unless their number is a power of two. A group is one sequence, so it is bounded."""
    whole = F.expr("aggregate(array_sort(collect_list(struct(`offset`, ids))), x'', "
                   "(a, p) -> concat(a, p.ids))")
    pad = array("I", [pad_id]).tobytes().hex()
    filled = F.expr(f"unhex(rpad(hex(ids), {8 * capacity}, '{pad}'))")
    n = F.expr("cast(length(ids) / 4 as long)")
    return (pieces.groupBy("sequence_id").agg(whole.alias("ids"), F.sum("length").alias("n_tokens"))
            .withColumn("ids", F.when(n.bitwiseAND(n - 1) == 0, F.col("ids")).otherwise(filled)))
