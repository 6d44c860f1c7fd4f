"""Operator 6, token files: one concatenated id array with Elias-Fano document boundaries.

Documents are dealt to shards by ranges of doc_id, so shards in order are the corpus in order. A shard
is a sequence of segments, each a self-contained byte string in the file format below; segments are
the rows of a Parquet folder, whose writer commits per task, so a lost executor leaves no half file and
any file system that Spark reaches will do.

    magic ``TIDS``, version, bytes per id (2 or 4), number of leading documents without an id
    Elias-Fano code of the document ends (ids before and including each document)
    Elias-Fano code of the doc_ids, ascending
    the ids, little-endian

Select on the ends gives a document's place in the id array; 64-bit offset tables are not stored. A
segment row also names the ids before it in its shard; those of earlier shards follow from one sum per
shard, whose number is that of the write's partitions.

Defined cases: a null or empty text is the end id alone; documents without doc_id come first; documents
that share a doc_id follow each other in order of their text's hash; an empty table gives an empty
folder; extra columns are ignored.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.eliasfano import Decoder, encode
from riskloom.llm.tables import PART, partition_number
from riskloom.llm.tokens import coder
from riskloom.llm.words import arrow_schema

HEAD = struct.Struct("<4sBBq")
#: Ids after which a segment ends; a longer document is a segment of its own.
SEGMENT_IDS = 1 << 20
SEGMENT = "shard int, segment int, ids_before long, n_ids long, n_docs long, data binary"


def pack_segment(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """A segment's bytes from its documents' ids (32 bits each, in order)."""
    given = [d for d in doc_ids if d is not None]
    head = HEAD.pack(b"TIDS", 1, width, len(doc_ids) - len(given))
    numbers = np.frombuffer(ids, "<u4").astype(f"<u{width}")
    return b"".join([head, encode(np.cumsum(lengths, dtype=np.int64)),
                     encode(np.array(given, np.int64)), numbers.tobytes()])


class Segment:
    """A segment read back: ``doc_ids``, ``ends`` and the ids as 32-bit numbers."""

    def __init__(self, data: bytes):
        magic, version, width, without = HEAD.unpack_from(data)
        if magic != b"TIDS" or version != 1:
            raise ValueError("not a token segment")
        self.boundaries = Decoder(data, HEAD.size)
        named = Decoder(data, self.boundaries.end)
        self.doc_ids = [None] * without + named.all().tolist()
        self.ids = np.frombuffer(data, f"<u{width}", offset=named.end)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document."""
        first, last = self.span(i)
        return self.ids[first:last].astype("<u4")

    def span(self, i: int) -> tuple[int, int]:
        ends = self.boundaries.select(np.array([i - 1, i] if i else [i]))
        return (int(ends[0]) if i else 0, int(ends[-1]))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int,
                 segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every document, append ``end_id`` and write the segments below ``path``."""
    schema = T.StructType.fromDDL(SEGMENT)
    target = arrow_schema(schema)
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer)
        top = max(end_id, code.tokenizer.get_vocab_size(with_added_tokens=True) - 1)
        width = 2 if top < 1 << 16 else 4
        shard, segment, before = None, 0, 0
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            data = pack_segment(doc_ids, lengths, b"".join(held), width)
            values = (shard, segment, before, size, len(doc_ids), data)
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(values, target)], schema=target)

        for batch in batches:
            if shard is None and len(batch):
                shard = batch.column(PART)[0].as_py()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = code.ids(text or "") + end
                if size and size + len(ids) // 4 > segment_ids:
                    yield row()
                    segment, before, size = segment + 1, before + size, 0
                    doc_ids, lengths, held = [], [], []
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4)
                held.append(ids)
                size += len(ids) // 4
        if doc_ids:
            yield row()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(
        "tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    (named.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
     .select("doc_id", "text", partition_number()).mapInArrow(run, schema)
     .write.option("compression", "zstd").parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids_crc32`` of every
    document, from the files alone."""
    files = spark.read.schema(SEGMENT).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()  # a row per partition
    first, starts = 0, []
    for r in sorted(totals, key=lambda r: r.shard):
        starts.append((r.shard, first))
        first += r.n
    shards = spark.createDataFrame(starts, "shard int, shard_start long")
    schema = T.StructType.fromDDL("doc_id long, start long, n_tokens long, ids_crc32 long")
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                segment = Segment(data)
                ends = segment.boundaries.all()
                begins = np.append(0, ends[:-1]).astype(np.int64)
                ids = segment.ids.astype("<u4")
                sums = [crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segment.doc_ids, pa.int64()), pa.array(begins + start),
                     pa.array(ends - begins), pa.array(sums, pa.int64())], schema=target)

    # the starts are one row per shard, that is per partition of the write
    return (files.join(F.broadcast(shards), "shard")
            .select((F.col("shard_start") + F.col("ids_before")).alias("start"), "data")
            .mapInArrow(run, schema))
