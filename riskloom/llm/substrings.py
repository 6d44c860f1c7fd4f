"""Operator 2, substring dedup with compressed full-text indexes.

Which words to remove: those covered by a window of ``window`` words whose sequence starts anywhere
else too. Streaming every document past an index of every shard would compare all with all, so windows
are routed: the smallest ``gram``-word hash inside a window (its minimizer) is the same wherever the
window occurs, and neighbouring windows mostly share it. A document is cut into segments, maximal runs
of windows with the minimizer at one place.

1. Minimizers that occur once in the corpus cannot belong to a repeated window; their segments end
   here, as 64-bit hashes, before any text has moved.
2. Segments with the same words are one segment with a multiplicity, so groups of copies of any size
   arrive at their shard once. Segments of minimizers that still have very many distinct segments
   around them are cut into single windows, which deals them by their own hash.
3. A shard is a range of segments that share minimizers. It builds a compressed FM-index over its
   segments (suffix order, Burrows-Wheeler transform, wavelet matrix over word numbers) and streams
   them through it: backward search extends each match to the left as far as the interval holds two
   occurrences and reports maximal intervals of at least ``window`` words.
4. Intervals go back to every occurrence of a segment, are merged per document and cut out.

Documents are addressed by id and text hash, so equal rows share their result and null ids work.

Defined cases: a null, empty or blank text has no words and nothing to remove; texts shorter than the
window lose nothing; repeated rows count as occurrences elsewhere, so both lose all their windows;
extra columns are ignored by :func:`substring_dedup` and kept by :func:`without_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.fmindex import FMIndex
from riskloom.llm.tables import drop, keep
from riskloom.llm.words import arrow_schema, utf8

WINDOW, GRAM = 35, 8
#: Distinct segments of one minimizer beyond which they are dealt as single windows.
CROWD = 20_000
#: Words of a shard's index; a shard ends at the next minimizer after that.
SHARD_WORDS = 400_000


def word_hashes(tokens: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    if len(known) > 500_000:
        known.clear()
    out = []
    for w in tokens:
        h = known.get(w)
        if h is None:
            h = known[w] = digest(w)
        out.append(h)
    return np.array(out, np.uint64)


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit hash of every run of ``size`` hashes."""
    n = len(hashes) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ hashes[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def segments(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, minimizer) of every segment of a document's words."""
    grams = rolling(hashes, gram)
    span = window - gram + 1
    n = len(grams) - span + 1
    best, at = grams.copy(), np.arange(len(grams))
    reach = 1  # best[i] is the minimum of grams[i:i + reach], at[i] its leftmost place
    while reach < span:
        step = min(reach, span - reach)
        a, b = best[:len(best) - step], best[step:]
        right = b < a
        at = np.where(right, at[step:], at[:len(at) - step])
        best = np.where(right, b, a)
        reach += step
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return first, np.diff(np.append(first, n)), best[first].view(np.int64)


def sequence_hashes(hashes: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of hashes[first : first + length] for each entry: a sum of position-dependent
    terms, read off prefix sums and brought back to the entry's own start."""
    base = np.uint64(0xD6E8FEB86659FD93)
    powers = np.cumprod(np.full(len(hashes) + 1, base, np.uint64))
    mixed = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    total = np.append(np.uint64(0), np.cumsum(mixed * powers[:-1], dtype=np.uint64))
    inverse = np.cumprod(np.full(len(hashes) + 1, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64))
    value = (total[first + length] - total[first]) * inverse[first]
    value ^= length.astype(np.uint64) << np.uint64(57)
    return (value ^ (value >> np.uint64(31))).view(np.int64)


SEGMENT = "mini long, seg long, id long, sum long, first int, n int"
#: A document is addressed by its id and the hash of its text (Spark's own xxhash64 of it).
SEED = 42


def text_sum(texts: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], np.uint64).view(np.int64)


def document_segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``mini``, ``seg`` (hash of the words), the document (``id``, ``sum``), ``first`` window and ``n``
    windows of every segment."""
    schema = T.StructType.fromDDL(SEGMENT)
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            texts = utf8(batch.column(1))
            parts: list[tuple] = []
            for doc_id, text, total in zip(batch.column(0).to_pylist(), texts, text_sum(texts)):
                tokens = text.split()
                if len(tokens) < window:
                    continue
                hashes = word_hashes(tokens, known)
                first, n, mini = segments(hashes, window, gram)
                parts.append((mini, sequence_hashes(hashes, first, n + window - 1), first, n,
                              doc_id, total))
            if not parts:
                continue
            sizes = [len(p[0]) for p in parts]
            ids = np.repeat(np.array([p[4] or 0 for p in parts], np.int64), sizes)
            none = np.repeat([p[4] is None for p in parts], sizes)
            sums = np.repeat(np.array([p[5] for p in parts], np.int64), sizes)
            mini, seg, first, n = (np.concatenate([p[i] for p in parts]) for i in range(4))
            yield pa.RecordBatch.from_arrays(
                [pa.array(mini), pa.array(seg), pa.array(ids, mask=none), pa.array(sums),
                 pa.array(first.astype("i4")), pa.array(n.astype("i4"))], schema=target)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def packed(docs: DataFrame) -> DataFrame:
    """The documents with ``text`` compressed, ``id`` and ``sum``, for shuffles; one narrow stage."""
    schema = T.StructType([
        *(T.StructField(f.name, T.BinaryType()) if f.name == "text" else f for f in docs.schema),
        T.StructField("_id", T.LongType()), T.StructField("_sum", T.LongType())])
    target = arrow_schema(schema)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = utf8(batch.column(at))
            given = batch.column(at).is_valid().to_pylist()
            columns = list(batch.columns)
            columns[at] = pa.array([compress(t) if g else None for t, g in zip(texts, given)],
                                   pa.binary())
            columns[-1] = pa.array(text_sum(texts))
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return docs.select("*", F.col("doc_id").cast("long").alias("_id"),
                       F.lit(0).cast("long").alias("_sum")).mapInArrow(run, schema)


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(target)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)


PIECE = "mini long, seg long, n int, twice boolean, words binary"
#: Pieces per output batch.
ROWS = 10_000


def segment_words(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of one occurrence of every wanted segment (``mini``, ``seg``, ``n``, ``twice`` and
    its place ``id``, ``sum``, ``first``). Rows that are equal yield a segment more than once."""
    schema = T.StructType.fromDDL(PIECE)
    target = arrow_schema(schema)
    lists = wanted.groupBy("id", "sum").agg(
        F.collect_list(F.struct("mini", "seg", "n", "twice", "first")).alias("found"))
    joined = packed(docs.select("doc_id", "text")).join(
        lists, F.expr("_id <=> id AND _sum = sum")).select("text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        plain = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows: list[tuple] = []
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = plain(text).split()
                for f in found:
                    rows.append((f["mini"], f["seg"], f["n"], f["twice"], b" ".join(
                        tokens[f["first"]:f["first"] + f["n"] + window - 1])))
                if len(rows) > ROWS:
                    yield _batch(rows, target)
                    rows = []
            yield _batch(rows, target)

    return joined.mapInArrow(run, schema)


HIT = "mini long, seg long, n int, spans array<int>"


def search_shards(pieces: DataFrame, window: int, shard_words: int) -> DataFrame:
    """``mini``, ``seg``, ``n`` and the word ranges (from, to, from, to, ... inside the segment) that
    its shard holds at least twice. A second row of the same segment is a second occurrence."""
    schema = T.StructType.fromDDL(HIT)
    target = arrow_schema(schema)

    def search(held: dict[tuple, list]) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        texts = []
        for _, words in held.values():
            tokens = words.split(b" ")
            texts.append(np.fromiter([number.setdefault(w, len(number)) for w in tokens], np.int64,
                                     len(tokens)))
        copies = [t for t, (twice, _) in zip(texts, held.values()) for _ in range(1 + twice)]
        found = FMIndex(copies, len(number)).repeats(texts, window)
        return _batch([(*key, spans) for key, spans in zip(held, found) if spans], target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        last, size = None, 0
        for batch in batches:
            for mini, seg, n, twice, words in zip(*(c.to_pylist() for c in batch.columns)):
                if mini != last and size >= shard_words:
                    yield search(held)
                    held, size = {}, 0
                last = mini
                if (mini, seg, n) in held:
                    held[mini, seg, n][0] = True
                else:
                    held[mini, seg, n] = [twice, words]
                    size += n + window
        yield search(held)

    return (pieces.repartition("mini").sortWithinPartitions("mini")
            .mapInArrow(run, schema))


def search_crowds(docs: DataFrame, crowded: DataFrame, window: int, shard_words: int) -> DataFrame:
    """As :func:`search_shards` for segments whose minimizers have very many around them: each window
    goes its own way by its own hash, equal windows are counted before they move."""
    schema = T.StructType.fromDDL("mini long, seg long, n int, `at` int, win long, words binary")
    target = arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows: list[tuple] = []
            for mini, seg, n, _, words in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = words.split(b" ")
                for i in range(n):
                    part = b" ".join(tokens[i:i + window])
                    rows.append((mini, seg, n, i, xxhash.xxh64_intdigest(part) - (1 << 63), part))
                if len(rows) > ROWS:
                    yield _batch(rows, target)
                    rows = []
            yield _batch(rows, target)

    pieces = segment_words(docs, crowded, window).dropDuplicates(["mini", "seg", "n"])
    windows = keep(pieces.mapInArrow(cut, schema))
    single = windows.groupBy("win").agg(F.first("words").alias("words"),
                                        (F.count("*") > 1).alias("again"))
    # a segment that occurs twice makes each of its windows occur twice
    double = crowded.where("twice").select("mini", "seg", "n").distinct()
    certain = windows.join(double, ["mini", "seg", "n"], "left_semi").select("win").distinct()
    marked = single.join(certain.withColumn("sure", F.lit(True)), "win", "left")
    hits = search_shards(marked.select(
        F.col("win").alias("mini"), F.col("win").alias("seg"), F.lit(1).alias("n"),
        (F.col("again") | F.coalesce("sure", F.lit(False))).alias("twice"), "words"),
        window, shard_words)
    return (windows.drop("words").join(hits.select(F.col("mini").alias("win")), "win", "left_semi")
            .groupBy("mini", "seg", "n").agg(F.flatten(F.collect_list(
                F.array("at", (F.col("at") + window).cast("int")))).alias("spans")))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD,
                   shard_words: int = SHARD_WORDS) -> DataFrame:
    """``id``, ``sum`` and ``hits`` (first word of a segment and ranges inside it) of every document
    that holds a repeated window."""
    every = keep(document_segments(docs, window, gram))
    often = keep(every.groupBy("mini").count().where("count > 1").select("mini"))
    found = keep(every.join(often, "mini", "left_semi"))  # of two stored tables: hot minimizers split
    drop(every)
    # a row per distinct segment, with one place where its words can be read
    distinct = keep(found.groupBy("mini", "seg", "n").agg(
        (F.count("*") > 1).alias("twice"), F.min(F.struct("id", "sum", "first")).alias("place"))
        .select("mini", "seg", "n", "twice", "place.*"))
    around = distinct.groupBy("mini").agg(F.count("*").alias("others"))
    crowds = around.where(F.col("others") > crowd).select("mini")
    full = not crowds.isEmpty()
    wanted = distinct.join(crowds, "mini", "left_anti") if full else distinct
    hits = search_shards(segment_words(docs, wanted, window), window, shard_words)
    if full:
        crowded = keep(distinct.join(crowds, "mini", "left_semi"))
        hits = hits.unionByName(search_crowds(docs, crowded, window, shard_words))
    return (found.join(keep(hits), ["mini", "seg", "n"]).groupBy("id", "sum")
            .agg(F.collect_list(F.struct("first", "spans")).alias("hits")))


def removed_words(n: int, hits: list[dict] | None) -> np.ndarray:
    """Which of ``n`` words the hits cover."""
    edge = np.zeros(n + 1, np.int64)
    for hit in hits or ():
        ranges = np.array(hit["spans"]) + hit["first"]
        np.add.at(edge, ranges[::2], 1)
        np.add.at(edge, ranges[1::2], -1)
    return np.cumsum(edge[:n]) > 0


def _with_hits(docs: DataFrame, **options) -> DataFrame:
    hits = repeated_spans(docs, **options)
    return packed(docs).join(hits, F.expr("_id <=> id AND _sum = sum"), "left").select(
        *(F.col(f"`{c}`") for c in docs.columns), F.col("hits").alias("_hits"))


def substring_dedup(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` (the kept words joined by a space)."""
    schema = T.StructType.fromDDL(
        "doc_id long, n_words long, n_removed long, kept_sha256 string")
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        plain = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for doc_id, text, hits in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = plain(text).split() if text else []
                gone = removed_words(len(tokens), hits)
                kept = [t for t, g in zip(tokens, gone.tolist()) if not g] if hits else tokens
                rows.append((doc_id, len(tokens), len(tokens) - len(kept),
                             sha256(b" ".join(kept)).hexdigest()))
            yield _batch(rows, target)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_hits(picked, **options).mapInArrow(run, schema)


def without_repeats(docs: DataFrame, length: str | None = None, **options) -> DataFrame:
    """The documents, all columns, with repeated words cut out of ``text``; a document that loses
    nothing keeps its text to the byte, one that loses everything goes. ``length`` names a column with
    the number of characters to bring up to date."""
    schema = docs.schema
    target = arrow_schema(schema)
    at = docs.columns.index("text")
    size = docs.columns.index(length) if length else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        plain = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            hits, texts = columns.pop(), columns[at]
            stay = []
            for i, found in enumerate(hits):
                text = plain(texts[i]) if texts[i] is not None else None
                if found:
                    tokens = text.split()
                    gone = removed_words(len(tokens), found).tolist()
                    text = b" ".join([t for t, g in zip(tokens, gone) if not g])
                if not found or text:
                    stay.append(i)
                texts[i] = None if text is None else text.decode()
                if found and size is not None:
                    columns[size][i] = len(texts[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array([c[i] for i in stay], f.type) for c, f in zip(columns, target)],
                schema=target)

    return _with_hits(docs, **options).mapInArrow(run, schema)
