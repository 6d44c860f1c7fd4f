"""Operator 13, phrase collocations from a weighted de Bruijn graph.

The nodes are the runs of three words, an edge is a run of four, from its first three words to its last
three, and weighs as much as it occurs. Only edges are counted, and where fewer words are left before a
piece ends, what is left: these are the corrections. Each place of a text yields one run, the
longest; the count of a shorter phrase is the flow through it, the sum of all runs that begin with it.

1. *Sieve.* Every run of one to four words falls into a bucket by its hash, blocks of documents send the
   counts of their buckets, packed. A phrase of ``least`` occurrences lies in a bucket of as many, so a
   bit per bucket (bounded by ``SIEVE_BITS``, 64 MB) is all that is broadcast. Buckets shared by several
   phrases only let more through.
2. *Graph.* Each place's run is cut where the sieve says that a longer one is too rare to matter: the rest
   of the flow goes on as a correction. Equal runs of a block are one row before they are shuffled.
3. *Paths.* A node is unary when all that enters it comes by one edge and all of that leaves by one other:
   the weights of the three are equal. Edges joined by unary nodes form a path, which has one weight; no
   path is a circle, because the first occurrence in a piece has nothing before it. Paths are put together
   by doubling pointers, in as many rounds as the logarithm of the longest.
4. *Scores.* Candidates of four words are the windows of paths. A phrase goes when a longer candidate
   around it is nearly as frequent, which a path says once for all its windows. Scores are whole numbers
   of decimals, so they are exact.

Defined cases: a null, empty or blank text has no words; a null ``lang`` is ``und``; repeated rows count as
often as they occur; equal scores are ordered by count, then phrase; an empty table gives no rows; extra
columns are ignored; ids are not needed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.frequencies import blocks
from riskloom.llm.tables import drop, keep, partition_number
from riskloom.llm.words import LOWER, UPPER

LONGEST, LEAST, INSIDE, TOP = 4, 30, 80, 2000
#: Bytes of text of a block, and of the part of it that is cut into words at once.
BLOCK_BYTES, SLICE = 5 << 20, 1 << 20
#: The sieve has between 2**20 and 2**29 buckets, one for every SPARE bytes of text where that lies between.
SPAN_BITS, SIEVE_BITS, SPARE = 20, 29, 8
#: Groups that a share of the word counts goes to.
SHARES = 256
BREAK = 0
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(10 if b in _ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def numbered(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words of all texts as numbers from 1, ``BREAK`` between two pieces, and the words."""
    number: dict[bytes, int] = {b".": BREAK}  # no word holds it
    found, held, size = [], [], 0

    def cut() -> np.ndarray:
        tokens = b"\n".join(held).translate(_TABLE).replace(b"\n", b" . ").split()
        return np.fromiter([number.setdefault(w, len(number)) for w in tokens], np.int64, len(tokens))

    for t in texts:
        held.append(t)
        size += len(t)
        if size >= SLICE:
            found += [cut(), np.zeros(1, np.int64)]
            held, size = [], 0
    found.append(cut())
    return np.concatenate(found), list(number)


def by_lang(langs: list[str], texts: list[bytes]) -> dict[str, list[bytes]]:
    out: dict[str, list[bytes]] = defaultdict(list)
    for lang, text in zip(langs, texts):
        out[lang].append(text)
    return out


def buckets(ids: np.ndarray, words: list[bytes], lang: str, longest: int, bits: int
            ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For one word up to ``longest``: the places of the runs inside a piece, and their buckets."""
    import xxhash

    seed = xxhash.xxh64_intdigest(lang.encode())
    digest = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)
    hashes = digest[ids]
    at = np.flatnonzero(ids)
    run = hashes[at]
    for size in range(1, longest + 1):
        if size > 1:
            inside = at + size - 1 < len(ids)
            inside[inside] = ids[at[inside] + size - 1] != BREAK
            at, run = at[inside], run[inside]
            run = (run * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[at + size - 1]
            run ^= run >> np.uint64(29)
            run *= np.uint64(0xBF58476D1CE4E5B9)
            run ^= run >> np.uint64(32)
        yield at, (run >> np.uint64(64 - bits)).astype(np.uint32)


def pack(values: np.ndarray) -> bytes:
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u4").view("u1").reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


def bucket_counts(texts: DataFrame, longest: int, least: int, bits: int) -> DataFrame:
    """A row per block and span of buckets: the buckets met, as differences, and how often, ``least`` at
    most; and a row per block and language with its number of words, under a share below zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, langs, found in blocks(batches, BLOCK_BYTES):
            met, rows = [], []
            for lang, own in by_lang(langs, found).items():
                ids, words = numbered(own)
                share = (number + (number >> 32)) % SHARES
                rows.append((-1 - share, lang, int(np.count_nonzero(ids)), None, None))
                met += [np.unique(b, return_counts=True)
                        for _, b in buckets(ids, words, lang, longest, bits)]
            slot, times = (np.concatenate([m[i] for m in met]) for i in (0, 1))
            slot, at = np.unique(slot, return_inverse=True)
            times = np.minimum(np.bincount(at, times, len(slot)), least)
            spans = np.arange((1 << bits >> SPAN_BITS) + 1, dtype=np.int64) << SPAN_BITS
            edges = np.searchsorted(slot, spans).tolist()
            for span, (a, b) in enumerate(zip(edges, edges[1:])):
                if a < b:
                    near = slot[a:b].astype(np.int64) - (span << SPAN_BITS)
                    rows.append((span, None, None, pack(np.diff(near, prepend=0)), pack(times[a:b])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()))],
                names=["span", "lang", "n", "near", "times"])

    return texts.mapInArrow(run, "span long, lang string, n long, near binary, times binary")


def spans_met(counted: DataFrame, least: int) -> DataFrame:
    """A row per span with a bit for every bucket that was met ``least`` times, and the word counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, table = None, np.zeros(1 << SPAN_BITS, np.int64)
        types = pa.int64(), pa.string(), pa.int64(), pa.binary()

        def row(span, lang, n, bits) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip((span, lang, n, bits), types)],
                names=["span", "lang", "n", "bits"])

        for batch in batches:
            for span, lang, n, near, times in zip(*(c.to_pylist() for c in batch.columns)):
                if span < 0:
                    yield row(span, lang, n, None)
                    continue
                if last is not None and span != last:
                    yield row(last, None, None, np.packbits(table >= least).tobytes())
                    table[:] = 0
                last = span
                table[np.cumsum(unpack(near), dtype=np.int64)] += unpack(times)
        if last is not None:
            yield row(last, None, None, np.packbits(table >= least).tobytes())

    return counted.repartition("span").sortWithinPartitions("span").mapInArrow(
        run, "span long, lang string, n long, bits binary")


def sieve_bits(texts: DataFrame) -> int:
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return min(max(SPAN_BITS, (size // SPARE).bit_length()), SIEVE_BITS)


def graph(texts: DataFrame, shared, longest: int, bits: int) -> DataFrame:
    """``lang``, ``phrase``, its ``size`` in words and ``c``: how often a place's run is that one, cut
    where the sieve (a broadcast bit per bucket) says that longer ones are too rare."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = np.frombuffer(shared.value, "u1")
        for _, langs, found in blocks(batches, BLOCK_BYTES):
            for lang, own in by_lang(langs, found).items():
                ids, words = numbered(own)
                reach = np.zeros(len(ids), np.int64)
                for size, (at, slot) in enumerate(buckets(ids, words, lang, longest, bits)):
                    often = sieve[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1
                    at = at[(often > 0) & (reach[at] == size)]
                    reach[at] = size + 1
                for batch in runs_of(ids, words, reach, longest, lang):
                    yield batch

    return (texts.mapInArrow(run, "lang string, phrase string, size int, c long")
            .groupBy("lang", "phrase", "size").agg(F.sum("c").alias("c")))


def runs_of(ids: np.ndarray, words: list[bytes], reach: np.ndarray, longest: int, lang: str
            ) -> Iterator[pa.RecordBatch]:
    """The distinct runs of ``reach`` words at each place, and their counts. A run is a number for its
    first words and the next word, so equal numbers are equal words."""
    begun = ids.copy()  # number of the run of ``size`` words that starts at a place
    spelled = words
    for size in range(1, longest + 1):
        at = np.flatnonzero(reach >= size)
        if size > 1:
            pair, number = np.unique(begun[at] << 32 | ids[at + size - 1], return_inverse=True)
            begun = np.zeros(len(ids), np.int64)
            begun[at] = number
            spelled = [spelled[p >> 32] + b" " + words[p & 0xFFFFFFFF] for p in pair.tolist()]
        ended = begun[np.flatnonzero(reach == size)]
        if len(ended):
            there = np.bincount(ended, minlength=len(spelled))
            which = np.flatnonzero(there)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(which)),
                 pa.array([spelled[i] for i in which.tolist()], pa.binary()).cast(pa.string()),
                 pa.array(np.full(len(which), size, np.int32)), pa.array(there[which])],
                names=["lang", "phrase", "size", "c"])


def flow(runs: DataFrame, least: int) -> DataFrame:
    """``f``, the occurrences of every phrase of at least ``least``: all runs that begin with it."""
    begins = F.transform(F.sequence(F.lit(1), F.col("size")), lambda k: F.struct(
        k.alias("size"), F.call_function("substring_index", F.col("phrase"), F.lit(" "), k)
        .alias("phrase")))
    return (runs.select("lang", "c", F.explode(begins).alias("b"))
            .groupBy("lang", "b.size", "b.phrase").agg(F.sum("c").alias("f"))
            .where(F.col("f") >= least))


def _words(phrase: str, first: int) -> F.Column:
    """The first words of a phrase, or its last ones where ``first`` is below zero."""
    return F.substring_index(phrase, " ", first)


def paths(phrases: DataFrame, longest: int) -> DataFrame:
    """``lang``, ``path`` and its weight ``f`` for every maximal path of edges through unary nodes."""
    edges = phrases.where(F.col("size") == longest).select("lang", "phrase", "f")
    nodes = phrases.where(F.col("size") == longest - 1).select(
        "lang", F.col("phrase").alias("node"), "f")
    leaving = edges.select("lang", _words("phrase", longest - 1).alias("node"), "f",
                           F.col("phrase").alias("edge"))
    entering = edges.select("lang", _words("phrase", 1 - longest).alias("node"), "f",
                            F.col("phrase").alias("up"))
    unary = ["lang", "node", "f"]  # the same weight three times
    steps = keep(entering.join(nodes, unary).join(leaving, unary).select(
        "lang", "edge", "up", F.lit(1).alias("far")))
    beyond = steps.select("lang", F.col("edge").alias("up"), F.col("up").alias("above"),
                          F.col("far").alias("more"))
    while not steps.join(beyond, ["lang", "up"], "left_semi").isEmpty():
        further = keep(steps.join(beyond, ["lang", "up"], "left").select(
            "lang", "edge", F.coalesce("above", "up").alias("up"),
            (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")))
        drop(steps)
        steps = further
        beyond = steps.select("lang", F.col("edge").alias("up"), F.col("up").alias("above"),
                              F.col("far").alias("more"))
    # a path lies inside one piece of one text, so what is gathered is no longer than that
    tails = steps.groupBy("lang", "up").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("far", _words("edge", -1).alias("word")))), lambda s: s["word"]), " ").alias("tail"))
    heads = edges.join(steps.select("lang", F.col("edge").alias("phrase")), ["lang", "phrase"],
                       "left_anti")
    return heads.join(tails.withColumnRenamed("up", "phrase"), ["lang", "phrase"], "left").select(
        "lang", F.concat_ws(" ", "phrase", "tail").alias("path"), "f")


def _windows(words: str, size: int) -> F.Column:
    """The distinct runs of ``size`` words of an array, without which there is none."""
    n = F.size(words)
    return F.when(n >= size, F.array_distinct(F.transform(
        F.sequence(F.lit(1), n - size + 1),
        lambda i: F.array_join(F.slice(words, i, size), " ")))).otherwise(
            F.array().cast("array<string>"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE,
                 top: int = TOP, lang: str = "lang") -> DataFrame:
    """``lang``, ``rank``, ``phrase``, its count ``a``, the counts ``l`` and ``r`` of the two parts of its
    weakest cut, ``n`` (words of the language) and ``score`` of each language's best phrases."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), "text",
                        partition_number())
    bits = sieve_bits(texts)
    met = keep(spans_met(bucket_counts(texts, longest, least, bits), least))
    sieve = bytearray(1 << bits >> 3)
    width = 1 << SPAN_BITS >> 3
    for r in met.where("span >= 0").select("span", "bits").toLocalIterator():  # 64 MB at most
        sieve[r.span * width:(r.span + 1) * width] = r.bits
    shared = docs.sparkSession.sparkContext.broadcast(bytes(sieve))
    phrases = keep(flow(graph(texts, shared, longest, bits), least))
    walks = keep(paths(phrases, longest)) if longest > 2 else None
    found = phrases.where((F.col("size") > 1) & (F.col("size") < longest)).select(
        "lang", "phrase", "size", F.col("f").alias("a"))
    around = None
    if walks is not None:
        split = walks.select("lang", "f", F.split("path", " ").alias("words"))
        whole = split.select("lang", F.explode(_windows("words", longest)).alias("phrase"),
                             F.lit(longest).alias("size"), F.col("f").alias("a"))
        covers = [split.select("lang", "f", F.explode(_windows("words", size)).alias("phrase"))
                  for size in range(2, longest)]
        for size in range(3, longest):
            longer = phrases.where(F.col("size") == size).select(
                "lang", "f", F.split("phrase", " ").alias("words"))
            covers += [longer.select("lang", "f", F.explode(_windows("words", k)).alias("phrase"))
                       for k in range(2, size)]
        for cover in covers:
            around = cover if around is None else around.unionByName(cover)
        around = around.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        exact = "cast({} as decimal(38, 0)) * {}".format
        found = found.join(around, ["lang", "phrase"], "left").where(
            F.col("longer").isNull() | F.expr(f"{exact('longer', 100)} < {exact('a', inside)}")
        ).drop("longer").unionByName(whole)
    else:
        found = phrases.where("size = 2").select("lang", "phrase", "size", F.col("f").alias("a"))
    cuts = found.select("lang", "phrase", "size", "a",
                        F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    part = F.call_function
    cuts = cuts.withColumns({
        "first": part("substring_index", F.col("phrase"), F.lit(" "), F.col("k")),
        "rest": part("substring_index", F.col("phrase"), F.lit(" "), F.col("k") - F.col("size"))})
    counts = phrases.select("lang", "phrase", "f")
    cuts = (cuts.join(counts.toDF("lang", "first", "l"), ["lang", "first"])
            .join(counts.toDF("lang", "rest", "r"), ["lang", "rest"]))
    score = F.expr("cast(2000000 * cast(a as decimal(20, 0)) as decimal(38, 0)) "
                   "div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    weakest = cuts.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = (weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    n = met.where("span < 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(n, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
         translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
cut AS (
  SELECT lang, [w for w in regexp_split_to_array(piece, '[\\x20\\x09]+') if w <> ''] AS ws FROM pieces),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS size),
f AS (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase FROM (
      SELECT lang, size, ws, unnest(range(1, len(ws) - size + 2)) AS i FROM cut, sizes
      WHERE len(ws) >= size)) GROUP BY lang, size, phrase),
words AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT * FROM f WHERE size > 1 AND f >= {LEAST}),
around AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, f, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (
      SELECT lang, f, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (
        SELECT lang, f, size, string_split(phrase, ' ') AS ws, unnest(range(2, size)) AS k
        FROM candidates WHERE size > 2))) GROUP BY lang, phrase),
left_over AS (
  SELECT c.* FROM candidates c LEFT JOIN around a USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < {INSIDE} * f),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(ws[1:k], ' ') AS head,
         array_to_string(ws[k + 1:], ' ') AS rest
  FROM (SELECT lang, phrase, f, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k
        FROM left_over)),
scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r,
         CAST((CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON c.lang = x.lang AND c.head = x.phrase
  JOIN f y ON c.lang = y.lang AND c.rest = y.phrase),
weakest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place
                 FROM scored) WHERE place = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN words USING (lang) WHERE rank <= {TOP}
"""
