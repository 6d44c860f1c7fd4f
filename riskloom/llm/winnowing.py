"""Operator 7, benchmark decontamination by winnowing, in DataFrame functions alone.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window). Of every
window, in items and in documents, only the smallest ``gram``-word hash is kept: equal windows keep
equal hashes, so a shared window always shares a fingerprint, and neighbouring windows mostly keep the
same one, which leaves about a quarter of the hashes. Documents meet the benchmark's windows by
fingerprint; a hit is then extended to the whole window, word by word, inside the document.

The benchmark is broadcast only if its windows were measured and are at most ``broadcast_bytes``;
otherwise the fingerprints meet in a shuffled join that adaptive execution splits where it is skewed.
Texts return to their hits by document id and text hash in one shuffle.

Defined cases: a null, empty or wordless text has no words, hits nothing and is never contaminated; a
null ``doc_id`` stays null; items without an id mark words but are not listed; items that repeat are
listed once; repeated rows give repeated rows; an empty benchmark marks nothing; extra columns are
ignored by :func:`decontaminate` and kept by :func:`without_contaminated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import keep
from riskloom.llm.words import LOWER, UPPER

WINDOW, GRAM, BROADCAST_BYTES = 10, 4, 64 << 20
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def gram_hashes(tokens: str, gram: int) -> Column:
    """A hash of every run of ``gram`` words."""
    n = F.size(tokens)
    return F.when(n >= gram, F.transform(
        F.sequence(F.lit(1), n - gram + 1),
        lambda i: F.xxhash64(F.slice(tokens, i, gram)))).otherwise(F.array().cast("array<bigint>"))


def window_minima(hashes: str, length: int, gram: int) -> Column:
    """The smallest hash inside every window of ``length`` words."""
    n, span = F.size(hashes), length - gram + 1
    if span == 1:
        return F.col(hashes)
    return F.when(n >= span, F.transform(
        F.sequence(F.lit(1), n - span + 1),
        lambda i: F.array_min(F.slice(hashes, i, span)))).otherwise(
            F.array().cast("array<bigint>"))


def minima(df: DataFrame, length: int, gram: int, *carry: str) -> DataFrame:
    """``carry`` and ``minima`` of the windows of ``length`` words of the array ``words``."""
    size = min(gram, length)
    return (df.select(*carry, gram_hashes("words", size).alias("hashes"))
            .select(*carry, window_minima("hashes", length, size).alias("minima")))


def benchmark_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """``print``, ``length``, ``words`` joined by a space, and ``items`` of every distinct window."""
    items = keep(benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                                  words("text").alias("words")).where("size(words) > 0"))
    parts = None
    for length in range(1, window + 1):
        fits = F.size("words") == length if length < window else F.size("words") >= length
        part = minima(items.where(fits), length, gram, "item_id", "words").select(
            "item_id", "words", F.posexplode("minima").alias("at", "print")).select(
            "item_id", "print", F.lit(length).alias("length"),
            F.array_join(F.slice("words", F.col("at") + 1, length), " ").alias("words"))
        parts = part if parts is None else parts.unionByName(part)
    return keep(parts.groupBy("print", "length", "words").agg(
        F.sort_array(F.collect_set("item_id")).alias("items")))


def _starts(length: int, window: str = "words", known: str = "known", first: str = "firsts") -> Column:
    """The places (from 1) where a window of ``length`` words is one of the known ones."""
    n = F.size(window)
    return F.when(n >= length, F.filter(
        F.sequence(F.lit(1), n - length + 1),
        lambda i: F.array_contains(F.col(first), F.element_at(window, i))
        & F.array_contains(F.col(known), F.array_join(F.slice(window, i, length), " ")))
    ).otherwise(F.array().cast("array<int>"))


def _places(length: int) -> Column:
    return F.flatten(F.transform(f"_at{length}", lambda i: F.sequence(i, i + length - 1)))


def _met(length: int) -> Column:
    return F.transform(f"_at{length}", lambda i: F.array_join(F.slice("_words", i, length), " "))


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, gram: int, broadcast_bytes: int,
          all_words: bool = True) -> DataFrame:
    """``docs`` with ``_words``, ``_covered`` (places inside a shared window) and ``_items``; without
    ``all_words`` the words are those of documents with a common fingerprint alone."""
    known = benchmark_windows(benchmark, window, gram)
    lengths = [r.length for r in known.select("length").distinct().collect()]  # at most ``window``
    size = F.octet_length("words") + F.aggregate(
        "items", F.lit(0), lambda total, item: total + F.octet_length(item) + 24)
    small = known.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= broadcast_bytes
    named = docs.withColumns({
        "_id": F.col("doc_id").cast("long"), "_sum": F.xxhash64(F.coalesce("text", F.lit("")))})
    cut = named.select("_id", "_sum", words("text").alias("words"))
    carried = [f"`{c}`" for c in docs.columns]
    found = None
    for length in sorted(lengths):
        prints = minima(cut, length, gram, "_id", "_sum").select(
            "_id", "_sum", F.explode(F.array_distinct("minima")).alias("print"))
        there = known.where(F.col("length") == length).groupBy("print").agg(
            F.collect_list(F.struct("words", "items")).alias("windows"))
        part = prints.join(F.broadcast(there) if small else there, "print")
        found = part if found is None else found.unionByName(part)
    if found is None:
        none = F.array().cast("array<string>")
        return named.select(*carried, words("text").alias("_words"),
                            F.array().cast("array<int>").alias("_covered"), none.alias("_items"))
    hits = found.groupBy("_id", "_sum").agg(
        F.array_distinct(F.flatten(F.collect_set("windows"))).alias("hits"))
    met = named.alias("d").join(hits.alias("h"), F.expr("d._id <=> h._id AND d._sum = h._sum"),
                                "left")
    none = F.array().cast("array<string>")
    # one row out of a generator: a filter on what is covered stays above it, so words are cut once
    cut_once = words("text") if all_words else F.when(F.col("hits").isNotNull(), words("text"))
    step = met.select(
        *(f"d.{c}" for c in carried), F.explode(F.array(cut_once)).alias("words"),
        F.col("hits"), F.coalesce(F.col("hits.words"), none).alias("known"),
        F.coalesce(F.array_distinct(F.transform(
            "hits.words", lambda w: F.substring_index(w, " ", 1))), none).alias("firsts"))
    step = step.select(*carried, "hits", F.col("words").alias("_words"), *(
        F.when(F.col("hits").isNull(), F.array().cast("array<int>"))
        .otherwise(_starts(length)).alias(f"_at{length}") for length in lengths))
    covered = F.array_distinct(F.concat(*(_places(length) for length in lengths)))
    met_words = F.array_distinct(F.concat(*(_met(length) for length in lengths)))
    step = step.select(*carried, "hits", "_words", covered.alias("_covered"), met_words.alias("_met"))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform(
        F.filter("hits", lambda h: F.array_contains("_met", h["words"])), lambda h: h["items"]))))
    return step.select(*carried, "_words", "_covered", F.coalesce(items, none).alias("_items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit`` (words inside a shared window), ``n_items``, ``items_sha256``
    (of the items' ids, sorted and joined by commas) and ``contaminated``."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = F.size("_covered").cast("long")
    return _hits(picked, benchmark, window, gram, broadcast_bytes).select(
        "doc_id", F.size("_words").cast("long").alias("n_words"), n.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (n > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                         gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that share no window with the benchmark, all columns."""
    return _hits(docs, benchmark, window, gram, broadcast_bytes, all_words=False).where(
        F.size("_covered") == 0).select(*(f"`{c}`" for c in docs.columns))


SQL = f"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id,
         [w for w in regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
          '{NOT_WORD}') if w <> ''] AS ws FROM documents),
items AS (
  SELECT item_id, [w for w in regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}',
          '{LOWER}'), '{NOT_WORD}') if w <> ''] AS ws FROM benchmark),
known AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1],
         ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM items
        WHERE len(ws) > 0)),
lengths AS (SELECT DISTINCT k FROM known),
starts AS (
  SELECT rid, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM words, lengths
        WHERE len(ws) >= k)),
hits AS (SELECT rid, i, s.k, item_id FROM starts s JOIN known b ON s.win = b.win AND s.k = b.k),
covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits)
  GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL)
  GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(m.n, 0) AS BIGINT) AS n_items, sha256(coalesce(m.list, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c ON w.rid = c.rid LEFT JOIN named m ON w.rid = m.rid
"""
