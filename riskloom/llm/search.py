"""Operator 11, ranked lexical search by scanning documents with one automaton of all item terms.

There is no index of the documents. The distinct terms of all items form an Aho-Corasick automaton in
which every term stands between two guards; what separates terms in a text becomes a guard too, so an
occurrence of a guarded term is a whole term, and one pass over a text counts the occurrences of all of
them. An output of the automaton is a term's number, which maps to the items that hold it.

1. Documents are scanned once: length in terms, and number and frequency of each item term in it.
2. Document frequencies, the number of documents and the number of terms are summed up.
3. The scores of a batch of documents against all items are added up term by term; a task hands on the
   best of its documents for each item, and these are ranked, first in shares of an item, then in all.

The items are measured first. Beyond ``items_bytes`` they are dealt to slices that each fit, and the
documents are scanned once per slice; each slice is broadcast.

Defined cases: a null, empty or termless text holds no term and is found by no item; a null ``doc_id`` comes
last among equal scores; item rows that are equal in id and text are one item; items without terms find
nothing; repeated documents are found as often as they occur; empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.tables import keep
from riskloom.llm.words import LOWER, UPPER, utf8, whole_number

TOP, ITEMS_BYTES = 10, 32 << 20
#: Scores that a task holds at once.
CELLS = 1 << 22
#: Shares of an item's candidates that are ranked on their own first.
SHARES = 64
GUARD = " "
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32
               for b in range(256))
_POST = np.dtype([("term", "<u4"), ("times", "<u4")])
_AUTOMATA: dict[str, object] = {}


def spaced(text: bytes) -> bytes:
    """The terms of a text as they are, A-Z in lower case, and a guard for every other character."""
    return text.translate(_TABLE)


def terms(text: bytes) -> list[bytes]:
    return spaced(text).split()


class Items:
    """The items of one slice as numbers: their distinct terms, and for each term the items that hold it
    and how often."""

    def __init__(self, texts: list[bytes]):
        number: dict[bytes, int] = {}
        held: dict[int, list[tuple[int, int]]] = {}
        for item, text in enumerate(texts):
            for term, times in Counter(terms(text)).items():
                held.setdefault(number.setdefault(term, len(number)), []).append((item, times))
        self.key, self.n_items, self.terms = uuid4().hex, len(texts), list(number)
        self.items = [np.array([i for i, _ in held[t]], np.int64) for t in range(len(number))]
        self.times = [np.array([c for _, c in held[t]], np.int64) for t in range(len(number))]

    def automaton(self):
        """Built once per worker."""
        import ahocorasick

        if self.key not in _AUTOMATA:
            _AUTOMATA.clear()
            built = ahocorasick.Automaton()
            for i, term in enumerate(self.terms):
                built.add_word(GUARD + term.decode("latin-1") + GUARD, i)  # a character per byte
            built.make_automaton()
            _AUTOMATA[self.key] = built
        return _AUTOMATA[self.key]


def scan(docs: DataFrame, shared) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats) and ``post`` (item terms with their frequencies) of every
    document with a term; ``shared`` is a broadcast :class:`Items`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        found = items.automaton().iter if items.terms else lambda text: ()
        number = itemgetter(1)
        for batch in batches:
            ids, sizes, posts = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                text = spaced(text)
                n = len(text.split())
                if n:
                    times = Counter(map(number, found(f"{GUARD}{text.decode('latin-1')}{GUARD}")))
                    ids.append(doc_id)
                    sizes.append(n)
                    posts.append(np.fromiter(times.items(), _POST, len(times)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(posts, pa.binary())],
                names=["doc_id", "n", "post"])

    return docs.select(whole_number("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, post binary")


def document_frequencies(found: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term; a row per term reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            entries = np.frombuffer(b"".join(batch.column(0).to_pylist()), _POST)
            df += np.bincount(entries["term"], minlength=n_terms)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(df[there])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in found.select("post").mapInArrow(run, "term long, df long").groupBy("term").agg(
            F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()],
                    np.int64)


class Best:
    """The highest scores of each item so far, equal scores by id, ids that are null last."""

    def __init__(self, n_items: int, top: int):
        self.top, self.least = top, np.zeros(n_items, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(3)] + [np.zeros(0, bool)]

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """``scores`` has a row per document and a column per item."""
        doc, item = np.nonzero((scores > 0) & (scores >= self.least))
        if not len(doc):
            return
        new = item, scores[doc, item], ids[doc], none[doc]
        rows = [np.concatenate(pair) for pair in zip(self.rows, new)]
        order = np.lexsort((rows[2], rows[3], -rows[1], rows[0]))
        rows = [r[order] for r in rows]
        first = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1]))
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        self.rows = [r[place < self.top] for r in rows]
        full = rows[0][place == self.top - 1], rows[1][place == self.top - 1]
        self.least[full[0]] = full[1]


def candidates(found: DataFrame, shared, weight: np.ndarray, n_docs: int, n_terms: int, top: int
               ) -> DataFrame:
    """``item``, ``doc_id`` and ``score`` of each task's best documents."""
    def batch_scores(items: Items, sizes: list[int], posts: list[bytes]) -> np.ndarray:
        entries = np.frombuffer(b"".join(posts), _POST)
        row = np.repeat(np.arange(len(posts)), [len(p) // _POST.itemsize for p in posts])
        m = np.array([25 + 75 * n * n_docs // n_terms for n in sizes], np.int64)
        term, times = entries["term"].astype(np.int64), entries["times"].astype(np.int64)
        value = weight[term] * (1_000_000_000 * times // (1000 * times + 8 * m[row]))
        order = np.argsort(term, kind="stable")
        term, row, value = term[order], row[order], value[order]
        out = np.zeros((len(posts), items.n_items), np.int64)
        edges = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else []
        for a, b in zip(edges, np.append(edges[1:], len(term)) if len(term) else []):
            t = term[a]
            if weight[t]:  # a document has a term once, so no cell is named twice
                out[np.ix_(row[a:b], items.items[t])] += value[a:b, None] * items.times[t]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best = Best(items.n_items, top)
        step = max(1, CELLS // max(1, items.n_items))
        for batch in batches:
            for a in range(0, len(batch), step):
                part = batch.slice(a, step)
                ids = part.column(0)
                best.add(batch_scores(items, part.column(1).to_pylist(), part.column(2).to_pylist()),
                         ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        item, score, ids, none = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(ids, mask=none), pa.array(score)],
            names=["item", "doc_id", "score"])

    return found.mapInArrow(run, "item long, doc_id long, score long")


def _ranked(df: DataFrame, top: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_slice(docs: DataFrame, rows: list, fields, top: int) -> DataFrame:
    spark = docs.sparkSession
    texts = [(r["text"] or "").encode() for r in rows]
    items = Items(texts)
    shared = spark.sparkContext.broadcast(items)
    found = keep(scan(docs, shared))
    n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = weights(document_frequencies(found, len(items.terms)), n_docs)
    best = candidates(found, shared, weight, n_docs, max(1, n_terms), top)
    shares = best.withColumn("share", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(SHARES)))
    ranked = _ranked(_ranked(shares, top, "item", "share").drop("rank"), top, "item")
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], fields)
    # a row per item of the slice, which was measured
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, items_bytes: int = ITEMS_BYTES
                  ) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the ``top`` documents of every item."""
    asked = items.select("item_id", "text").distinct()
    size = F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(64))
    total = asked.agg(F.coalesce(size, F.lit(0))).first()[0]
    n = max(1, -(-total // items_bytes))
    slot = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    fields = T.StructType([T.StructField("item", T.LongType()), asked.schema["item_id"]])
    parts = [_search_slice(docs, asked.where(slot == i).collect(), fields, top) for i in range(n)]
    return reduce(DataFrame.unionByName, parts)


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         [w for w in regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
          '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') if w <> ''] AS ws FROM documents),
b AS (
  SELECT row_number() OVER () AS item, item_id,
         [w for w in regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
          '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') if w <> ''] AS ws
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
total AS (SELECT count(*) AS nn, CAST(sum(len(ws)) AS BIGINT) AS ll FROM d WHERE len(ws) > 0),
asked AS (
  SELECT item, item_id, term, count(*) AS times
  FROM (SELECT item, item_id, unnest(ws) AS term FROM b) GROUP BY ALL),
tf AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY rid, term),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, total GROUP BY term, nn),
part AS (
  SELECT rid, term, w * ((1000000000 * tf)
         // (1000 * tf + 8 * (25 + (75 * CAST(len(ws) AS BIGINT) * nn) // ll))) AS v
  FROM tf JOIN w USING (term) JOIN d USING (rid), total),
scored AS (
  SELECT item, item_id, rid, CAST(sum(times * v) AS BIGINT) AS score
  FROM asked JOIN part USING (term) GROUP BY ALL),
ranked AS (
  SELECT item_id, doc_id, score, CAST(row_number() OVER
         (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scored JOIN d USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
