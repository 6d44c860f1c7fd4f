"""Operator 10, token counts without token ids.

A pre-token is what the tokenizer never merges across (see :mod:`riskloom.llm.tokens`). Each distinct
one is counted once by the library, the counts are joined to the per-document frequencies and summed.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a null ``doc_id`` stays null; repeated
rows each give a row; extra columns are ignored. Special strings inside a text are one token each, as
the library has it by default.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.frequencies import postings, sums, vocabulary
from riskloom.llm.tokens import PIECES, SIMPLE, coder


def chunk_numbers(texts: list[bytes]) -> tuple[dict[str, int], list[np.ndarray]]:
    """The distinct chunks between spaces, and their numbers text by text."""
    number: dict[str, int] = {}
    found = []
    for t in texts:
        chunks = t.decode().split(" ")
        found.append(np.fromiter([number.setdefault(c, len(number)) for c in chunks], np.int64,
                                 len(chunks)))
    return number, found


def pretokens(chunk: str) -> list[str]:
    """The pre-tokens of a chunk, for tokenizers of kind ``plain``: white space never belongs to a
    token and case does not matter inside simple words."""
    if SIMPLE(chunk):
        return [p.lower() for p in PIECES(chunk) if p != "\n"]
    return [chunk] if chunk else []


def distinct_pretokens(texts: list[bytes]) -> list[bytes]:
    chunks = {c for t in texts for c in t.decode().split(" ")}
    return [p.encode() for p in {p for c in chunks for p in pretokens(c)}]


def cut_pretokens(texts: list[bytes]):
    """Distinct pre-tokens of a block and where they occur."""
    chunks, found = chunk_numbers(texts)
    number: dict[str, int] = {}
    parts: list[int] = []
    ends = []
    for c in chunks:
        parts += [number.setdefault(p, len(number)) for p in pretokens(c)]
        ends.append(len(parts))
    if not found:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    chunk = np.concatenate(found)
    place = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    last = np.array(ends, np.int64)
    width = np.diff(last, prepend=0)
    n = width[chunk]  # occurrence i of a chunk becomes its n[i] pre-tokens
    first = np.repeat((last - width)[chunk], n)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return ([p.encode() for p in number], np.array(parts, np.int64)[first + step],
            np.repeat(place, n))


def distinct_whole(texts: list[bytes]) -> list[bytes]:
    return list({t for t in texts if t})


def cut_whole(texts: list[bytes]):
    """The whole text as one pre-token, for tokenizers without a known boundary."""
    number: dict[bytes, int] = {}
    kept = [i for i, t in enumerate(texts) if t]
    term = [number.setdefault(texts[i], len(number)) for i in kept]
    return list(number), np.array(term, np.int64), np.array(kept, np.int64)


def pretoken_counts(terms: DataFrame, tokenizer: str) -> DataFrame:
    """``term`` and ``n_tokens``, one library call per distinct pre-token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = coder(tokenizer).chunk
        for batch in batches:
            n = [len(chunk(t.decode())) // 4 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.float64())], names=["term", "n_tokens"])

    return terms.mapInArrow(run, "term binary, n_tokens double")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every document, and whether it has over ``limit`` tokens."""
    cut, distinct = ((cut_pretokens, distinct_pretokens) if coder(tokenizer).kind == "plain"
                     else (cut_whole, distinct_whole))
    counted = pretoken_counts(vocabulary(docs, distinct), tokenizer)
    joined = postings(docs, cut).join(counted, "term", "left")
    return sums(joined, ["n_tokens"]).select(
        "doc_id", "n_bytes", F.col("n_tokens").cast("long").alias("n_tokens"),
        (F.col("n_tokens") > limit).alias("over_limit"))
