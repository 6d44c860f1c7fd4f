"""Operator 9, quality rules: repetition counts and compression bands.

A text is compressed as a whole and in chunks of fixed size. Text of a given length has a usual range of
compression ratios: a higher one means repetition, a lower one means noise. The limits depend on
the length, because short texts give the compressor nothing to refer back to.

There are two sets of limits. Fixed ones hold for any corpus: no prose lies outside them. Narrower ones are
taken from the corpus itself: all its texts, copies once, are counted by class of length (a quarter of an
octave) and ratio, and a text that lies further from its class's median than ``WIDTH`` times the median
distance, and than ``LEAST_WIDTH`` of the median, is outside. The count is a table of bounded size, so it is
all that the driver sees. Classes of fewer than ``CLASS_TEXTS`` different texts have the fixed limits alone.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; a null
``doc_id`` stays null; rows are judged one by one, so repeated rows give repeated rows; extra
columns of the input are ignored by :func:`quality` and kept by :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import keep
from riskloom.llm.words import per_row, utf8, whole_number

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, ratio double, "
          "chunk_share double, n_bytes long, packed long, size_class int")
#: Limits from the corpus: median distances, share of the median, different texts of a class, bytes of the
#: shortest text that is judged by them.
WIDTH, LEAST_WIDTH, CLASS_TEXTS, LEAST_BYTES = 8.0, 0.08, 50, 200
#: Ratios are counted to 1/100, those from this one on together.
HIGHEST_COUNTED = 2000
SYMBOLS = b"#*$%&|<>"
#: White space and the continuation bytes of UTF-8: what is left counts the characters of words.
NOT_WORD_CHARS = b" \t\n\r\x0b\x0c" + bytes(range(0x80, 0xC0))
BEYOND_ASCII = bytes(range(0x80, 0x100))

#: (bytes, lowest ratio) at zstandard's level 3, just below the least of natural prose of that length: manual
#: pages and messages in 16 languages, licences. Between two lengths the limit follows the logarithm of the
#: length. Han and kana characters compress least; a text of hardly any bytes beyond ASCII is held to more.
ANY_SCRIPT = ((200, 0.9), (400, 1.01), (800, 1.14), (1600, 1.3), (3200, 1.57), (6400, 1.73),
              (12800, 1.9))
LATIN = ((200, 0.9), (400, 1.15), (800, 1.3), (1600, 1.5), (3200, 1.74), (6400, 1.94), (12800, 2.1))


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio (plain bytes / compressed bytes) by length in bytes: ``highest`` has
    (shorter than, highest), ``lowest`` and ``lowest_latin`` (length, lowest), the latter for texts with
    under ``latin`` of their bytes beyond ASCII. A chunk, the shorter last one too, is judged by the limits of its
    own length; a text fails when its own ratio or chunks with more than ``chunk_share`` of its bytes
    are outside."""

    highest: tuple[tuple[float, float], ...] = (
        (200, 2.8), (400, 3.0), (800, 3.2), (3200, 3.6), (12800, 4.0), (float("inf"), 5.0))
    lowest: tuple[tuple[float, float], ...] = ANY_SCRIPT
    lowest_latin: tuple[tuple[float, float], ...] = LATIN
    latin: float = 0.1
    chunk: int = 4096
    chunk_share: float = 0.25
    level: int = 3

    def inside(self, size: int, ratio: float, latin: bool = False) -> bool:
        low = np.interp(np.log(size), *self._points(latin))
        return low <= ratio <= next(high for below, high in self.highest if size < below)

    def _points(self, latin: bool) -> tuple[list[float], list[float]]:
        points = self.lowest_latin if latin else self.lowest
        return [float(np.log(n)) for n, _ in points], [low for _, low in points]

    def fits(self, text: bytes, ratio: float) -> bool:
        beyond = len(text) - len(text.translate(None, BEYOND_ASCII))
        return self.inside(len(text), ratio, beyond < self.latin * len(text))


def repeated_words(tokens: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds at least twice."""
    n = len(tokens)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in tokens], np.int64, n)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 20:  # three factors would not fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= again
    return int(covered.sum())


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    tokens = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (len(tokens), len(text.translate(None, NOT_WORD_CHARS)),
            len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(tokens))


def size_class(size: int) -> int:
    """Quarters of octaves; below ``LEAST_BYTES`` there is none."""
    return int(np.floor(4 * np.log2(size))) if size >= LEAST_BYTES else -1


def bands_of(text: bytes, bands: Bands, compress) -> tuple[bool, float, float, int]:
    """Whether the text is inside its bands, its ratio, the share of its bytes in chunks outside, and its
    compressed size."""
    if not text:
        return False, 0.0, 0.0, 0
    packed = len(compress(text))
    ratio = len(text) / packed
    outside = 0
    if len(text) > bands.chunk:  # a single chunk is the whole text
        for i in range(0, len(text), bands.chunk):
            part = text[i:i + bands.chunk]
            if not bands.fits(part, len(part) / len(compress(part))):
                outside += len(part)
    share = outside / len(text)
    return bands.fits(text, ratio) and share <= bands.chunk_share, ratio, share, packed


def judge(texts: list[bytes], bands: Bands) -> list[tuple]:
    import zstandard

    compress = zstandard.ZstdCompressor(level=bands.level).compress
    out = []
    for text in texts:
        found = counts(text)
        failed = found[0] < 50 or 100 * found[4] > 50 * found[0]
        fits, ratio, share, packed = bands_of(text, bands, compress)
        out.append((*found, failed, fits and not failed, ratio, share, len(text), packed,
                    size_class(len(text))))
    return out


def corpus_limits(sizes: DataFrame) -> dict[int, tuple[float, float]]:
    """Lowest and highest ratio of each class of length, from ``n_bytes``, ``packed`` and ``size_class`` of
    every text. Equal copies have equal sizes and count once."""
    percent = F.least(F.round(100 * F.col("n_bytes") / F.col("packed")), F.lit(HIGHEST_COUNTED))
    counted = (sizes.where("size_class >= 0").select("size_class", "n_bytes", "packed").distinct()
               .groupBy("size_class", percent.cast("int").alias("percent")).count().collect())
    classes: dict[int, list] = {}
    for r in counted:  # at most 2001 rows for each of some 200 classes
        classes.setdefault(r.size_class, []).append((r.percent / 100, r["count"]))
    out = {}
    for c, pairs in classes.items():
        if sum(n for _, n in pairs) >= CLASS_TEXTS:
            middle = weighted_median(pairs)
            usual = weighted_median([(abs(x - middle), n) for x, n in pairs])
            width = max(WIDTH * usual, LEAST_WIDTH * middle)
            out[c] = (middle - width, middle + width)
    return out


def weighted_median(pairs: list[tuple[float, int]]) -> float:
    """The smallest value with half of the weight at or below it."""
    ordered = sorted(pairs)
    reach = np.cumsum([n for _, n in ordered])
    return ordered[int(np.searchsorted(2 * reach, reach[-1]))][0]


def quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The verdict on every document with the counts it rests on."""
    def of(data):
        return [data["doc_id"], *(list(c) for c in zip(*judge(data["text"], bands)))] \
            if data["doc_id"] else [[]] * 13

    rows = keep(per_row(docs, SCHEMA, of, [whole_number("doc_id"), "text"]))
    limits = rows.sparkSession.createDataFrame(
        [(c, *pair) for c, pair in corpus_limits(rows).items()], "size_class int, low double, high double")
    inside = F.col("low").isNull() | F.col("ratio").between(F.col("low"), F.col("high"))
    # a row per class of length
    return rows.join(F.broadcast(limits), "size_class", "left").withColumn(
        "kept", F.col("kept") & inside).select(
        *[c.split()[0] for c in SCHEMA.split(", ")[:10]], "low", "high")


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, all columns unchanged. A first pass over the texts takes their sizes."""
    def sizes(data):
        import zstandard

        compress = zstandard.ZstdCompressor(level=bands.level).compress
        texts = data["text"]
        return [[len(t) for t in texts], [len(compress(t)) for t in texts],
                [size_class(len(t)) for t in texts]]

    limits = corpus_limits(per_row(docs, "n_bytes long, packed long, size_class int", sizes, ["text"]))
    free = (float("-inf"), float("inf"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for v in judge(utf8(batch.column("text")), bands):
                low, high = limits.get(v[-1], free)
                good.append(v[6] and low <= v[7] <= high)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.select(*(F.col(f"`{c}`") for c in docs.columns)).mapInArrow(run, docs.schema)
