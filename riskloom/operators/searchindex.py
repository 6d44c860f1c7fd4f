"""P14 by index: trigrams of stored findings, intersected before rows are read.

The index has a row for every trigram and file of the findings table that holds it, sorted by trigram, so a
lookup reads the row groups of its trigrams alone. A word of a query can only occur in files that hold all
of its trigrams; the files that do for every word are read, and the words are looked for in their rows. Findings
are laid out by rule and file, so that a rare word lies in few files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.findings import search, search_text

GRAM = 3


def trigrams(rows: DataFrame) -> DataFrame:
    """The runs of three characters of ``part, text`` rows as ``part, gram``, distinct within a batch of rows, so
    that what leaves a batch does not grow with the number of its characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, set[str]] = {}
            for part, text in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(part, set()).update(
                    map("".join, zip(*(text[i:] for i in range(GRAM)))))
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([p for p, grams in held.items() for _ in grams], pa.string()),
                "gram": pa.array([g for grams in held.values() for g in grams], pa.string())})

    return rows.mapInArrow(run, "part string, gram string")


def write_searchable(findings: DataFrame, path: str, files: int) -> None:
    """The findings in ``files`` files (or more) by ranges of rule and place, and their index beside them."""
    (findings.repartitionByRange(files, "id", "file", "line").sortWithinPartitions("id", "file", "line")
     .write.mode("overwrite").parquet(f"{path}/findings"))
    index_findings(findings.sparkSession, path)


def index_findings(spark: SparkSession, path: str) -> None:
    """Write the index of the findings below ``path`` anew."""
    rows = spark.read.parquet(f"{path}/findings").select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("part"),
        search_text().alias("text"))
    held = trigrams(rows).distinct()
    (held.repartitionByRange("gram", "part").sortWithinPartitions("gram", "part")
     .write.mode("overwrite").parquet(f"{path}/trigrams"))


def files_of(spark: SparkSession, path: str, query: str) -> list[str] | None:
    """Names of the files that may hold a hit; None where the query has no trigram and all may."""
    grams = sorted({w[i:i + GRAM] for w in _words(query) for i in range(len(w) - GRAM + 1)})
    if not grams:
        return None
    found = (spark.read.parquet(f"{path}/trigrams").where(F.col("gram").isin(grams))
             .groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)))
    return sorted(r.part for r in found.collect())  # names of files


def _words(query: str) -> list[str]:
    return query.lower().split()


def indexed_search(spark: SparkSession, path: str, query: str) -> DataFrame:
    """P14 over a table of :func:`write_searchable`: the same rows as the scan, from the files that the
    index leaves."""
    every = spark.read.parquet(f"{path}/findings")
    parts = files_of(spark, path, query)
    if parts is None:
        return search(every, query)
    if not parts:
        return every.limit(0)
    return search(spark.read.schema(every.schema).parquet(
        *[f"{path}/findings/{p}" for p in parts]), query)
