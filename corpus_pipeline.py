"""A training corpus from raw documents: quality rules, SimHash near-dedup, substring dedup,
benchmark decontamination, packing. Every stage works on all that its predecessor kept; between two
stages the documents are a Parquet table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.packing import pack
from riskloom.llm.quality import keep_good
from riskloom.llm.queries import table
from riskloom.llm.simhash import one_per_group
from riskloom.llm.substrings import without_repeats
from riskloom.llm.tables import keep
from riskloom.llm.tokens import tokenizer_path
from riskloom.llm.winnowing import without_contaminated


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the compression bands go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (fingerprints of three-word shingles, linked at two or fewer
    differing bits) the document with the smallest id stays."""
    return one_per_group(docs, size=3, threshold=2)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside windows that occur elsewhere too are cut out; documents without any left go."""
    return without_repeats(docs, length="n_chars")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document that is left, with their places in the sequences."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules), ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages), ("benchmark decontamination", benchmark_passages),
    ("packing", packing),
]
ORACLE_SQL = None  # compression, fingerprints, indexes and tokenizers are not SQL's


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, keep(docs) if i else docs, sf_dir)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
