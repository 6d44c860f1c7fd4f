"""The registered queries of this subpackage over the driver tables, and their SQL twins."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import exact, phrases, quotes, search, winnowing
from riskloom.llm.packing import pack
from riskloom.llm.pages import main_text
from riskloom.llm.quality import quality
from riskloom.llm.running import running_scores
from riskloom.llm.simhash import near_duplicates
from riskloom.llm.substrings import substring_dedup
from riskloom.llm.token_counts import token_counts
from riskloom.llm.tokenfiles import read_tokens, write_tokens
from riskloom.llm.tokens import tokenizer_path
from riskloom.session import apply_settings, scratch

#: Where the workers of a local session find this package; a cluster gets it with ``--py-files``.
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH")]))
    return apply_settings(spark).read.parquet(f"{sf}/{name}.parquet")


def op1_simhash_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


def op2_fm_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup(table(spark, sf, "documents"))


def op3_quotation_links(spark: SparkSession, sf: str) -> DataFrame:
    return quotes.reply_order(table(spark, sf, "conversations"))


def op4_harmonic_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_site_templates(spark: SparkSession, sf: str) -> DataFrame:
    return main_text(table(spark, sf, "pages"))


def op6_elias_fano(spark: SparkSession, sf: str) -> DataFrame:
    docs, path = table(spark, sf, "documents"), scratch(spark)
    write_tokens(docs, path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, path)


def op7_winnowing(spark: SparkSession, sf: str) -> DataFrame:
    return winnowing.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op8_context_trees(spark: SparkSession, sf: str) -> DataFrame:
    return running_scores(table(spark, sf, "documents"), group="lang")


def op9_compression_bands(spark: SparkSession, sf: str) -> DataFrame:
    return quality(table(spark, sf, "documents"))


def op10_pretoken_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_term_scan(spark: SparkSession, sf: str) -> DataFrame:
    return search.ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_content_sort(spark: SparkSession, sf: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf, "documents"))


def op13_phrase_graph(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


QUERIES = {
    "op1_simhash_anchors": op1_simhash_anchors,
    "op2_fm_substrings": op2_fm_substrings,
    "op3_quotation_links": op3_quotation_links,
    "op4_harmonic_packing": op4_harmonic_packing,
    "op5_site_templates": op5_site_templates,
    "op6_elias_fano": op6_elias_fano,
    "op7_winnowing": op7_winnowing,
    "op8_context_trees": op8_context_trees,
    "op9_compression_bands": op9_compression_bands,
    "op10_pretoken_counts": op10_pretoken_counts,
    "op11_term_scan": op11_term_scan,
    "op12_content_sort": op12_content_sort,
    "op13_phrase_graph": op13_phrase_graph,
}
SQL = {"op3_quotation_links": quotes.SQL, "op7_winnowing": winnowing.SQL,
       "op11_term_scan": search.SQL, "op12_content_sort": exact.SQL,
       "op13_phrase_graph": phrases.SQL}
