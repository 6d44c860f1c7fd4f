"""Numbers of partitions stay unique and in order where a later step merges partitions."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.llm.packing import pack
from riskloom.llm.quotes import messages, reply_order
from riskloom.llm.tables import keep
from riskloom.llm.tokenfiles import read_tokens, write_tokens
from riskloom.llm.tokens import tokenizer_path
from riskloom.session import scratch


@pytest.fixture
def many(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    yield 64
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_message_ids(spark, many):
    chats = spark.range(2000).select((F.col("id") % 50).alias("conv_id"), F.col("id").alias("turn"),
                                     F.lit("user").alias("role"), F.lit("hello").alias("text"))
    found = keep(messages(chats).coalesce(3))
    assert found.select("id").distinct().count() == 2000
    rows = found.orderBy("id").collect()
    assert [(r.conv_id, r.turn) for r in rows] == sorted((r.conv_id, r.turn) for r in rows)


def test_quotes_over_many_partitions(spark, many):
    chats = spark.createDataFrame(
        [(1, 0, "user", "first"), (1, 1, "assistant", "second"), (1, 2, "user", "> first\nagain"),
         (1, 3, "assistant", "fourth"), (1, 4, "user", "> second\nlate")],
        "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.reply_to, r.branch) for r in reply_order(chats).collect()}
    assert got == {0: (None, 0), 1: (0, 0), 2: (0, 2), 3: (2, 2), 4: (1, 0)}


def test_sequences_of_merged_partitions(documents, many):
    docs = documents.limit(80).repartition(many)
    rows = pack(docs, tokenizer_path("byte_bpe_50k.json")).coalesce(2).collect()
    filled = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048


def test_token_files(spark, documents, many):
    docs, path = documents.limit(120), scratch(spark)
    write_tokens(docs, path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    rows = sorted(read_tokens(spark, path).collect(), key=lambda r: r.doc_id)
    total = 0
    for r in rows:
        assert r.start == total
        total += r.n_tokens
    assert len(rows) == 120
