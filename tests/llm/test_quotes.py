"""Operator 3 on planted threads, against its SQL twin."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from riskloom.llm.quotes import SQL, parse, rendered, reply_order


def twin(frame):
    con = duckdb.connect()
    con.register("given", frame)
    con.sql("CREATE TABLE conversations AS SELECT * FROM given")
    return Counter(con.execute(SQL).fetchall())


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_parse():
    content, own, quoted = parse("> one\n>> Two\n > > two\nmine\n\n>\n")
    assert content == "mine"
    assert [q[0] for q in quoted] == [1, 2, 2, 1]
    assert quoted[1][1] == quoted[2][1] == parse("TWO ")[1][0] and quoted[3][1] is None
    assert parse(None) == (None, [], []) and parse("a  b")[0] == "a  b"


def test_driver_conversations(spark, sf):
    chats = spark.read.parquet(f"{sf}/conversations.parquet")
    want = twin(chats.toPandas())
    got = reply_order(chats)
    assert rows_of(got) == want
    assert len(want) and all(r[7] == 0 for r in want)  # nothing is quoted there
    shown = [r.rendered for r in rendered(got).orderBy("conv_id", "branch", "turn").collect()]
    assert shown[0].startswith("<|")


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_threads(spark, parts):
    rng = random.Random(parts)
    lines = ["Shall we meet?", "yes", "No, thanks", "the plan   is  this", "ok"]
    rows = []
    for conv in range(12):
        said = []
        for turn in range(rng.randint(1, 9) if conv else 60):  # one conversation holds most rows
            text = []
            for level in (1, 1, 2):
                if said and rng.random() < 0.5:
                    text.append("> " * level + rng.choice(said).upper())
            text += [rng.choice(lines) + rng.choice(["", f" {turn}"]) for _ in range(rng.randint(0, 2))]
            said += text
            rows.append((conv, turn, rng.choice(["user", "assistant"]), "\n".join(text)))
    rows += [(None, 0, "user", "hello"), (None, 1, "user", "> hello\nyou"), (50, None, None, None),
             (50, 2, "user", ""), (51, 0, "user", ">")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = twin(chats.toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        clash = chats.withColumns({"branch": F.lit("x"), "content": F.lit(1)}).repartition(3)
        assert rows_of(reply_order(clash)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_branches(spark):
    rows = [(1, 0, "user", "first"), (1, 1, "assistant", "second"), (1, 2, "user", "> first\nagain"),
            (1, 3, "assistant", "fourth"), (1, 4, "user", "> second\nlate")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.content, r.reply_to, r.branch) for r in reply_order(chats).collect()}
    assert got == {0: ("first", None, 0), 1: ("second", 0, 0), 2: ("again", 0, 2),
                   3: ("fourth", 2, 2), 4: ("late", 1, 0)}


def test_nothing_and_equal_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert reply_order(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(1, 1, "user", "a")] * 3, schema)
    assert reply_order(same).count() == 3
