"""Operator 3, quotation linking: conversations in reply order, without the quotes.

A line behind one or more ``>`` is quoted, as many levels deep. Quoted lines are normalised (markers
off, A-Z in lower case, white space as one space), hashed and joined to the latest earlier message of the
conversation that wrote that line itself. A message answers the message that most of its first-level
quoted lines come from, the later one on a tie; a message that quotes nothing known answers the one
before it. The first answer to a message continues its branch, every further one starts a branch of its
own, so a branch is a linear chat; quoted lines are cut from the text.

A branch is put together from unbroken stretches: only where it leaves its neighbours are links followed.

Messages are sorted once over range partitions; what a row needs from the rows before it is carried
along inside a partition, and one row per partition tells the next one where it stands. So a
conversation, or a line, that holds a third of all messages is spread like any others, no pairs of equal
lines are formed, and no conversation is gathered in one place.

Defined cases: a null text has no lines and null content; messages without conv_id are one conversation,
null turns come first; rows with equal conv_id and turn follow each other in the order of role and text
hash; equal rows are messages of their own; an empty table gives an empty result; extra columns are
ignored; a line of markers alone is quoted and links to nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.components import components
from riskloom.llm.tables import PART, keep, partition_number
from riskloom.llm.words import arrow_schema

MARKERS = re.compile(r"^(?:[ \t]*>)+").match
BLANK = " \t\n\r"
#: Rows of a partition get consecutive ids above its number shifted by so many bits.
SHIFT = 40


def normal_hash(line: str) -> int | None:
    """Signed hash of a normalised line, None where nothing is left."""
    import xxhash

    flat = b" ".join(line.encode().lower().split())
    if not flat:
        return None
    h = xxhash.xxh64_intdigest(flat)
    return h - (1 << 64) if h >> 63 else h


def parse(text: str | None) -> tuple[str | None, list[int], list[tuple[int, int | None]]]:
    """Text without quotes, hashes of its own lines, (level, hash) of the quoted ones."""
    if text is None:
        return None, [], []
    own, quoted = [], []
    for line in text.split("\n"):
        m = MARKERS(line)
        if m:
            quoted.append((m[0].count(">"), normal_hash(line[m.end():])))
        else:
            own.append(line)
    content = "\n".join(own).strip(BLANK) if quoted else text
    hashes = [h for h in map(normal_hash, own) if h is not None]
    return content, list(dict.fromkeys(hashes)), quoted


MESSAGE = ("id long, prev long, conv_id long, turn long, role string, content string, "
           "own array<bigint>, quoted array<struct<level: int, line: bigint>>")


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(target)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)


def _ranges(df: DataFrame, *keys: str) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def messages(chats: DataFrame) -> DataFrame:
    """Every message with an id in conversation order, the id before it in its conversation (null for
    the first; for the first of a partition too), its content and its line hashes."""
    schema = T.StructType.fromDDL(MESSAGE)
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last = -1, None
        for batch in batches:
            rows = []
            if number < 0 and len(batch):
                number = batch.column(PART)[0].as_py() << SHIFT
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns[:4])):
                prev = number - 1 if last is not None and last[0] == conv else None
                content, own, quoted = parse(text)
                rows.append((number, prev, conv, turn, role, content, own,
                             [{"level": a, "line": b} for a, b in quoted]))
                number, last = number + 1, (conv,)
            yield _batch(rows, target)

    picked = chats.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        "role", "text").withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    return _ranges(picked, "conv_id", "turn", "role", "tie").select(
        "*", partition_number()).mapInArrow(run, schema)


def _previous(found: DataFrame) -> DataFrame:
    """``found`` with ``prev`` completed over the edges of partitions: a row for each is collected."""
    edges = found.groupBy(F.shiftright("id", SHIFT)).agg(
        F.min(F.struct("id", "conv_id")).alias("first"), F.max(F.struct("id", "conv_id")).alias("last")
    ).collect()
    edges.sort(key=lambda r: r.first.id)
    steps = [(b.first.id, a.last.id) for a, b in zip(edges, edges[1:])
             if a.last.conv_id == b.first.conv_id]
    step = found.sparkSession.createDataFrame(steps, "id long, over long")
    return (found.join(F.broadcast(step), "id", "left")  # a row per partition at most
            .withColumn("prev", F.coalesce("prev", "over")).drop("over"))


SOURCE = "part int, id long, level int, conv_id long, line long, source long, n int"


def sources(found: DataFrame) -> DataFrame:
    """``id``, ``level`` and ``source`` of every quoted line that an earlier message wrote."""
    quoted = found.select("id", "conv_id", F.explode("quoted").alias("q")).select(
        "id", "conv_id", "q.level", "q.line").where("line IS NOT NULL")
    asked = quoted.select(F.col("conv_id").alias("c"), F.col("line").alias("l")).distinct()
    own = found.select("id", "conv_id", F.explode("own").alias("line")).join(
        asked, F.expr("conv_id <=> c AND line = l"), "left_semi").select(
        "id", "conv_id", F.lit(0).alias("level"), "line")
    both = quoted.unionByName(own).withColumn("writes", (F.col("level") == 0).cast("int"))
    schema = T.StructType.fromDDL(SOURCE)
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = last = source = None
        for batch in batches:
            rows = []
            if part is None and len(batch):
                part = batch.column(PART)[0].as_py()
            data = batch.select(["conv_id", "line", "id", "level"]).columns
            for conv, line, ident, level in zip(*(c.to_pylist() for c in data)):
                if last != (conv, line):
                    source, last = None, (conv, line)
                    first = first or last
                if level == 0:
                    source = ident
                else:
                    rows.append((part, ident, level, conv, line, source, None))
            yield _batch(rows, target)
        if last:  # where the partition ends; n tells whether it is all one key
            yield _batch([(part, None, None, *last, source, int(first == last))], target)

    linked = keep(_ranges(both, "conv_id", "line", "id", "writes")
                  .select("conv_id", "line", "id", "level", partition_number())
                  .mapInArrow(run, schema))
    ends = linked.where("id IS NULL").orderBy("part").collect()  # a row per partition
    carried, state = [], None
    for r in ends:
        if state is not None and state[2] is not None:
            carried.append((r.part, *state))
        key = (r.conv_id, r.line)
        if r.source is not None or not r.n or state is None or state[:2] != key:
            state = (*key, r.source)
    before = linked.sparkSession.createDataFrame(carried, "p int, c long, l long, s long")
    return (linked.where("id IS NOT NULL")
            .join(F.broadcast(before), F.expr("part = p AND conv_id <=> c AND line = l"), "left")
            .select("id", "level", F.coalesce("source", "s").alias("source"))
            .where("source IS NOT NULL"))


STEP = "part int, id long, parent long, jumps boolean, first long"


def stretches(parents: DataFrame) -> DataFrame:
    """``id``, ``parent``, ``jumps`` (continues the branch of a message that is not the one before it) and
    ``first``, the message that begins the unbroken stretch of its branch in conversation order. It is
    carried along the sorted rows, so a conversation of any length needs no rounds for what merely follows
    its neighbour."""
    heirs = parents.where("parent IS NOT NULL").groupBy("parent").agg(F.min("id").alias("heir"))
    heir = F.coalesce(F.col("heir") == F.col("id"), F.lit(False))
    follows = F.coalesce(F.col("parent") == F.col("prev"), F.lit(False))
    flagged = parents.join(heirs, "parent", "left").select(
        "id", "parent", (heir & follows).alias("goes_on"), (heir & ~follows).alias("jumps"))
    schema = T.StructType.fromDDL(STEP)
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = None
        for batch in batches:
            rows = []
            if part is None and len(batch):
                part = batch.column(PART)[0].as_py()
            for ident, parent, goes_on, jumps in zip(*(c.to_pylist() for c in batch.columns[:4])):
                first = first if goes_on else ident
                rows.append((part, ident, parent, jumps, first))
            yield _batch(rows, target)
        if part is not None:  # where the partition ends
            yield _batch([(part, None, None, None, first)], target)

    steps = keep(_ranges(flagged, "id").select(
        "id", "parent", "goes_on", "jumps", partition_number()).mapInArrow(run, schema))
    ends = steps.where("id IS NULL").orderBy("part").collect()  # a row per partition
    carried, first = [], None
    for r in ends:
        carried.append((r.part, first))
        first = r.first if r.first is not None else first
    before = steps.sparkSession.createDataFrame(carried, "part int, before long")
    return steps.where("id IS NOT NULL").join(F.broadcast(before), "part").select(
        "id", "parent", "jumps", F.coalesce("first", "before").alias("first"))


def reply_order(chats: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``content`` without quotes, ``n_quoted`` lines, ``n_linked``
    lines that an earlier message wrote, ``reply_to`` (turn of the message answered) and ``branch``
    (turn of the branch's first message). Sorted by conv_id, branch and turn these are linear chats."""
    found = keep(messages(chats))
    linked = keep(sources(found))
    votes = (linked.where("level = 1").groupBy("id", "source").count()
             .groupBy("id").agg(F.max(F.struct("count", "source"))["source"].alias("quoted_from")))
    parents = keep(_previous(found).join(votes, "id", "left").select(
        "id", "prev", F.coalesce("quoted_from", "prev").alias("parent")))
    steps = keep(stretches(parents))
    source = steps.select(F.col("id").alias("parent"), F.col("first").alias("from"))
    roots = components(steps.where("jumps").join(source, "parent").select("from", "first"))
    turns = found.select(F.col("id").alias("other"), F.col("turn").alias("other_turn"))

    def turn_of(df: DataFrame, column: str, name: str) -> DataFrame:
        return (df.join(turns, df[column] == turns["other"], "left")
                .withColumnRenamed("other_turn", name).drop("other"))

    placed = steps.join(roots, steps["first"] == roots["node"], "left").select(
        "id", "parent", F.coalesce("root", "first").alias("root"))
    placed = turn_of(turn_of(placed, "parent", "reply_to"), "root", "branch")
    hits = linked.groupBy("id").agg(F.count("*").alias("n_linked"))
    return (found.join(placed.select("id", "reply_to", "branch"), "id").join(hits, "id", "left")
            .select("conv_id", "turn", "role", "content",
                    F.size("quoted").cast("long").alias("n_quoted"),
                    F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
                    "reply_to", "branch"))


def rendered(ordered: DataFrame, opening: str = "<|{}|>\n", closing: str = "\n") -> DataFrame:
    """A row per message of :func:`reply_order` in chat order with its ``rendered`` text."""
    before, _, after = opening.partition("{}")
    return _ranges(ordered, "conv_id", "branch", "turn").withColumn("rendered", F.concat(
        F.lit(before), F.coalesce("role", F.lit("user")), F.lit(after),
        F.coalesce("content", F.lit("")), F.lit(closing)))


SQL = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, role NULLS FIRST,
         text NULLS FIRST) AS id, conv_id, turn, role, text FROM conversations),
numbered AS (
  SELECT id, conv_id, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT id, conv_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM m
        WHERE text IS NOT NULL)),
lines AS (
  SELECT id, conv_id, i, line, regexp_extract(line, '^([ \t]*>)+') AS mark FROM numbered),
leveled AS (
  SELECT id, conv_id, i, line, length(mark) - length(replace(mark, '>', '')) AS level,
         trim(regexp_replace(translate(substr(line, length(mark) + 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[\x20\x09-\x0D]+', ' ', 'g')) AS flat FROM lines),
quoted AS (
  SELECT q.id, q.i, q.level, max(o.id) AS source FROM leveled q JOIN leveled o
  ON q.conv_id IS NOT DISTINCT FROM o.conv_id AND q.flat = o.flat AND o.id < q.id
  WHERE q.level > 0 AND o.level = 0 AND q.flat <> '' GROUP BY q.id, q.i, q.level),
votes AS (SELECT id, source, count(*) AS n FROM quoted WHERE level = 1 GROUP BY id, source),
chosen AS (
  SELECT id, source FROM (SELECT id, source, row_number() OVER
         (PARTITION BY id ORDER BY n DESC, source DESC) AS place FROM votes) WHERE place = 1),
parents AS (
  SELECT m.id, coalesce(c.source, lag(m.id) OVER (PARTITION BY m.conv_id ORDER BY m.id)) AS parent
  FROM m LEFT JOIN chosen c ON m.id = c.id),
heirs AS (SELECT parent, min(id) AS heir FROM parents WHERE parent IS NOT NULL GROUP BY parent),
branches AS (
  SELECT id, id AS root FROM parents WHERE id NOT IN (SELECT heir FROM heirs)
  UNION ALL
  SELECT h.heir, b.root FROM branches b JOIN heirs h ON b.id = h.parent),
counted AS (
  SELECT id, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) AS n_quoted,
         string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0) AS own
  FROM leveled GROUP BY id)
SELECT m.conv_id, m.turn, m.role,
       CASE WHEN coalesce(n_quoted, 0) = 0 THEN m.text
            ELSE trim(coalesce(own, ''), chr(32) || chr(9) || chr(10) || chr(13)) END AS content,
       CAST(coalesce(n_quoted, 0) AS BIGINT) AS n_quoted,
       CAST((SELECT count(*) FROM quoted q WHERE q.id = m.id) AS BIGINT) AS n_linked,
       p2.turn AS reply_to, r.turn AS branch
FROM m LEFT JOIN counted c ON m.id = c.id JOIN parents p ON m.id = p.id
LEFT JOIN m p2 ON p.parent = p2.id JOIN branches b ON m.id = b.id JOIN m r ON b.root = r.id
"""
