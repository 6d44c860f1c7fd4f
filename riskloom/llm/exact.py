"""Operator 12, exact dedup by sorting contents.

Contents (A-Z in lower case) are range-partitioned by splitters that Spark samples, sorted in their
partition, by external sorting where it is large, and compared in full with their neighbour; a run of
equal neighbours is a group. A splitter is the first ``HEAD`` bytes of a content, then its digest, then
the id: it has a bounded size however long texts are, and a common beginning or a group of copies of any
size is cut into several partitions like everything else.

Inside a partition a run is complete when it ends. Only the first and the last run of a partition can go
on next door; their contents are stored and compared over each edge in a join, and the runs that belong
together are added up from one row per edge. That table has two rows per partition at most, so it is
broadcast back; no text and no group moves again.

Defined cases: a null text is an empty one; of equal rows in a group one stays; ids that are null come
last, so ``keep_id`` is null only where a whole group lacks ids; an empty table gives no rows; extra
columns are ignored by :func:`exact_groups` and kept by :func:`without_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.tables import PART, keep, partition_number
from riskloom.llm.words import LOWER, UPPER, arrow_schema, whole_number

#: Bytes of a content in a splitter.
HEAD = 48
FIRST, LAST = 1, 2
RUN = ("doc_id long, text_sha256 string, keep_id long, group_size long, first boolean, part int, "
       "edge int, content string")


def normal(text: str = "text") -> Column:
    """The content that is compared: only A-Z change."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def sorted_contents(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``doc_id``, ``content`` and its digest in order of content, the largest id of equals first."""
    order = ["head", "text_sha256", F.desc_nulls_last("doc_id")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (docs.select(whole_number(key).alias("doc_id"), normal(text).alias("content"))
            .withColumns({"head": F.substring(F.col("content").cast("binary"), 1, HEAD),
                          "text_sha256": F.sha2("content", 256)})
            .repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .select("doc_id", "text_sha256", "content", partition_number()))


def runs(ordered: DataFrame) -> DataFrame:
    """A row per document with what its run of equal neighbours says. ``edge`` tells runs that begin or
    end their partition; the first row of such a run carries its content."""
    schema = T.StructType.fromDDL(RUN)
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = content = digest = None
        ids: list[int | None] = []
        edge = FIRST

        def end(out: list[list], edge: int) -> None:
            n = len(ids)
            shown = [content if edge else None, *[None] * (n - 1)]
            for column, more in zip(out, (ids, [digest] * n, [ids[0]] * n, [n] * n,
                                          [True, *[False] * (n - 1)], [part] * n, [edge] * n, shown)):
                column += more

        def rows(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(out, target)], schema=target)

        for batch in batches:
            part = batch.column(PART)[0].as_py() if part is None and len(batch) else part
            out: list[list] = [[] for _ in target]
            for doc_id, sha, text in zip(*(c.to_pylist() for c in batch.columns[:3])):
                if ids and text != content:
                    end(out, edge)
                    edge, ids = 0, []
                if not ids:
                    content, digest = text, sha
                ids.append(doc_id)
            yield rows(out)
        if ids:
            out = [[] for _ in target]
            end(out, edge | LAST)
            yield rows(out)

    return ordered.mapInArrow(run, schema)


def joined_edges(rows: DataFrame) -> list[Row]:
    """``part``, ``edge``, ``keep_id``, ``group_size`` and ``head`` (the group's first row is there) of
    every run at an edge: two rows per partition at most."""
    spark = rows.sparkSession
    edges = rows.where("first AND edge > 0").select(
        "part", "edge", "keep_id", "group_size", "content")
    found = sorted(edges.drop("content").collect(), key=lambda r: (r.part, r.edge & LAST))
    parts = sorted({r.part for r in found})
    after = spark.createDataFrame(list(zip(parts, parts[1:])), "part int, next int")
    ends = edges.where(F.col("edge").bitwiseAND(LAST) > 0).join(F.broadcast(after), "part").select(
        "next", "part", "content")
    begins = edges.where(F.col("edge").bitwiseAND(FIRST) > 0).select(
        F.col("part").alias("next"), "content")
    goes_on = {r.part for r in ends.join(begins, ["next", "content"]).select("part").collect()}
    out: list[Row] = []
    group: list[Row] = []
    for r in found:
        if group and not (r.edge & FIRST and group[-1].edge & LAST and group[-1].part in goes_on):
            out += _whole(group)
            group = []
        group.append(r)
    return out + _whole(group)


def _whole(group: list[Row]) -> list[Row]:
    size = sum(r.group_size for r in group)
    return [Row(part=r.part, edge=r.edge, whole_id=group[0].keep_id, whole=size, head=i == 0)
            for i, r in enumerate(group)]


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``keep_id`` (largest id with an equal text), ``group_size``, ``kept`` and
    ``text_sha256`` of every row."""
    rows = keep(runs(sorted_contents(docs, text, key)))
    whole = rows.sparkSession.createDataFrame(
        joined_edges(rows), "part int, edge int, whole_id long, whole long, head boolean")
    inner = F.col("edge") == 0
    return rows.join(F.broadcast(whole), ["part", "edge"], "left").select(
        "doc_id", F.when(inner, F.col("keep_id")).otherwise(F.col("whole_id")).alias("keep_id"),
        F.when(inner, F.col("group_size")).otherwise(F.col("whole")).alias("group_size"),
        (F.col("first") & (inner | F.col("head"))).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that stay, all columns; of rows equal in id and content one."""
    place = {"_none": F.col(key).isNull(), "_id": F.coalesce(whole_number(key), F.lit(0)),
             "_sha": F.sha2(normal(text), 256)}
    stay = exact_groups(docs, text, key).where("kept").select(
        F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"),
        F.col("text_sha256").alias("_sha"))
    return (docs.withColumns(place).join(stay, list(place), "left_semi").dropDuplicates(list(place))
            .select(*(F.col(f"`{c}`") for c in docs.columns)))


SQL = f"""
WITH contents AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS content FROM documents),
equals AS (
  SELECT content, max(doc_id) AS keep_id, count(*) AS group_size FROM contents GROUP BY content)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256
FROM contents JOIN equals USING (content)
"""
