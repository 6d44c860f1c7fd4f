"""Listing and reading file trees.

Spark's own file sources leave out names that start with a dot or an underscore, so
``.github/workflows`` and ``__init__.py`` would be lost. Here the tree is listed in tasks
(:mod:`riskloom.sources.tree`) and the files are dealt evenly and read in tasks, so neither the list nor
a text passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.tree import BUDGET, walked

#: Characters of small files that leave a task together; a larger file leaves alone.
BATCH = 4_000_000


def list_files(spark: SparkSession, root: str, skip_names: tuple[str, ...] = (),
               budget: int = BUDGET) -> DataFrame:
    """All files below ``root`` as ``path``; directories named in ``skip_names`` are not entered. Branches
    are dealt anew whenever a task has listed ``budget`` directories."""
    return walked(spark, root, tuple(skip_names), budget).select("path")


def read_texts(files: DataFrame, root: str, path_col: str = "path") -> DataFrame:
    """Add ``content`` to a table of paths, dealt evenly over the shuffle partitions; unreadable files and
    files that are not UTF-8 are dropped."""
    schema = f"{path_col} string, content string"

    def packed(paths: list[str], texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())],
                                          names=[path_col, "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, _ = pafs.FileSystem.from_uri(root)
        for batch in batches:
            paths, texts, size = [], [], 0
            for path in batch.column(0).to_pylist():
                try:
                    with fs.open_input_stream(path) as stream:
                        text = stream.read().decode("utf-8")
                except (OSError, UnicodeDecodeError):
                    continue
                paths.append(path)
                texts.append(text)
                size += len(text)
                if size > BATCH:
                    yield packed(paths, texts)
                    paths, texts, size = [], [], 0
            if paths:
                yield packed(paths, texts)

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select(F.col(path_col)).repartition(parts).mapInArrow(run, schema)


def as_uri(root: str) -> str:
    """A plain absolute path as a file URI; URIs stay as they are."""
    return root if "://" in root else "file://" + root
