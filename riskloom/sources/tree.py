"""The data source ``source_tree``: the files of a directory tree, listed in tasks.

A partition is a directory. Planning lists the first levels until there is work for every slot. With the
option ``budget`` a task lists that many directories and hands the rest of its branch back as rows of kind
``dir``; these are stored, dealt evenly and given to the next round as ``directories``, so a deep or a wide
branch never stays with one task. Without a budget branches are walked to their end, all rows are files, and
filters on ``path`` and ``name`` are pushed into the walk.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith,
    StringStartsWith)

from riskloom.session import scratch, stored

SCHEMA = "path string, name string, kind string, size long"
#: Directories that a task lists before it hands the rest back.
BUDGET = 512
#: Levels that planning lists, as long as there are fewer directories than slots.
PLAN_LEVELS = 3
BATCH = 10_000


class Directory(InputPartition):
    """A directory to list, with what lies below it or without."""

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class Single(InputPartition):
    """The root itself, where that is a file."""

    def __init__(self, path: str):
        self.path = path


class Listed(InputPartition):
    """A file of a stored table of directories."""

    def __init__(self, path: str):
        self.path = path


#: How a pushed filter is tested on the value of its column.
TESTS = {
    StringEndsWith: lambda have, want: have.endswith(want),
    StringStartsWith: lambda have, want: have.startswith(want),
    StringContains: lambda have, want: want in have,
    EqualTo: lambda have, want: have == want,
    In: lambda have, want: have in want,
}


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["root"]
        self.skip = frozenset(json.loads(options.get("skip", "[]")))
        self.slots = int(options.get("slots", "1"))
        self.budget = int(options["budget"]) if "budget" in options else None
        self.directories = options.get("directories")
        self.pushed: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if self.budget is None and type(f) in TESTS and column in ("path", "name"):
                self.pushed.append((type(f), column, f.value))
            else:
                yield f

    def _system(self, uri: str):
        from pyarrow import fs as pafs

        return pafs.FileSystem.from_uri(uri)

    def _entries(self, fs, directory: str) -> tuple[list[tuple], list[str]]:
        """Files and directories of a directory; one that is gone meanwhile holds nothing."""
        from pyarrow import fs as pafs

        found = [i for i in fs.get_file_info(pafs.FileSelector(directory, allow_not_found=True))
                 if i.base_name.lower() not in self.skip]
        below = sorted(i.path for i in found if i.type == pafs.FileType.Directory)
        return self._files([i for i in found if i.type == pafs.FileType.File]), below

    def _files(self, infos: list) -> list[tuple]:
        """Rows of the files that pass the pushed filters."""
        return [(i.path, i.base_name, "file", i.size) for i in infos if all(
            TESTS[kind](i.path if column == "path" else i.base_name, want)
            for kind, column, want in self.pushed)]

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as pafs

        if self.directories:
            fs, path = self._system(self.directories)
            return [Listed(i.path) for i in fs.get_file_info(pafs.FileSelector(path))
                    if i.base_name.startswith("part-")]
        fs, path = self._system(self.root)
        if fs.get_file_info(path).type == pafs.FileType.File:
            return [Single(path)]
        shallow: list[str] = []
        level = [path]
        for _ in range(PLAN_LEVELS):
            if len(level) >= self.slots:
                break
            shallow += level
            level = [d for parent in level for d in self._entries(fs, parent)[1]]
        return [Directory(d, False) for d in shallow] + [Directory(d, True) for d in level]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = self._system(self.root)
        deep, todo, rows = True, [], []
        if isinstance(partition, Listed):
            import pyarrow.parquet as pq

            store, _ = self._system(self.directories)
            todo = pq.read_table(partition.path, columns=["path"], filesystem=store)["path"].to_pylist()
        elif isinstance(partition, Directory):
            deep, todo = partition.deep, [partition.path]
        elif isinstance(partition, Single):
            info = fs.get_file_info(partition.path)
            rows = self._files([info])
        listed = 0
        while todo and (self.budget is None or listed < self.budget):
            path = todo.pop()
            found, below = self._entries(fs, path)
            rows += found
            todo += below if deep else []
            listed += 1
            while len(rows) >= BATCH:
                yield _batch(rows[:BATCH])
                rows = rows[BATCH:]
        rows += [(d, d.rstrip("/").rsplit("/", 1)[-1], "dir", None) for d in todo]
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))],
        names=["path", "name", "kind", "size"])


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def tree(spark: SparkSession, uri: str, skip_names: tuple[str, ...] = (), **options: str) -> DataFrame:
    """The source as a DataFrame; directories named in ``skip_names`` are not entered."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # planning runs outside this process
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("root", uri).option(
        "skip", json.dumps([n.lower() for n in skip_names])).option(
        "slots", str(spark.sparkContext.defaultParallelism))
    return reader.options(**options).load()


def walked(spark: SparkSession, uri: str, skip_names: tuple[str, ...] = (), budget: int = BUDGET
           ) -> DataFrame:
    """``path``, ``name`` and ``size`` of all files below ``uri``: rounds of listing, each over stored
    directories that are dealt evenly, until none is left."""
    slots = spark.sparkContext.defaultParallelism
    found = stored(tree(spark, uri, skip_names, budget=str(budget)))
    files = found
    while not (rest := found.where("kind = 'dir'")).isEmpty():
        path = scratch(spark)
        rest.select("path").repartition(slots).write.parquet(path)
        found = stored(tree(spark, uri, skip_names, budget=str(budget),
                            directories=path if "://" in path else "file://" + path))
        files = files.unionByName(found)
    return files.where("kind = 'file'").drop("kind")
