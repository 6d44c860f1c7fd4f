"""T1 with a state per file: only changed content is scanned again.

The state of a path is the digest of its last content and the time of that change. A row with the same
content, or an older one, ends there. A new content waits for ``debounce`` milliseconds of quiet: it is
held in the state behind a timer, which every further change of that file sets anew, so the wait belongs
to the file and not to the stream. What leaves the state is scanned, and the findings of a file's last
version replace those of earlier ones when they are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import replace
from hashlib import sha256

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import (
    StatefulProcessor, StatefulProcessorHandle)

from riskloom.plans.scan import ScanOptions, scan
from riskloom.streaming.streams import batch_folder, checkpoint_location

CHANGED = "path string, file string, language string, content string, changed long"
#: The state of a file lives in a store that keeps what does not fit memory on disk.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def digest(content: str | None) -> str:
    return "" if content is None else sha256(content.encode()).hexdigest()


class LastContent(StatefulProcessor):
    """Lets a file's content pass when it differs from the last one and has been quiet long enough."""

    def __init__(self, debounce: int):
        self.debounce = debounce

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "digest string, changed long")
        self.waiting = handle.getValueState(
            "waiting", "file string, language string, content string, changed long")

    def _newest(self, rows: Iterator[pd.DataFrame]):
        best = None
        for frame in rows:
            for r in frame.itertuples(index=False):
                content = None if pd.isna(r.content) else r.content
                row = (int(r.changed), digest(content), r.file, r.language, content)
                if best is None or row[:2] > best[:2]:
                    best = row
        return best

    def _stop(self) -> None:
        self.waiting.clear()
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)

    def _passed(self, path, changed, file, language, content) -> pd.DataFrame:
        self.seen.update((digest(content), changed))
        return pd.DataFrame({"path": [path], "file": [file], "language": [language],
                             "content": [content], "changed": [changed]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = self._newest(rows)
        if newest is None:
            return
        changed, sha, file, language, content = newest
        held = self.waiting.get() if self.waiting.exists() else None
        seen = self.seen.get() if self.seen.exists() else None
        if (held and held[3] > changed) or (seen and seen[1] > changed):
            return  # older than what is known
        if seen and seen[0] == sha:
            if held:  # back to what was scanned
                self._stop()
            self.seen.update((sha, changed))
            return
        if not self.debounce:
            yield self._passed(key[0], changed, file, language, content)
            return
        if held:
            self._stop()
        self.waiting.update((file, language, content, changed))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.debounce)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            file, language, content, changed = self.waiting.get()
            self.waiting.clear()
            yield self._passed(key[0], changed, file, language, content)

    def close(self) -> None:
        pass


def changed_files(corpus: DataFrame, debounce: int = 0) -> DataFrame:
    """The rows of a stream of ``path, file, language, content, changed`` (a rising number per file, such as
    its time in microseconds) whose content is new, each after ``debounce`` milliseconds of quiet."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = corpus.select("path", "file", "language", "content", F.col("changed").cast("long"))
    return rows.groupBy("path").transformWithStateInPandas(
        statefulProcessor=LastContent(debounce), outputStructType=CHANGED, outputMode="Update",
        timeMode="ProcessingTime" if debounce else "None")


def version_writer(rules: DataFrame, path: str, options: ScanOptions = ScanOptions()):
    """Function for ``foreachBatch``: the versions of a batch and their findings. A batch that is run again
    overwrites its own folders."""
    if options.by:
        raise ValueError("a stream of files has its own versions; leave out by")

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = batch_folder(path, "versions", batch, batch_id)
        batch.write.mode("overwrite").parquet(folder)  # read twice: never run the stream's plan again
        files = batch.sparkSession.read.schema(batch.schema).parquet(folder)
        found = scan(files, rules, replace(options, by="changed"), ordered=False)
        found.write.mode("overwrite").parquet(batch_folder(path, "findings", batch, batch_id))
    return write


def start_files(corpus: DataFrame, rules: DataFrame, path: str, options: ScanOptions = ScanOptions(),
                name: str = "files", debounce: int = 0, **trigger) -> StreamingQuery:
    """Start the scan of changed files below ``path``. ``trigger`` are the arguments of Spark's trigger,
    by default one batch after the other."""
    spark = corpus.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, STORE)
    try:
        writer = (changed_files(corpus, debounce).writeStream.queryName(name).outputMode("update")
                  .option("checkpointLocation", checkpoint_location(path))
                  .foreachBatch(version_writer(rules, path, options)))
        return (writer.trigger(**trigger) if trigger else writer).start()
    finally:  # a query keeps the settings it started with
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def last_findings(spark: SparkSession, path: str) -> DataFrame:
    """The findings of every file's last version, none where that has none."""
    folder = F.struct("changed", "run", "batch")
    last = spark.read.parquet(f"{path}/versions").groupBy("path", "file").agg(
        F.max(folder).alias("last")).select("file", "last.*").distinct()
    return spark.read.parquet(f"{path}/findings").join(
        last, ["file", "changed", "run", "batch"], "left_semi").drop("changed", "run", "batch")
