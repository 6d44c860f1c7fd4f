"""Continuous scan, continuous ingest and the hourly trend."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from riskloom.operators.ingest import ingest, upsert_findings
from riskloom.plans.scan import ScanOptions, scan
from riskloom.schemas import CORPUS


def corpus_stream(spark: SparkSession, path: str) -> DataFrame:
    """Changed files as they arrive in a folder of Parquet rows (path, language, content)."""
    rows = spark.readStream.schema(CORPUS).parquet(path)
    return rows.withColumn("file", F.col("path"))


def batch_folder(path: str, table: str, batch: DataFrame, batch_id: int) -> str:
    """Folder of a batch: below the id that Spark keeps in the stream's checkpoint. A batch that is
    run again overwrites its own folder; a stream with a new checkpoint starts a new run."""
    run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
    return f"{path}/{table}/run={run}/batch={batch_id}"


def checkpoint_location(path: str) -> str:
    """The checkpoint belongs to the output and lies below it."""
    return f"{path.rstrip('/')}/_checkpoint"


def scan_writer(rules: DataFrame, path: str, options: ScanOptions = ScanOptions()):
    """Function for ``foreachBatch``: the findings of a batch of files. A batch is a table, so every
    option of a scan works; all its keys hold the file, so a batch needs no other one."""
    def write(batch: DataFrame, batch_id: int) -> None:
        found = scan(batch, rules, options, ordered=False)
        found.write.mode("overwrite").parquet(batch_folder(path, "findings", batch, batch_id))
    return write


def stream_scan(corpus: DataFrame, rules: DataFrame, path: str,
                options: ScanOptions = ScanOptions(), name: str = "scan",
                debounce: str = "500 milliseconds") -> DataStreamWriter:
    """Findings of the files that changed, below ``path``; the trigger is the debounce."""
    return (corpus.writeStream.queryName(name).trigger(processingTime=debounce)
            .option("checkpointLocation", checkpoint_location(path))
            .foreachBatch(scan_writer(rules, path, options)))


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """The findings of all batches."""
    return spark.read.parquet(f"{path}/findings").drop("run", "batch")


def ingest_writer(path: str, col: str = "payload", received: str = "received_at"):
    """Function for ``foreachBatch``: writes the two tables and the refused payloads of a batch.

    Every batch owns its folders and overwrites them, so a batch that is run again after a failure
    leaves the same rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist(StorageLevel.DISK_ONLY)  # three outputs, one read of the source
        parts = ingest(rows, col, received)
        for name, df in (("scans", parts.scans), ("findings", parts.findings),
                         ("rejects", parts.rejects)):
            df.write.mode("overwrite").parquet(batch_folder(path, name, batch, batch_id))
        rows.unpersist()
    return write


def stream_ingest(payloads: DataFrame, path: str, name: str = "ingest", col: str = "payload",
                  received: str = "received_at") -> DataStreamWriter:
    """Payloads into the two tables."""
    return (payloads.writeStream.queryName(name)
            .option("checkpointLocation", checkpoint_location(path))
            .foreachBatch(ingest_writer(path, col, received)))


def _bases(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete compactions, ascending."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/compact")
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/compact/{n}/batches/_SUCCESS"))]
    return sorted(int(n) for n in done)


def current_findings(spark: SparkSession, path: str) -> DataFrame:
    """One row per key, from the latest compaction and the batches that it does not hold."""
    rows = spark.read.parquet(f"{path}/findings")
    bases = _bases(spark, path)
    if not bases:
        rows = rows.drop("run", "batch")
        return upsert_findings(rows.limit(0), rows)
    base = f"{path}/compact/{bases[-1]}"
    held = spark.read.parquet(f"{base}/batches")
    folded = spark.read.parquet(f"{base}/findings")
    since = rows.select("run", "batch").distinct().join(F.broadcast(held), ["run", "batch"], "left_anti")
    if since.isEmpty():  # a compaction has one row per key
        return folded
    rows = rows.join(F.broadcast(held), ["run", "batch"], "left_anti")  # a row per batch
    return upsert_findings(folded, rows.drop("run", "batch"))


def compact_findings(spark: SparkSession, path: str) -> None:
    """Write the current findings and the batches they hold, so that later reads fold only what
    came after. The list of batches is written last and makes the compaction count."""
    rows = spark.read.parquet(f"{path}/findings")
    batches = rows.select("run", "batch").distinct().collect()  # folder names
    target = f"{path}/compact/{(_bases(spark, path) or [0])[-1] + 1}"
    current_findings(spark, path).write.mode("overwrite").parquet(f"{target}/findings")
    held = spark.createDataFrame(batches, rows.select("run", "batch").schema)
    held.coalesce(1).write.mode("overwrite").parquet(f"{target}/batches")


def stream_trend(scans: DataFrame, delay: str = "2 hours", ts: str = "timestamp") -> DataFrame:
    """Hourly sums per organisation. A scan that is sent twice counts once while its first copy
    is inside the watermark."""
    once = scans.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["scan_id"])
    hourly = once.groupBy("org_id", F.window(ts, "1 hour").alias("w")).agg(
        F.count("scan_id").alias("scans"), F.sum("total_findings").alias("findings"),
        *[F.sum(f"{s}_count").alias(s) for s in ("critical", "high", "medium")],
        F.avg("ai_ratio").alias("ai_ratio"))
    return hourly.select("org_id", F.col("w.start").alias("hour"), "scans", "findings", "critical",
                         "high", "medium", "ai_ratio")
