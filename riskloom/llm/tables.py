"""Tables written to the folder that the cluster shares: they cut lineage and outlive executors."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import scratch

#: The column that tells a task of Python which partition its rows are of.
PART = "_part"


def partition_number() -> Column:
    """The number of the partition that a row is in, for a projection right above the sort or scan
    that made the partitions. Python tasks must not ask their task instead: where a later step merges
    partitions, one task runs several of them."""
    return F.spark_partition_id().alias(PART)


def release_shuffles(df: DataFrame) -> None:
    """Spark deletes the files of shuffles that nothing can read any more when the driver's garbage is
    collected, by default every half hour; between two steps of a job that is asked for."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def keep(df: DataFrame) -> DataFrame:
    """The same rows, written once and read from the shared folder from now on."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    release_shuffles(df)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.riskloom_path = path
    return kept


def drop(kept: DataFrame) -> None:
    """Delete a table of :func:`keep` that no later result reads."""
    jvm = kept.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(kept.riskloom_path)
    path.getFileSystem(kept.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(
        path, True)
