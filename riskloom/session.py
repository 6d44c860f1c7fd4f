"""Session settings and the shared folder used for checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution does the run-time work: it merges small shuffle blocks, splits skewed
# join partitions and turns a shuffled join into a broadcast one once a side is measured small.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.python.filterPushdown.enabled": "true",
    # The JVM never compiles a method above 8,000 bytes of code; Spark then leaves the fused one and
    # runs operator by operator, in methods that are compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "riskloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: Where the workers of a local session find this package; a cluster gets it with ``--py-files``.
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def apply_settings(spark: SparkSession) -> SparkSession:
    """Pin the run-time settings on a session somebody else made, and let its Python workers find this
    package."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH")]))
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


#: The temporary folder of each local application that names none.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the cluster's ``spark.checkpoint.dir``; a temporary one, the same for
    the whole application, only where that is unset and Spark runs in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="riskloom-checkpoint-")
    return _LOCAL[app]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/riskloom/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession) -> str:
    """A new path below the shared folder, owned by this application."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete every table that this application stored. Results that were not written or collected
    yet may still read them, so this is for the end of a job."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """The same rows behind a table written to the shared folder, in one folder per value of
    ``by``. Results that are read several times (a report needs counts, an order and the rows) are
    computed once, and a lost executor does not bring the whole lineage back. :func:`release`
    deletes the tables."""
    path = scratch(df.sparkSession)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
