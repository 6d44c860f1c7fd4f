"""The scan history log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.text import trim_white, unescape_history

COUNTS = ["total", "critical", "high", "medium", "low", "info", "ai_estimated"]


def parse_history(df: DataFrame, col: str = "value") -> DataFrame:
    """Log lines as records; lines without ten fields or with counts that are no numbers drop."""
    keep = [c for c in df.columns if c != col]
    parts = F.split(trim_white(col), r"\|", -1)
    rows = df.select(*keep, parts.alias("p")).where(F.size("p") == 10)
    number = lambda i: F.col("p")[i].try_cast("bigint")
    out = rows.select(
        *keep, number(0).alias("timestamp"), unescape_history(F.col("p")[1]).alias("target"),
        *[number(i + 2).alias(name) for i, name in enumerate(COUNTS)],
        unescape_history(F.col("p")[9]).alias("top_rule"))
    return out.dropna(subset=["timestamp", *COUNTS])


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return parse_history(spark.read.text(path))
