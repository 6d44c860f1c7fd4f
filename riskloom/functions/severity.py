"""Severity order and thresholds."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANKS = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def rank(c: Column | str) -> Column:
    """5 for critical down to 1 for info, 0 for anything else."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.try_element_at(literal_map(RANKS), F.lower(col)), F.lit(0))


def min_severity(df: DataFrame, severity: str, col: str = "severity") -> DataFrame:
    """Rows at or above a severity."""
    keep = [name for name, r in RANKS.items() if r >= RANKS[severity.lower()]]
    return df.where(F.lower(F.col(col)).isin(keep))


def severity_counts(col: str = "severity", suffix: str = "") -> list[Column]:
    """One count per severity, zero when absent."""
    return [F.count_if(F.col(col) == name).alias(name + suffix) for name in RANKS]
