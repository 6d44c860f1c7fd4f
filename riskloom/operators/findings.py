"""Selecting, deduplicating and counting findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scoring import grade_color, grade_label, grade_points
from riskloom.functions.severity import RANKS, min_severity, rank, severity_counts
from riskloom.functions.text import ascii_lower, normalize_snippet
from riskloom.operators.matching import ai_only

# Severity threshold, prior threshold and prior filter of the scan profiles.
PROFILES = {"strict": (None, None, False), "pragmatic": ("high", 0.50, True),
            "ai-focus": (None, 0.75, True)}
DEDUP_BY_FORMAT = {"table": "none", "json": "normalized", "sarif": "normalized",
                   "github": "normalized"}


def profile_settings(profile: str, severity: str | None = None, threshold: float | None = None
                     ) -> tuple[str | None, float | None, bool]:
    """(severity, prior threshold, prior filter); explicit values win over the profile."""
    name = profile.strip().lower().replace("_", "-")
    level, prior, only = PROFILES["ai-focus" if name == "aifocus" else name]
    return severity or level, threshold if threshold is not None else prior, only


def apply_profile(df: DataFrame, profile: str) -> DataFrame:
    """P9 on rows that carry both the severity and the rule's prior ``confidence``."""
    level, prior, only = profile_settings(profile)
    out = ai_only(df, prior if prior is not None else 0.70) if only else df
    return min_severity(out, level) if level else out


def parse_location(spec: str) -> tuple[str, int | None, int | None]:
    """``path[:line[:column]]``; numbers are 1-based."""
    raw = spec.strip()
    parts = raw.split(":")
    numbers: list[int] = []
    while len(parts) > 1 and len(numbers) < 2 and parts[-1].isascii() and parts[-1].isdigit():
        numbers.insert(0, int(parts.pop()))
    path = ":".join(parts)
    if not path:
        raise ValueError("a target path is required")
    if any(n == 0 for n in numbers):
        raise ValueError("line and column are 1-based")
    line, column = (numbers + [None, None])[:2]
    return path, line, column


def at_location(df: DataFrame, spec: str) -> DataFrame:
    """Findings of a file or below a folder, optionally at a line and column."""
    path, line, column = parse_location(spec)
    out = df if path == "." else df.where(
        (F.col("file") == path) | F.col("file").startswith(path.rstrip("/") + "/"))
    if line is not None:
        out = out.where(F.col("line") == line)
    if column is not None:
        out = out.where(F.col("column") == column)
    return out


def search_text() -> Column:
    """What a search looks at: id, title, file, position and severity, A-Z in lower case."""
    place = F.concat_ws(":", "file", F.col("line").cast("string"), F.col("column").cast("string"))
    return ascii_lower(F.concat_ws(" ", "id", "title", "file", place, "severity"))


def search(df: DataFrame, query: str) -> DataFrame:
    """Every word of the query occurs in the searched text."""
    text = search_text()
    return df.where(reduce(lambda a, b: a & b,
                           [text.contains(t) for t in query.lower().split()], F.lit(True)))


def category_key(col: str = "category") -> Column:
    return ascii_lower(F.coalesce(F.col(col), F.lit("uncategorized")))


def _best_first() -> list[Column]:
    return [F.desc("risk_score"), F.desc(rank("severity")), F.desc("ai_confidence"), F.asc("id"),
            F.asc("column"), F.asc("title")]


def dedup_findings(df: DataFrame, mode: str = "normalized", by: str | None = None) -> DataFrame:
    """The strongest finding per file, line, category and normalised snippet (and per value of the
    column ``by``, such as a target). The row limit per key runs before the shuffle too, so a key with
    very many copies sends one row per task."""
    if mode == "none":
        return df
    keys = {"_file": ascii_lower("file"), "_category": category_key(),
            "_snippet": normalize_snippet("snippet")}
    order = Window.partitionBy(*([by] if by else []), "_file", "line", "_category", "_snippet"
                               ).orderBy(*_best_first())
    return (df.withColumns(keys).withColumn("_n", F.row_number().over(order))
            .where("_n = 1").drop("_n", *keys))


def _baseline_keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"_file": ascii_lower("file"), "_category": category_key()})


def minus_baseline(df: DataFrame, baseline: DataFrame, by: str | None = None) -> DataFrame:
    """Findings whose (file, line, category), and value of ``by``, is not in the baseline."""
    on = [*([by] if by else []), "_file", "line", "_category"]
    keys = _baseline_keyed(baseline).select(*on).distinct()
    return _baseline_keyed(df).join(keys, on, "left_anti").select(
        *df.columns)


def in_baseline(df: DataFrame, baseline: DataFrame) -> DataFrame:
    """The findings a baseline suppresses."""
    keys = _baseline_keyed(baseline).select("_file", "line", "_category").distinct()
    return _baseline_keyed(df).join(keys, ["_file", "line", "_category"], "left_semi").select(
        *df.columns)


def union_findings(*parts: DataFrame) -> DataFrame:
    """Rule, route and external findings in one table."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def review_comments(df: DataFrame, severity: str = "high", n: int = 25) -> DataFrame:
    """One comment per file and line at or above a severity, at most ``n``."""
    rows = min_severity(df, severity).withColumn(
        "line", F.when(F.col("line") > 0, F.col("line")).otherwise(1))
    order = Window.partitionBy("file", "line").orderBy(F.desc(rank("severity")), "id", "snippet")
    first = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return first.orderBy("file", "line").limit(n)


def cap_findings(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` strongest findings and ``dropped``, the number left out."""
    total = df.agg(F.count("*").alias("n")).scalar()
    top = df.orderBy(F.desc(rank("severity")), F.desc("risk_score"), "file", "line", "column",
                     "id").limit(n)
    return top.withColumn("dropped", F.greatest(total - F.lit(n), F.lit(0).cast("bigint")))


def summarize_findings(df: DataFrame, by: str | None = None) -> DataFrame:
    """G1: total and one count per severity, zero-filled; a row per value of the column ``by``."""
    counts = [F.count("*").alias("total"), *severity_counts()]
    return df.groupBy(by).agg(*counts) if by else df.agg(*counts)


def by_severity_map(df: DataFrame) -> DataFrame:
    """G1 with the counts as a map."""
    pairs = [x for name in RANKS for x in (F.lit(name), F.col(name))]
    return summarize_findings(df).select("total", F.create_map(*pairs).alias("by_severity"))


def mode_rule(df: DataFrame, tie: str = "largest", col: str = "id", keys: tuple[str, ...] = ()
              ) -> DataFrame:
    """The most frequent rule, ties to the largest or the smallest id."""
    counts = df.where(F.coalesce(F.col(col), F.lit("")) != "").groupBy(*keys, col).agg(
        F.count("*").alias("n"))
    tied = F.desc(col) if tie == "largest" else F.asc(col)
    if not keys:
        return counts.orderBy(F.desc("n"), tied).limit(1).select(
            F.col(col).alias("top_rule"), "n")
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), tied)
    return counts.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(
        *keys, F.col(col).alias("top_rule"), "n")


def dedup_summary(original: DataFrame, rendered: DataFrame, mode: str = "normalized") -> DataFrame:
    """Totals before and after dedup, one row."""
    counts = (original.select(F.lit(1).alias("a"), F.lit(0).alias("b"))
              .unionAll(rendered.select(F.lit(0).alias("a"), F.lit(1).alias("b"))))
    return counts.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("original_total"),
                      F.coalesce(F.sum("b"), F.lit(0)).alias("deduped_total")
                      ).withColumn("dedup_mode", F.lit(mode))


def should_fail(df: DataFrame) -> DataFrame:
    """One row, true when a finding is left."""
    return df.limit(1).agg((F.count("*") > 0).alias("fail"))


def grade(df: DataFrame) -> DataFrame:
    """X11: points, grade and colour of a set of findings."""
    counts = summarize_findings(df)
    points = grade_points(*[F.col(s) for s in ("critical", "high", "medium", "low")])
    score = F.col("score")
    return (counts.withColumn("score", points).withColumn("grade", grade_label(score))
            .withColumn("color", grade_color(score)))


def review_summary(df: DataFrame) -> DataFrame:
    """Counts, mean likelihood to one decimal, whole percent of likely generated findings."""
    return df.agg(
        F.count("*").alias("total"), *severity_counts(),
        F.coalesce(F.floor(F.avg(F.col("ai_confidence").cast("double")) * 10 + 0.5) / 10,
                   F.lit(0.0)).alias("avg_ai_confidence"),
        F.count_if(F.col("ai_confidence") >= 70).alias("ai_estimated"),
    ).withColumn("ai_generated_pct", F.when(F.col("total") > 0, F.floor(
        F.col("ai_estimated") * 100 / F.col("total"))).otherwise(F.lit(0).cast("bigint")))


def rulepack_coverage(rules: DataFrame, by: str = "language") -> DataFrame:
    """Rules per language or category."""
    if by == "language":
        rows = rules.select(F.explode(F.array_distinct("languages")).alias("language"), "id")
    else:
        rows = rules.select(F.coalesce(by, F.lit("uncategorized")).alias(by), "id")
    return rows.groupBy(by).agg(F.countDistinct("id").alias("rules"))
