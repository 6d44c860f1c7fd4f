"""Signals of generated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numbers import f32
from riskloom.functions.text import js_trim, lines_of, trim_white

COMMENT = r"^(//|#|\*)"

# Phrases of the keyword feature.
KEYWORDS = ["generated by", "openai", "chatgpt", "copilot", "anthropic", "claude",
            "here is the code", "sure,"]

# Phrases, placeholder names and points of the paste signal.
PASTE_PHRASES = [
    (r"(?i)here is the (code|solution|fix)", 2),
    (r"(?i)I('ve| have) (updated|fixed|refactored) the code", 2),
    (r"(?i)hope this helps", 1),
]
PLACEHOLDERS = ["foo", "bar", "baz", "example", "myFunction", "doSomething"]


def code_features(df: DataFrame, col: str) -> DataFrame:
    """Comment density, mean line length (at most 200) and keyword count (at most 10)."""
    staged = df.withColumn("_lines", lines_of(F.col(col)))
    n = F.size("_lines")
    comments = F.size(F.filter("_lines", lambda line: trim_white(line).rlike(COMMENT)))
    total = F.aggregate("_lines", F.lit(0).cast("bigint"),
                        lambda acc, line: acc + F.octet_length(line))
    lower = F.lower(F.col(col))
    hits = sum((lower.contains(k).cast("int") for k in KEYWORDS), F.lit(0))
    mean = F.least((f32(total) / f32(n)).cast("float"), f32(200.0))
    return (
        staged
        .withColumn("comment_density", F.when(n == 0, f32(0.0)).otherwise(
            (f32(comments) / f32(n)).cast("float")))
        .withColumn("mean_line_length", F.when(n == 0, f32(0.0)).otherwise(mean))
        .withColumn("keyword_score", F.when(n == 0, f32(0.0)).otherwise(
            f32(F.least(hits, F.lit(10)))))
        .drop("_lines")
    )


def paste_signal(text: Column) -> Column:
    """Points that a pasted text was written by an assistant."""
    score = F.lit(0)
    for pattern, points in PASTE_PHRASES:
        score = score + F.when(text.rlike(pattern), points).otherwise(0)
    names = sum((text.contains(p).cast("int") for p in PLACEHOLDERS), F.lit(0))
    lines = F.split(text, "\n", -1)
    comments = F.size(F.filter(lines, lambda line: js_trim(line).rlike(COMMENT)))
    dense = (F.size(lines) > 5) & (comments.cast("double") / F.size(lines) > 0.4)
    return (score + F.when(names >= 2, 1).otherwise(0) + F.when(dense, 1).otherwise(0)
            + F.when(text.contains("`"), 2).otherwise(0))


def line_count(text: Column) -> Column:
    """Lines of a pasted text, any line end."""
    return F.size(F.split(text, "\r\n|\r|\n", -1))
