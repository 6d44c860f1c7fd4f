"""A folder of rule files as a rules table.

A rule file is a flat YAML document with fixed keys. The files are read as lines and folded back
with a window per file (a file is a few dozen lines), so the result is a plain DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.functions.severity import RANKS
from riskloom.functions.text import ascii_lower, ascii_upper, strip_quotes, trim_white
from riskloom.session import stored
from riskloom.sources.files import as_uri, list_files, read_texts

_ROOT_VALUES = ["id", "title", "severity", "confidence_that_ai_generated", "ai_tendency", "category"]


def _kv(text: Column, key: str) -> Column:
    """Value of ``key: value``, NULL when the line has another key."""
    return F.when(text.startswith(key + ":"),
                  strip_quotes(F.substring(text, len(key) + 2, 2**31 - 1)))


def _items(value: Column) -> Column:
    """Lower-cased items of an inline list; no brackets give no items."""
    inner = F.regexp_extract(trim_white(value), r"(?s)^\[(.*)\]$", 1)
    cleaned = F.transform(F.split(inner, ","), lambda x: ascii_lower(strip_quotes(x)))
    return F.filter(cleaned, lambda x: x != "")


def _unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))


def parse_rules(files: DataFrame, unescape: bool = False) -> DataFrame:
    """Rule rows of ``path, content`` files, with an ``errors`` array next to the rule columns."""
    rows = files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "raw"))
    rows = rows.withColumn("text", trim_white("raw"))
    rows = rows.where((F.col("text") != "") & ~F.col("text").startswith("#"))
    text = F.col("text")
    at_root = ~F.col("raw").startswith(" ")
    order = Window.partitionBy("path").orderBy("pos")

    section = (F.when(at_root & (text == "pattern:"), "pattern")
               .when(at_root & (text == "negative_patterns:"), "negative")
               .when(at_root & (text == "fix:"), "fix").when(at_root, "root"))
    rows = rows.withColumn("section", F.last(section, ignorenulls=True).over(order))

    in_pattern = ~at_root & (F.col("section") == "pattern")
    marker = F.when(at_root & (text == "pattern:"), "any")
    for key, field in [("contains", "any"), ("any", "any"), ("all", "all"), ("not", "not")]:
        marker = marker.when(in_pattern & text.startswith(key + ":"), field)
    rows = rows.withColumn("field", F.last(marker, ignorenulls=True).over(order))

    dash = F.when(text.startswith("- "), F.filter(
        F.array(ascii_lower(strip_quotes(F.substring(text, 3, 2**31 - 1)))), lambda x: x != ""))
    inline = F.coalesce(*[F.when(text.startswith(k + ":"), _items(_kv(text, k)))
                          for k in ("contains", "any", "all", "not")])
    negative_inline = F.when(text.startswith("contains:"), _items(_kv(text, "contains")))
    needles = (F.when(in_pattern, F.coalesce(inline, dash))
               .when(~at_root & (F.col("section") == "negative"),
                     F.coalesce(negative_inline, dash)))
    if unescape:
        needles = F.transform(needles, _unescaped)
    rows = rows.withColumn("needles", needles)

    def last_value(value: Column) -> Column:
        return F.max_by(F.when(at_root, value), F.when(at_root & value.isNotNull(), F.col("pos")))

    def gathered(condition: Column) -> Column:
        parts = F.array_sort(F.collect_list(F.when(condition & F.col("needles").isNotNull(),
                                                   F.struct("pos", "needles"))))
        return F.flatten(F.transform(parts, lambda p: p["needles"]))

    def listed(key: str) -> Column:
        value = F.when(text.startswith(key + ":"), _items(_kv(text, key)))
        return F.coalesce(last_value(value), F.array().cast("array<string>"))

    def alias_of(*keys: str) -> Column:
        return last_value(F.coalesce(*[F.nullif(_kv(text, k), F.lit("")) for k in keys]))

    def pattern(field: str) -> Column:
        return gathered((F.col("section") == "pattern") & (F.col("field") == field))

    suggestion = F.when(~at_root & (F.col("section") == "fix"), _kv(text, "suggestion"))
    folded = rows.groupBy("path").agg(
        *[last_value(_kv(text, k)).alias(k) for k in _ROOT_VALUES],
        listed("languages").alias("languages"), listed("tags").alias("tags"),
        ascii_upper(alias_of("cwe_id", "cwe")).alias("cwe_id"),
        alias_of("owasp_category", "owasp").alias("owasp_category"),
        F.max_by(suggestion, F.when(suggestion.isNotNull(), F.col("pos"))).alias("fix_suggestion"),
        pattern("any").alias("pattern_any"), pattern("all").alias("pattern_all"),
        pattern("not").alias("pattern_not"),
        gathered(F.col("section") == "negative").alias("negative_patterns"),
    )
    severity = F.coalesce(ascii_lower("severity"), F.lit("medium"))
    confidence = F.coalesce(F.col("confidence_that_ai_generated").try_cast("float"),
                            F.lit(0.7).cast("float"))
    out = folded.withColumn("severity", severity).withColumn("confidence", confidence)
    no_needles = (F.size("pattern_any") == 0) & (F.size("pattern_all") == 0)
    checks = [
        (F.coalesce(F.col("id"), F.lit("")) == "", "missing id"),
        (F.coalesce(F.col("title"), F.lit("")) == "", "missing title"),
        (F.size("languages") == 0, "missing languages"),
        (no_needles, "missing pattern.any/contains or pattern.all"),
        (~F.col("severity").isin(list(RANKS)), "unknown severity"),
    ]
    errors = F.filter(F.array(*[F.when(bad, F.lit(m)) for bad, m in checks]),
                      lambda e: e.isNotNull())
    return out.select("path", errors.alias("errors"), *schemas.RULE.fieldNames())


def load_rules(spark: SparkSession, root: str, unescape: bool = False, strict: bool = True
               ) -> DataFrame:
    """The rules below a folder, parsed once and stored, as a scan asks for its rules several times.
    ``strict`` fails on the first bad file, as a scan must not run with a part of its rules; otherwise bad
    files are left out."""
    uri = as_uri(root)
    files = list_files(spark, uri).where(F.lower("path").rlike(r"\.ya?ml$"))
    parsed = stored(parse_rules(read_texts(files, uri), unescape))
    bad = F.size("errors") > 0
    if strict:
        first = parsed.where(bad).select("path", "errors").first()
        if first:
            raise ValueError(f"{first['path']}: {', '.join(first['errors'])}")
    return parsed.where(~bad).select(*schemas.RULE.fieldNames())


def rules_from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A rules table from Python dicts; missing lists are empty and missing values default."""
    lists = {"languages", "tags", "pattern_any", "pattern_all", "pattern_not", "negative_patterns"}
    data = []
    for row in rows:
        full = {"severity": "medium", "confidence": 0.7, **row}
        data.append(tuple([s.lower() for s in full.get(name, [])] if name in lists
                          else full.get(name) for name in schemas.RULE.fieldNames()))
    return spark.createDataFrame(data, schemas.RULE)


def template(title: str, **fields) -> dict:
    """A checked rule row to fill in: severity and prior confidence must be valid."""
    severity = str(fields.get("severity", "medium")).lower()
    if severity not in RANKS:
        raise ValueError("severity must be critical, high, medium, low or info")
    confidence = float(fields.get("confidence", 0.7))
    if not 0.0 <= confidence <= 1.0:
        raise ValueError("confidence must be between 0 and 1")
    for name in ("languages", "tags", "pattern_any", "pattern_all", "pattern_not"):
        if isinstance(fields.get(name, []), str):
            raise ValueError(f"{name} must be a list")
    return {**fields, "title": title, "severity": severity, "confidence": confidence}
