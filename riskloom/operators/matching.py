"""Needle rules over a corpus.

A file meets all rules of its language at once: they are one array in one broadcast row. A rule needs its
needles somewhere in the file before a line can hold them, so the array is first cut to the rules that
fit the whole text; a file is split into lines once for all of these, and its hits are one array until
they leave the file. Files are never shuffled: the rules side is broadcast after its size was measured,
and a rules table above the limit is cut into slices that each fit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scoring import with_scores
from riskloom.functions.severity import rank
from riskloom.functions.text import ascii_lower, byte_column, lines_of, text_lower, trim_white
from riskloom.sources.reports import parsed_once

MARKER = "riskloom:ignore"
BROADCAST_BYTES = 64 * 1024 * 1024


def rules_for(rules: DataFrame, language: str) -> DataFrame:
    """P5: rules that apply to a language, ignoring case."""
    return rules.where(F.array_contains("languages", language.lower()))


def filter_rules(rules: DataFrame, categories: list[str]) -> DataFrame:
    """Rules whose category or one of whose tags is wanted; an empty list keeps all."""
    if not categories:
        return rules
    wanted = [c.lower() for c in categories]
    tags = F.transform("tags", ascii_lower)
    return rules.where(F.coalesce(ascii_lower("category").isin(wanted), F.lit(False))
                       | F.arrays_overlap(tags, F.array(*[F.lit(w) for w in wanted])))


def ai_only(rules: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Rules whose prior confidence reaches the threshold."""
    bound = min(max(threshold, 0.0), 1.0)
    return rules.where(F.col("confidence") >= F.lit(bound).cast("float"))


def _tail(line: Column, marker: str) -> Column:
    """What follows the first marker on a line, without leading colons; NULL without a marker."""
    after = F.substring(line, F.instr(line, marker) + len(marker), 2**31 - 1)
    bare = trim_white(F.ltrim(trim_white(after), F.lit(":")))
    return F.when(line.contains(marker), bare)


def _applies(tail: Column, rule_id: Column) -> Column:
    return F.coalesce((tail == "") | F.contains(tail, rule_id), F.lit(False))


def line_suppressed(line: Column, rule_id: Column, marker: str = MARKER) -> Column:
    """The line carries a marker that covers the rule. A whole-file marker is no line marker."""
    return ~line.contains(marker + "-file") & _applies(_tail(line, marker), rule_id)


def file_tails(content_lower: Column, marker: str = MARKER) -> Column:
    """Tails of the whole-file markers of a file, usually an empty array."""
    mark = marker + "-file"
    tails = F.transform(F.filter(lines_of(content_lower), lambda x: x.contains(mark)),
                        lambda x: _tail(x, mark))
    return F.when(content_lower.contains(mark), tails).otherwise(F.array().cast("array<string>"))


def suppress_lines(df: DataFrame, marker: str = MARKER, line: str = "text_lower",
                   previous: str = "previous_lower", rule_id: str = "rule_id") -> DataFrame:
    """R4 on rows that hold a line, the line before it and a rule id."""
    rid = ascii_lower(rule_id)
    hit = line_suppressed(F.col(line), rid, marker) | F.coalesce(
        line_suppressed(F.col(previous), rid, marker), F.lit(False))
    return df.where(~hit)


def suppress_files(df: DataFrame, marker: str = MARKER, content: str = "content",
                   rule_id: str = "rule_id") -> DataFrame:
    """R5 on rows that hold a whole text and a rule id."""
    rid = ascii_lower(rule_id)
    tails = file_tails(ascii_lower(content), marker)
    return df.where(~F.exists(tails, lambda t: _applies(t, rid)))


def _all_in(needles: Column, text: Column) -> Column:
    return F.forall(needles, lambda n: F.contains(text, n))


def _one_in(needles: Column, text: Column) -> Column:
    return (F.size(needles) == 0) | F.exists(needles, lambda n: F.contains(text, n))


def _none_in(needles: Column, text: Column) -> Column:
    return ~F.exists(needles, lambda n: F.contains(text, n))


def rule_slices(rules: DataFrame, limit: int = BROADCAST_BYTES) -> list[DataFrame]:
    """The rules in slices of at most ``limit`` bytes, measured by one small job over the rules. What
    is broadcast is a rule per language, so that is what counts."""
    size = F.octet_length(F.to_json(F.struct("*"))) * F.size(F.array_distinct(
        F.transform("languages", ascii_lower)))
    total = rules.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-total // limit))
    if n == 1:
        return [rules]
    slot = F.pmod(F.xxhash64("id"), F.lit(n))  # rules of one id stay together
    return [rules.where(slot == i) for i in range(n)]


#: What a hit takes from its rule.
RULE_FIELDS = ("severity", "confidence", "category", "cwe_id", "owasp_category", "tags",
               "ai_tendency", "fix_suggestion")


def language_rules(rules: DataFrame) -> DataFrame:
    """A row per language: its rules as an array, and whether two of them share an id. This is what is
    broadcast, so it stays below the measured limit."""
    languages = F.array_distinct(F.transform("languages", ascii_lower))
    return (rules.select(F.struct(*rules.columns).alias("rule"),
                         F.explode(languages).alias("_language"))
            .groupBy("_language").agg(
                F.collect_list("rule").alias("_known"),
                (F.count("*") > F.count_distinct("rule.id")).alias("_twins")))


def candidates(corpus: DataFrame, rules: DataFrame, marker: str = MARKER) -> DataFrame:
    """Files with ``_rules``, the rules that can hit them: needles, negative patterns (R3) and whole-file
    suppression (R5) decided on the lower-cased text ``_lower``. A file meets its language's rules in
    one row; files without a rule that fits are gone."""
    def fits(rule: Column) -> Column:
        text, rid = F.col("_lower"), ascii_lower(rule["id"])
        return (
            _all_in(rule["pattern_all"], text) & _one_in(rule["pattern_any"], text)
            & ((F.size(rule["pattern_all"]) > 0) | (F.size(rule["pattern_any"]) > 0))
            & _none_in(rule["negative_patterns"], text)
            & ~F.exists("_tails", lambda t: _applies(t, rid)))

    files = corpus.withColumn("_language", ascii_lower("language")).join(
        F.broadcast(language_rules(rules)), "_language")
    files = parsed_once(files, "_lower", text_lower("content"))
    files = files.withColumn("_tails", file_tails(F.col("_lower"), marker))
    files = parsed_once(files, "_rules", F.filter("_known", fits))
    return files.where(F.size("_rules") > 0).drop("_tails", "_language", "_known")


def _line_marks(lines: Column, marker: str) -> Column:
    """Position and tail of the lines with a marker; a whole-file marker is no line marker."""
    found = F.transform(lines, lambda low, i: F.struct(
        i.alias("at"), _tail(low, marker).alias("tail"),
        low.contains(marker + "-file").alias("whole")))
    marks = F.filter(found, lambda m: m["tail"].isNotNull() & ~m["whole"])
    return F.when(F.col("_lower").contains(marker), marks).otherwise(
        F.array().cast("array<struct<at: int, tail: string, whole: boolean>>"))


def _rule_hits(rule: Column) -> Column:
    """The hits (R1, R2, R4) of one rule on the lines ``_low`` of a file. Suppression is looked up among
    the file's marks, usually none."""
    rid = ascii_lower(rule["id"])
    needles = F.concat(rule["pattern_any"], rule["pattern_all"])

    def matches(low: Column) -> Column:
        return (_all_in(rule["pattern_all"], low) & _one_in(rule["pattern_any"], low)
                & _none_in(rule["pattern_not"], low))

    def shown(i: Column) -> Column:
        return ~F.exists("_marks", lambda m: ((m["at"] == i) | (m["at"] == i - 1))
                         & _applies(m["tail"], rid))

    def hit(i: Column) -> Column:
        low = F.get(F.col("_low"), i)
        column = F.array_min(F.transform(needles, lambda n: byte_column(low, n)))
        return F.struct(
            rule["id"].alias("id"), (i + 1).cast("int").alias("line"),
            column.cast("int").alias("column"), rule["title"].alias("title"),
            *(rule[f].alias(f) for f in RULE_FIELDS))

    at = F.filter(F.transform("_low", lambda low, i: F.when(matches(low), i)),
                  lambda i: i.isNotNull() & shown(i))
    return F.transform(at, hit)


def _found(files: DataFrame, marker: str, unique: bool) -> DataFrame:
    """The files of :func:`candidates` that are hit, with their text and their ``hits`` in one array. The
    lower-cased text is split once."""
    kept = [c for c in files.columns if c not in ("_lower", "content", "_rules", "_twins")]
    staged = parsed_once(files, "_low", lines_of("_lower"))
    staged = parsed_once(staged, "_marks", _line_marks(F.col("_low"), marker))
    staged = parsed_once(staged, "_all", F.flatten(F.transform("_rules", _rule_hits)))
    staged = staged.where(F.size("_all") > 0)
    found = F.col("_all")
    if unique:  # R6 inside the file: the smallest column, then title, of equal ids on a line
        staged = parsed_once(staged, "_sorted", F.when(F.col("_twins"), F.array_sort("_all")))

        def first(hit: Column, i: Column) -> Column:
            before = F.get(F.col("_sorted"), i - 1)
            return (i == 0) | (before["id"] != hit["id"]) | (before["line"] != hit["line"])

        found = F.when(F.col("_twins"), F.filter("_sorted", first)).otherwise(found)
    return staged.select(*kept, "content", found.alias("hits"))


def hit_rows(files: DataFrame, *more: str) -> DataFrame:
    """A row per hit of files that carry their ``hits`` and their text's ``_lines``; ``more`` names columns
    of the file that go along."""
    kept = [c for c in files.columns if c not in ("content", "hits", "_lines", *more)]
    carried = dict.fromkeys([*kept, *more, "_lines"])
    hits = files.select(*carried, F.explode("hits").alias("hit"))
    return hits.select(
        *kept, "hit.id", "hit.title", "hit.severity", "hit.line", "hit.column",
        trim_white(F.get(F.col("_lines"), F.col("hit.line") - 1)).alias("snippet"),
        *(f"hit.{f}" for f in RULE_FIELDS[1:]), *more)


def hit_files(corpus: DataFrame, rules: DataFrame, marker: str = MARKER,
              limit: int = BROADCAST_BYTES, unique: bool = False) -> DataFrame:
    """The files that rules hit, a row each (per rules slice) with all columns and an array ``hits``. What
    needs a hit and its text together, such as fixes and contexts, works on this row."""
    parts = [_found(candidates(corpus, part, marker), marker, unique)
             for part in rule_slices(rules, limit)]
    return reduce(DataFrame.unionByName, parts)


def match_rules(corpus: DataFrame, rules: DataFrame, marker: str = MARKER,
                limit: int = BROADCAST_BYTES, unique: bool = False) -> DataFrame:
    """Hits of ``rules`` in a corpus of ``path, language, content`` (and any other columns,
    which are kept). No shuffle; the corpus is read once per rules slice, that is once. With ``unique``
    (R6) equal rule ids hit a line of a file once."""
    files = hit_files(corpus, rules, marker, limit, unique)
    return hit_rows(parsed_once(files, "_lines", lines_of("content")))


def unique_findings(df: DataFrame, *first: str, by: str | None = None) -> DataFrame:
    """One finding per rule, file and line (and value of ``by``), that with the smallest ``first``
    columns."""
    keys = [*([by] if by else []), "id", "file", "line"]
    order = Window.partitionBy(*keys).orderBy(*first, "column", "title")
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def scored_findings(corpus: DataFrame, rules: DataFrame, marker: str = MARKER) -> DataFrame:
    """Scored rule findings of a corpus that has ``path`` and ``file``."""
    return with_scores(match_rules(corpus, rules, marker)).drop("path", "language", "confidence")


def order_findings(df: DataFrame, by: str | None = None) -> DataFrame:
    """O1: by risk, severity, file, line; column and id make the order total. With ``by``, target after
    target."""
    return df.orderBy(*([by] if by else []), F.desc("risk_score"), F.desc(rank("severity")), "file", "line", "column",
                      "id")
