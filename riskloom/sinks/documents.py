"""K2, K3, K7: report and inventory documents as ordered rows.

A document is the values of its rows one after the other: a head, a row per entry, a foot (and what lies
between two lists of entries). Rows are sorted by range over ``target``, part and order of the entries, so a
target with any number of entries is spread over tasks, one result may hold any number of targets, and
nothing is gathered. :func:`write_documents` writes them as text, a folder per target.

Entries but the first of a list begin with a comma. Which is the first is known before the sort: the least
entry of each target is found by a partial aggregate and written on its own, and it is counted off the
entries, of which equal ones are one row with a count until they are sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.severity import RANKS, rank
from riskloom.operators.findings import mode_rule

TOOL = "riskloom"
VERSION = "1.0.0"
#: Types of the columns that order entries.
KEYS = {"k1": "double", "k2": "int", "k3": "string", "k4": "long", "k5": "long", "k6": "string",
        "k7": "string"}
HEAD, FOOT = 0, 9


def _clean(c: Column | str) -> Column:
    """Control characters other than line ends and tabs become blanks."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(col, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " ")


def _one(c: Column | str) -> Column:
    """A score with one decimal."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 1).cast("decimal(6,1)")


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def _finding_order() -> dict[str, Column]:
    return {"k1": -F.col("risk_score"), "k2": -rank("severity"), "k3": F.col("file"),
            "k4": F.col("line"), "k5": F.col("column"), "k6": F.col("id")}


def _level() -> Column:
    return (F.when(F.col("severity").isin("critical", "high"), "error")
            .when(F.col("severity") == "medium", "warning").otherwise("note"))


def _message() -> Column:
    return F.format_string("%s (AI confidence %.1f%%, risk %.1f)", F.col("title"),
                           F.col("ai_confidence").cast("double"),
                           F.col("risk_score").cast("double"))


def with_target(df: DataFrame, by: str | None) -> DataFrame:
    """``_target``: the value of the column ``by``; without one all rows have one target, the empty name."""
    return df.withColumn("_target", F.col(by).cast("string") if by else F.lit(""))


def targets_of(df: DataFrame, by: str | None, targets: DataFrame | None) -> DataFrame:
    """The targets that get a document, even where they have no entry: those of ``targets`` (column
    ``by``) and of the rows."""
    if by is None:
        return df.sparkSession.range(1).select(F.lit("").alias("_target"))
    found = df.select("_target")
    if targets is not None:
        found = found.unionByName(targets.select(F.col(by).cast("string").alias("_target")))
    return found.distinct()


def _keyed(order: dict[str, Column]) -> list[Column]:
    return [order.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in KEYS.items()]


def _fixed(targets: DataFrame, part: int, value: Column) -> DataFrame:
    """One row of text per target."""
    return targets.select("_target", F.lit(part).alias("part"), *_keyed({}), F.lit(0).alias("again"),
                          value.alias("value"), F.lit(1).cast("long").alias("n"))


def _listed(df: DataFrame, part: int, order: dict[str, Column], value: Column) -> DataFrame:
    """The entries of a list: the first of each target as it is, all others behind a comma."""
    cells = ["_target", *KEYS, "value"]
    entries = df.select("_target", *_keyed(order), value.alias("value"))
    first = entries.groupBy("_target").agg(F.min(F.struct(*cells[1:])).alias("f")).select(
        "_target", "f.*")
    rest = (entries.withColumn("one", F.lit(1))
            .unionByName(first.withColumn("one", F.lit(-1)))
            .groupBy(*cells).agg(F.sum("one").alias("n")).where("n > 0"))
    picked = ["_target", F.lit(part).alias("part"), *KEYS]
    return first.select(*picked, F.lit(0).alias("again"), "value",
                        F.lit(1).cast("long").alias("n")).unionByName(rest.select(
                            *picked, F.lit(1).alias("again"),
                            F.concat(F.lit(","), "value").alias("value"), "n"))


def _assembled(*parts: DataFrame) -> DataFrame:
    """``target``, ``part`` and ``value`` of all rows in the order of the documents."""
    rows = reduce(DataFrame.unionByName, parts)
    order = ["_target", "part", *KEYS, "again", "value"]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return spread.select(F.col("_target").alias("target"), "part", "value",
                         F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("_copy")
                         ).drop("_copy")


def entries_of(rows: DataFrame, part: int) -> DataFrame:
    """The entries of one list as JSON texts, a row each."""
    return rows.where(F.col("part") == part).select(
        "target", F.regexp_replace("value", "^,", "").alias("entry"))


def write_documents(rows: DataFrame, path: str) -> None:
    """Text files below a folder per target; the files of a folder in the order of their names are its
    document, a line end between two entries. Targets named by the empty text lie in ``path`` itself under
    the partition name that Spark gives an empty value."""
    rows.select("target", "value").write.partitionBy("target").text(path)


def report_json(findings: DataFrame, scanned_files: int = 0, matched_rules: int = 0,
                dedup_mode: str = "normalized", original_total: int | None = None,
                by: str | None = None, targets: DataFrame | None = None) -> DataFrame:
    """K2: native JSON reports, one per value of the column ``by``; entries are part 1. ``targets`` names
    further targets, which have no finding."""
    found = with_target(findings, by)
    asked = targets_of(found, by, targets)
    counts = found.groupBy("_target").agg(
        F.count("*").alias("total"), F.count_if(F.col("ai_confidence") >= 70).alias("ai"),
        *[F.count_if(F.col("severity") == s).alias(f"_{s}") for s in sorted(RANKS)])
    top = mode_rule(found, "largest", keys=("_target",)).select("_target", "top_rule")
    joined = asked.join(counts, "_target", "left").join(top, "_target", "left").fillna(
        0, [c for c in counts.columns if c != "_target"])
    total = F.col("total")
    original = F.lit(original_total) if original_total is not None else total
    summary = F.struct(
        total, F.lit(scanned_files).alias("scanned_files"),
        F.lit(matched_rules).alias("matched_rules"), F.lit(dedup_mode).alias("dedup_mode"),
        original.alias("original_total"), total.alias("deduped_total"),
        F.col("ai").alias("ai_estimated"),
        F.coalesce("top_rule", F.lit("none")).alias("top_pattern"),
        F.struct(*[F.col(f"_{s}").alias(s) for s in sorted(RANKS)]).alias("by_severity"))
    entry = F.struct(
        "id", _clean("title").alias("title"), "severity", _clean("file").alias("file"), "line",
        "column", _clean("snippet").alias("snippet"), _one("ai_confidence").alias("ai_confidence"),
        _one("risk_score").alias("risk_score"), "category", "ai_tendency", "fix_suggestion", "tags")
    head = F.concat(F.lit('{"summary":'), _json(summary), F.lit(',"findings":['))
    return _assembled(_fixed(joined, HEAD, head), _listed(found, 1, _finding_order(), _json(entry)),
                      _fixed(asked, FOOT, F.lit("]}")))


def report_sarif(findings: DataFrame, dedup_mode: str = "normalized",
                 original_total: int | None = None, by: str | None = None,
                 targets: DataFrame | None = None) -> DataFrame:
    """K3: SARIF 2.1.0 documents, one per value of the column ``by``. The rules of the results are part 1,
    the results part 3."""
    found = with_target(findings, by)
    asked = targets_of(found, by, targets)
    text = lambda c: F.struct(_clean(c).alias("text"))
    one = F.lit(1)
    result = F.struct(
        F.col("id").alias("ruleId"), _level().alias("level"), text(_message()).alias("message"),
        F.array(F.struct(F.struct(
            F.struct(_clean("file").alias("uri")).alias("artifactLocation"),
            F.struct(F.greatest("line", one).alias("startLine"),
                     F.greatest("column", one).alias("startColumn")).alias("region"),
        ).alias("physicalLocation"))).alias("locations"),
        F.struct(_one("ai_confidence").alias("aiConfidence"), _one("risk_score").alias("riskScore"),
                 "category", "tags").alias("properties"))
    order = _finding_order()
    first = found.groupBy("_target", "id").agg(F.min(F.struct(
        *[c.alias(k) for k, c in order.items()], F.col("title"), _level().alias("level"))).alias("f"))
    rule = F.struct("id", F.col("id").alias("name"), text("f.title").alias("shortDescription"),
                    F.struct(F.col("f.level").alias("level")).alias("defaultConfiguration"))
    total = asked.join(found.groupBy("_target").agg(F.count("*").alias("total")), "_target",
                       "left").fillna(0, ["total"])
    original = F.lit(original_total) if original_total is not None else F.col("total")
    totals = _json(F.struct(F.lit(dedup_mode).alias("dedupMode"), original.alias("originalTotal"),
                            F.col("total").alias("dedupedTotal")))
    head = ('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":['
            f'{{"tool":{{"driver":{{"name":"{TOOL}","version":"{VERSION}","rules":[')
    return _assembled(
        _fixed(asked, HEAD, F.lit(head)), _listed(first, 1, {"k3": F.col("id")}, _json(rule)),
        _fixed(total, 2, F.concat(F.lit(']}},"properties":'), totals, F.lit(',"results":['))),
        _listed(found, 3, order, _json(result)), _fixed(asked, FOOT, F.lit("]}]}")))


# Inventory documents (K7) --------------------------------------------------------------------

def _package_order() -> dict[str, Column]:
    return {"k3": F.col("manifest_file"), "k6": F.col("name"), "k7": F.col("version")}


def sbom_spdx(packages: DataFrame, created: str, namespace: str, name: str = "inventory",
              by: str | None = None, targets: DataFrame | None = None) -> DataFrame:
    """K7: SPDX 2.3 documents of packages that have ``purl`` and ``spdx_id``, one per value of ``by``;
    packages are part 1. A target's name ends its document's namespace."""
    found = with_target(packages, by)
    asked = targets_of(found, by, targets)
    entry = F.struct(
        F.col("spdx_id").alias("SPDXID"), F.col("name"), F.col("version").alias("versionInfo"),
        F.lit("NOASSERTION").alias("downloadLocation"), F.lit(False).alias("filesAnalyzed"),
        F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"),
                         F.lit("purl").alias("referenceType"),
                         F.col("purl").alias("referenceLocator"))).alias("externalRefs"))
    own = F.coalesce(F.nullif("_target", F.lit("")), F.lit(name))
    opening = F.to_json(F.struct(
        F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"),
        F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.lit(name).alias("name"),
        F.concat(F.lit(namespace.rstrip("/") + "/"), own).alias("documentNamespace"),
        F.struct(F.lit(created).alias("created"), F.array(F.lit(f"Tool: {TOOL}")).alias("creators"),
                 F.lit("3.19").alias("licenseListVersion")).alias("creationInfo")))
    return _sbom(found, asked, opening, "packages", F.to_json(entry))


def sbom_cyclonedx(packages: DataFrame, created: str, by: str | None = None,
                   targets: DataFrame | None = None) -> DataFrame:
    """K7: CycloneDX 1.5 documents of packages that have ``purl``, one per value of ``by``; components are
    part 1."""
    found = with_target(packages, by)
    entry = F.struct(F.lit("library").alias("type"), F.col("name"), F.col("version"), F.col("purl"))
    tools = F.array(F.struct(F.lit(TOOL).alias("vendor"), F.lit(TOOL).alias("name"),
                             F.lit(VERSION).alias("version")))
    opening = F.to_json(F.struct(
        F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"),
        F.lit(1).alias("version"),
        F.struct(F.lit(created).alias("timestamp"), tools.alias("tools")).alias("metadata")))
    return _sbom(found, targets_of(found, by, targets), opening, "components", F.to_json(entry))


def _sbom(found: DataFrame, asked: DataFrame, opening: Column, name: str, entry: Column) -> DataFrame:
    head = F.concat(F.regexp_replace(opening, "[}]$", ""), F.lit(f',"{name}":['))
    return _assembled(_fixed(asked, HEAD, head), _listed(found, 1, _package_order(), entry),
                      _fixed(asked, FOOT, F.lit("]}")))
