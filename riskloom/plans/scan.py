"""A whole scan composed from the operators."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.functions.scoring import with_scores
from riskloom.functions.severity import min_severity
from riskloom.operators.findings import (
    dedup_findings, minus_baseline, profile_settings, summarize_findings, union_findings)
from riskloom.operators.matching import (
    MARKER, ai_only, filter_rules, match_rules, order_findings, unique_findings)
from riskloom.operators.routes import ROUTE_IDS, unguarded_routes
from riskloom.session import stored
from riskloom.sources.corpus import exclude_paths


@dataclass(frozen=True)
class ScanOptions:
    categories: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    ai_only: bool = False
    min_prior: float | None = None
    cross_file: bool = False
    profile: str | None = None
    severity: str | None = None
    dedup: str = "none"
    marker: str = MARKER
    id_prefix: str = ""
    by: str | None = None


def scan(corpus: DataFrame, rules: DataFrame, options: ScanOptions = ScanOptions(),
         external: DataFrame | None = None, baseline: DataFrame | None = None,
         ordered: bool = True) -> DataFrame:
    """Findings of a corpus of ``path, file, language, content``. With the option ``by``, a column of the
    corpus such as its target, each value of it is a scan of its own: the findings carry it, dedup, order
    and the baseline keep to it where the baseline has that column too.

    Rule subset and path exclusion come first, then matching and scoring in one narrow stage, then
    route findings. External findings are added with a normalised dedup of all. Severity and
    baseline come before the dedup for output, so a finding that they drop hides no other one.
    """
    level, prior, only = options.severity, options.min_prior, options.ai_only
    if options.profile:
        level, prior, profile_only = profile_settings(options.profile, level, prior)
        only = only or profile_only
    chosen = filter_rules(rules, options.categories)
    if only:
        chosen = ai_only(chosen, 0.70 if prior is None else prior)
    files = exclude_paths(corpus, options.exclude)
    by = options.by
    columns = [*schemas.FINDING.fieldNames(), *([by] if by else [])]
    hits = match_rules(files, chosen, options.marker, unique=True)
    routes = [f"{options.id_prefix}{i}" for i in ROUTE_IDS] if options.cross_file else []
    if not routes or chosen.where(F.col("id").isin(routes)).isEmpty():
        out = with_scores(hits).select(*columns)
        if options.cross_file:
            out = union_findings(
                out, unguarded_routes(files, options.id_prefix, by).select(*columns))
    else:  # one finding per rule id, file and line, a rule's before a route check's
        out = with_scores(hits).select(*columns, F.lit(0).alias("_source"))
        if options.cross_file:
            found = unguarded_routes(files, options.id_prefix, by)
            out = union_findings(out, found.select(*columns, F.lit(1).alias("_source")))
        out = unique_findings(out, "_source", by=by).drop("_source")
    if external is not None:
        out = dedup_findings(union_findings(out, external.select(*columns)), "normalized", by)
    if level:
        out = min_severity(out, level)
    if baseline is not None:
        out = minus_baseline(out, baseline, by if by and by in baseline.columns else None)
    out = dedup_findings(out, options.dedup, by)
    return order_findings(out, by) if ordered else out


def scan_many(corpora: list[DataFrame], rules: DataFrame, options: ScanOptions = ScanOptions()
              ) -> DataFrame:
    """Findings of several targets, sorted once. A sort reads its rows twice, first for a sample of
    their order, so they are stored before it and no file is scanned twice."""
    parts = [scan(c, rules, options, ordered=False) for c in corpora]
    return order_findings(stored(reduce(DataFrame.unionByName, parts)), options.by)


def scan_summary(findings: DataFrame, corpus: DataFrame, rules: DataFrame) -> DataFrame:
    """G1 with scanned files (excluded files count) and loaded rules."""
    files = corpus.agg(F.count("*")).scalar()
    loaded = rules.agg(F.count("*")).scalar()
    return summarize_findings(findings).withColumns({"scanned_files": files,
                                                     "matched_rules": loaded})
