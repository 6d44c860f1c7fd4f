"""Sensitive routes without an access check nearby."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.functions.numbers import f32
from riskloom.functions.text import ascii_lower, contains_any, lines_of, text_lower, trim_white
from riskloom.sources.reports import parsed_once

# Words that make a route sensitive, and access hints of script routes.
SENSITIVE = ["admin", "account", "billing", "payment", "profile", "internal", "private", "manage",
             "settings", "user"]
AUTH_HINTS = ["auth", "jwt", "passport", "requireauth", "verifytoken", "loginrequired",
              "authenticated"]
TITLE = "Potential Unprotected Sensitive Route"


@dataclass(frozen=True)
class RouteCheck:
    language: str
    rule_id: str
    routes: list[str]
    guards: list[str]
    before: int
    after: int
    likelihood: float
    risk: float
    tendency: str
    suggestion: str


# Route markers, guard markers, windows, scores and texts per language.
JS = RouteCheck(
    "javascript", "JS-AUTH-XF-001",
    ["app.get(", "app.post(", "app.put(", "app.delete(",
     "router.get(", "router.post(", "router.put(", "router.delete("],
    ["app.use(", "router.use("], 0, 0, 58.0, 70.0,
    "A handler of a sensitive path is registered ahead of any access middleware.",
    "Register the access middleware first, or put it on this route or on its router.")
PYTHON = RouteCheck(
    "python", "PY-AUTH-XF-001",
    ["@app.route(", "@bp.route(", "@api.route(", "@app.get(", "@app.post(", "@router.get(",
     "@router.post("],
    ["@login_required", "@jwt_required", "@auth_required", "@roles_required",
     "@permission_required", "@requires_auth"], 4, 3, 57.0, 69.0,
    "A view of a sensitive path has no access decorator near it.",
    "Decorate the view, for example with @login_required or @jwt_required().")
JAVA = RouteCheck(
    "java", "JAVA-AUTH-XF-001",
    ["@getmapping(", "@postmapping(", "@putmapping(", "@deletemapping(", "@requestmapping("],
    ["@preauthorize", "@secured", "@rolesallowed", "@authenticationprincipal"], 4, 0, 56.0, 68.5,
    "A controller method maps a sensitive path without an access annotation.",
    "Annotate the method, for example with @PreAuthorize or @Secured.")

ROUTE_IDS = [c.rule_id for c in (JS, PYTHON, JAVA)]


def quoted_segment(line: Column) -> Column:
    """Text of the first double-quoted part, else of the first single-quoted part. A line
    without a closed double-quoted part gives nothing, even when it has single quotes."""
    double = trim_white(F.regexp_extract(line, '(?s)^[^"]*"([^"]*)"', 1))
    single = trim_white(F.regexp_extract(line, "(?s)^[^']*'([^']*)'", 1))
    closed = line.rlike('(?s)^[^"]*"[^"]*"')
    return F.when(double != "", double).when(closed, single).otherwise(F.lit(""))


def is_sensitive(route: Column) -> Column:
    """A route that names something worth protecting."""
    return contains_any(ascii_lower(route), SENSITIVE)


def _is_open(check: RouteCheck, x: Column) -> Column:
    """No access check covers the route line ``x``: for scripts neither on the line nor registered
    at or above it, otherwise none in the lines around."""
    if check.before == check.after == 0:
        return ~contains_any(x["lower"], AUTH_HINTS) & (
            (F.col("_first") == 0) | (F.col("_first") > x["line"]))
    start = F.greatest(x["line"] - check.before, F.lit(1))
    around = F.slice(F.col("_guards"), start, x["line"] + check.after - start + 1)
    return ~F.exists(around, lambda g: g)


def _routes(corpus: DataFrame, checks: list[RouteCheck], id_prefix: str) -> DataFrame:
    """Unguarded route lines of all given languages in one pass over the corpus. Files without a
    route marker of their language drop before any line work; each line is compared with a window of
    bounded size or one position."""
    language = ascii_lower("language")

    def pick(value) -> Column:
        """The value of the check that belongs to the file's language."""
        out = F.when(F.col("_lang") == checks[0].language, value(checks[0]))
        for check in checks[1:]:
            out = out.when(F.col("_lang") == check.language, value(check))
        return out

    def guards(check: RouteCheck, x: Column) -> Column:
        found = contains_any(x, check.guards)
        return found & contains_any(x, AUTH_HINTS) if check is JS else found

    routed = F.lit(False)
    for check in checks:
        routed = routed | ((F.col("_lang") == check.language)
                           & contains_any(F.col("_text"), check.routes))
    # The lower-cased text is made once per file of a wanted language, not once per marker.
    files = corpus.where(language.isin([c.language for c in checks])).withColumn("_lang", language)
    files = parsed_once(files, "_text", text_lower("content")).where(routed)
    keep = [c for c in corpus.columns if c not in ("content", "language", "path")]
    files = files.withColumn("_lines", lines_of("content")).withColumn("_lower", lines_of("_text"))
    # A text without any guard has none on its lines.
    files = files.withColumn("_guards", F.when(
        pick(lambda check: contains_any(F.col("_text"), check.guards)),
        F.transform("_lower", lambda x: pick(lambda check: guards(check, x))))
        .otherwise(F.array().cast("array<boolean>")))
    files = files.withColumn("_first", F.array_position("_guards", F.lit(True)))
    at = F.transform("_lower", lambda low, i: F.when(
        pick(lambda check: contains_any(low, check.routes)), i))

    def route(i: Column) -> Column:
        """The route line at ``i``. Its route is cut out once, not once per word that it may name."""
        text = F.get(F.col("_lines"), i)
        return F.struct((i + 1).alias("line"), text.alias("text"),
                        F.get(F.col("_lower"), i).alias("lower"),
                        ascii_lower(quoted_segment(text)).alias("route"))

    routes = F.transform(F.filter(at, lambda i: i.isNotNull()), route)
    hits = F.filter(routes, lambda x: contains_any(x["route"], SENSITIVE)
                    & pick(lambda check: _is_open(check, x)))
    missing = F.lit(None).cast("string")
    return files.select(*keep, "_lang", F.explode(hits).alias("hit")).select(
        *keep, pick(lambda c: F.lit(id_prefix + c.rule_id)).alias("id"),
        F.lit(TITLE).alias("title"), F.lit("high").alias("severity"),
        F.col("hit.line").cast("int").alias("line"), F.lit(1).alias("column"),
        trim_white(F.col("hit.text")).alias("snippet"),
        pick(lambda c: f32(c.likelihood)).alias("ai_confidence"),
        pick(lambda c: f32(c.risk)).alias("risk_score"), F.lit("auth").alias("category"),
        missing.alias("cwe_id"), missing.alias("owasp_category"),
        F.array(*map(F.lit, ["auth", "cross-file", "heuristic"])).alias("tags"),
        pick(lambda c: F.lit(c.tendency)).alias("ai_tendency"),
        pick(lambda c: F.lit(c.suggestion)).alias("fix_suggestion"))


def unguarded_routes_js(corpus: DataFrame, id_prefix: str = "") -> DataFrame:
    """Routes with neither an access hint on the line nor a guard registered at or above it."""
    return _routes(corpus, [JS], id_prefix)


def unguarded_routes_py(corpus: DataFrame, id_prefix: str = "") -> DataFrame:
    """Routes without an access decorator from four lines above to three below."""
    return _routes(corpus, [PYTHON], id_prefix)


def unguarded_routes_java(corpus: DataFrame, id_prefix: str = "") -> DataFrame:
    """Routes without an access annotation in the four lines above or on the line."""
    return _routes(corpus, [JAVA], id_prefix)


def unguarded_routes(corpus: DataFrame, id_prefix: str = "", by: str | None = None) -> DataFrame:
    """R7-R9 together, in the columns of a finding, and the corpus's column ``by``."""
    return _routes(corpus, [JS, PYTHON, JAVA], id_prefix).select(
        *schemas.FINDING.fieldNames(), *([by] if by else []))
