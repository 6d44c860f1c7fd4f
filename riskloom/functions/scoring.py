"""Scores of a finding and of a project, as column expressions.

Every operand of a finding score is single precision so that rounding agrees with the published
one-decimal scores.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numbers import clamp, f32, round1_f32, round_exact
from riskloom.functions.severity import literal_map
from riskloom.functions.text import ascii_lower, contains_any

# Words and points of the likelihood score.
GENERATED_PATH = ["generated", "autogen", "assistant", "copilot", "ai", "llm", "tmp", "draft"]
TEST_PATH = ["test", "tests", "fixture", "fixtures", "example", "examples"]
SHORTCUT_SNIPPET = [
    "todo", "quick fix", "temporary", "disable security", "verify=false", "shell=true",
    "debug=true", "ignoreexpiration: true", "runtime.getruntime().exec", "eval(",
]
SECURE_SNIPPET = [
    "compare_digest(", "timingsafeequal(", "constanttimecompare(", "preparedstatement",
    "parameterized", "securerandom", "cryptographically secure",
]

# Words and points of the context score.
CRITICAL_PATH = [
    "auth", "login", "token", "session", "secret", "password", "admin", "payment", "billing",
    "checkout", "wallet", "invoice", "payout", "transfer", "credential", "oauth",
]
ELEVATED_PATH = ["api", "gateway", "handler", "controller", "middleware"]
SENSITIVE_SNIPPET = ["password", "token", "secret", "authorization", "bearer"]
CATEGORY_POINTS = {"auth": 8.0, "crypto": 6.0, "injection": 9.0}

# Words and points of the exploitability score.
BASE_BY_WORD = [("injection", 86.0), ("auth", 80.0), ("crypto", 74.0), ("misconfig", 64.0)]
HIGH_SINK = [
    "eval(", "exec(", "runtime.getruntime().exec", "os.system(", "shell=true", "shell = true",
    "innerhtml", "document.write(", "$where", "verify=false", "verify = false",
]
MEDIUM_SINK = [
    "select *", "insert into", "update ", "delete from", "md5(", "sha1(", "math.random(",
]
EXPOSED_PATH = ["internet", "public", "external", "api", "gateway", "handler"]

SEVERITY_POINTS = {"critical": 100.0, "high": 80.0, "medium": 50.0, "low": 20.0, "info": 10.0}


def _points(condition: Column, value: float) -> Column:
    return F.when(condition, f32(value)).otherwise(f32(0.0))


def long_identifiers(text: Column) -> Column:
    """Number of identifiers of ten or more characters that are not plain numbers."""
    word = "[A-Za-z0-9_]"
    return F.regexp_count(text, F.lit(rf"(?<!{word})(?=[0-9]*[A-Za-z_]){word}{{10,}}"))


def ai_likelihood(confidence: Column, path: Column, snippet: Column) -> Column:
    """0-100 likelihood that a hit is generated code, one decimal. Path and snippet are
    lower-cased."""
    p, s = path, snippet
    size = F.octet_length(s)
    score = (
        clamp(f32(confidence), f32(0.0), f32(1.0)) * f32(100.0)
        + _points(contains_any(p, GENERATED_PATH), 8.0)
        - _points(contains_any(p, TEST_PATH), 14.0)
        + _points(contains_any(s, SHORTCUT_SNIPPET), 7.0)
        - _points(contains_any(s, SECURE_SNIPPET), 8.0)
        + _points(size > 120, 2.0)
        - _points(size < 20, 2.0)
        - _points(long_identifiers(s) >= 2, 4.0)
    )
    return round1_f32(clamp(score, f32(0.0), f32(100.0)))


def context_risk(path: Column, category: Column, snippet: Column) -> Column:
    """How sensitive the surroundings of a hit are, 15-98. Path and snippet are lower-cased."""
    p, s = path, snippet
    by_path = (F.when(contains_any(p, CRITICAL_PATH), f32(30.0))
               .when(contains_any(p, ELEVATED_PATH), f32(12.0)).otherwise(f32(0.0)))
    cat = ascii_lower(category)
    by_category = f32(0.0)
    for name, value in CATEGORY_POINTS.items():
        by_category = F.when(cat == name, f32(value)).otherwise(by_category)
    score = (f32(50.0) + by_path + _points(contains_any(s, SENSITIVE_SNIPPET), 10.0) + by_category
             - _points(contains_any(p, [*TEST_PATH, "docs"]), 18.0))
    return clamp(score, f32(15.0), f32(98.0))


def exploitability(rule_id: Column, tags: Column, category: Column, path: Column,
                   snippet: Column) -> Column:
    """How easily a hit is abused, 20-98. Path and snippet are lower-cased."""
    words = ascii_lower(F.concat_ws(" ", tags, category, rule_id))
    p, s = path, snippet
    base = f32(58.0)
    for word, value in reversed(BASE_BY_WORD):
        base = F.when(words.contains(word), f32(value)).otherwise(base)
    sink = (F.when(contains_any(s, HIGH_SINK), f32(12.0))
            .when(contains_any(s, MEDIUM_SINK), f32(7.0)).otherwise(f32(0.0)))
    score = (base + sink + _points(contains_any(p, EXPOSED_PATH), 5.0)
             - _points(contains_any(p, TEST_PATH), 10.0))
    return clamp(score, f32(20.0), f32(98.0))


def risk_score(severity: Column, likelihood: Column, context: Column, exploit: Column) -> Column:
    """Weighted risk, 0-100, one decimal."""
    sev = F.coalesce(F.try_element_at(literal_map(SEVERITY_POINTS), F.lower(severity)), F.lit(0.0))
    score = (f32(sev) * f32(0.3) + clamp(f32(likelihood), f32(0.0), f32(100.0)) * f32(0.3)
             + context * f32(0.2) + exploit * f32(0.2))
    return round1_f32(clamp(score, f32(0.0), f32(100.0)))


def lowered(df: DataFrame, path: str = "path") -> DataFrame:
    """Add the lower-cased path ``_p`` and snippet ``_s`` that the scores look at."""
    return df.withColumns({"_p": ascii_lower(path), "_s": ascii_lower("snippet")})


def with_scores(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``ai_confidence`` and ``risk_score`` to rule hits."""
    p, s, cat = F.col("_p"), F.col("_s"), F.col("category")
    scored = lowered(df, path).withColumn(
        "ai_confidence", ai_likelihood(F.col("confidence"), p, s))
    return scored.withColumn("risk_score", risk_score(
        F.col("severity"), F.col("ai_confidence"), context_risk(p, cat, s),
        exploitability(F.col("id"), F.col("tags"), cat, p, s))).drop("_p", "_s")


# Blend with a model (X5) ---------------------------------------------------------------------

@dataclass(frozen=True)
class Calibration:
    model_weight: float
    heuristic_weight: float
    scale: float
    bias: float
    min_probability: float
    max_probability: float

    def tuned(self, **overrides: float) -> Calibration:
        """Overrides from a model manifest, clamped to their allowed ranges."""
        new = replace(self, **{k: v for k, v in overrides.items() if v is not None})
        low = min(max(new.min_probability, 0.0), 1.0)
        return Calibration(
            max(new.model_weight, 0.0), max(new.heuristic_weight, 0.0),
            min(max(new.scale, 0.2), 2.0), min(max(new.bias, -0.5), 0.5),
            low, min(max(new.max_probability, low), 1.0))


# The three calibration profiles.
CALIBRATION = {
    "conservative": Calibration(0.55, 0.45, 0.90, -0.03, 0.02, 0.97),
    "balanced": Calibration(0.70, 0.30, 1.00, 0.00, 0.01, 0.99),
    "aggressive": Calibration(0.82, 0.18, 1.08, 0.03, 0.00, 1.00),
}


def blend(probability: Column, heuristic: Column, profile: str = "balanced",
          **overrides: float) -> Column:
    """Weighted mean of a calibrated model probability and the heuristic score; the heuristic
    alone where the model gave nothing."""
    c = CALIBRATION[profile].tuned(**overrides)
    p = clamp(f32(probability), f32(0.0), f32(1.0)) * f32(c.scale) + f32(c.bias)
    model = clamp(p, f32(c.min_probability), f32(c.max_probability)) * f32(100.0)
    weight = F.greatest(f32(c.model_weight) + f32(c.heuristic_weight), f32(2.0 ** -23))
    mixed = ((model * f32(c.model_weight) + f32(heuristic) * f32(c.heuristic_weight))
             / weight).cast("float")
    return F.when(probability.isNull(), f32(heuristic)).otherwise(
        round1_f32(clamp(mixed, f32(0.0), f32(100.0))))


# Scores of a project -------------------------------------------------------------------------

def grade_points(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    """X11: 100 minus weighted counts, 0-100."""
    return clamp(F.lit(100) - (critical * 25 + high * 10 + medium * 3 + low), F.lit(0), F.lit(100))


def grade_label(points: Column) -> Column:
    return (F.when(points >= 95, "A+").when(points >= 85, "A").when(points >= 70, "B")
            .when(points >= 50, "C").when(points >= 25, "D").otherwise("F"))


def grade_color(points: Column) -> Column:
    return (F.when(points >= 95, "brightgreen").when(points >= 85, "green")
            .when(points >= 70, "yellowgreen").when(points >= 50, "yellow")
            .when(points >= 25, "orange").otherwise("red"))


def compliance_score(total: Column, critical: Column, high: Column, medium: Column,
                     low: Column) -> Column:
    """Score text with one decimal and a percent sign."""
    penalty = (critical * 10 + high * 5 + medium * 2 + low).cast("double")
    points = 100.0 - F.least(penalty / F.nullif(total, F.lit(0)), F.lit(100.0))
    return F.when(total <= 0, F.lit("100.0%")).otherwise(
        F.format_string("%.1f%%", round_exact(points, 1)))


def security_score(critical: Column, high: Column) -> Column:
    """100 without critical or high findings, else 100 minus weighted counts."""
    return F.when(critical + high == 0, F.lit(100).cast("bigint")).otherwise(
        F.greatest(F.lit(0).cast("bigint"), F.lit(100) - (critical * 10 + high * 3)))


def heat_level(total: Column, critical: Column, high: Column) -> Column:
    """Heat of a team."""
    return (F.when(critical > 0, "critical").when(high > 5, "high")
            .when(total > 0, "medium").otherwise("none"))
