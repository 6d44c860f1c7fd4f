"""The sample rules of the registered queries, as Spark rows and as a SQL table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.sources.rules import rules_from_rows


def _rule(id, title, severity, confidence, languages, category, tags, any=(), all=(), no=(),
          negative=(), **more):
    return {"id": id, "title": title, "severity": severity, "confidence": confidence,
            "languages": languages.split(), "category": category, "tags": list(tags),
            "pattern_any": list(any), "pattern_all": list(all), "pattern_not": list(no),
            "negative_patterns": list(negative), **more}


# Rules for the small source files.
CODE_RULES = [
    _rule("PY-CRYPTO-001", "Weak digest", "high", 0.86, "python", "crypto", ["weak-hash"],
          any=["hashlib.md5(", "hashlib.sha1("], fix_suggestion="Use sha256."),
    _rule("PY-AUTH-001", "Plain comparison of a secret", "high", 0.8, "python", "auth",
          ["timing-attack", "auth"], all=["token", "=="], no=["compare_digest("],
          ai_tendency="Copilot compares secrets directly", cwe_id="CWE-208"),
    # Quieter by severity, louder by risk than the rule above, on the same lines and category: the
    # severity filter has to come before the dedup.
    _rule("PY-AUTH-009", "Secret on a line", "medium", 0.99, "python", "auth",
          ["timing-attack", "auth"], all=["token", "=="], no=["compare_digest("]),
    _rule("PY-INJ-003", "Shell command", "critical", 0.75, "python", "injection",
          ["command-injection"], any=["shell=true", "shell = true"]),
    _rule("PY-CRYPTO-006", "Unchecked certificate", "medium", 0.65, "python", "misconfig",
          ["network"], any=["verify=false"], negative=["compare_digest("]),
    _rule("PY-MISC-009", "Open task", "info", 0.4, "python", None, [], any=["todo", "fixme"]),
    _rule("JS-INJ-004", "Markup sink", "high", 0.72, "javascript typescript", "injection",
          ["xss"], any=["innerhtml"]),
    _rule("JS-INJ-002", "Evaluated input", "critical", 0.9, "javascript", "injection",
          ["code-execution"], all=["eval(", "input"]),
    _rule("JS-INJ-003", "Shell command", "high", 0.6, "javascript", "injection", ["command"],
          any=["exec("]),
    _rule("JS-CRYPTO-001", "Weak digest", "medium", 0.7, "javascript", "crypto", ["weak-hash"],
          all=["createhash("], any=["'md5'", "'sha1'"]),
    _rule("JS-MISC-002", "Debug settings", "low", 0.5, "javascript", "misconfig", ["debug"],
          any=["debug: true"]),
    _rule("JAVA-CRYPTO-001", "Weak digest", "high", 0.81, "java", "crypto", ["weak-hash"],
          all=["messagedigest.getinstance("], any=['"md5"', '"sha-1"']),
    _rule("JAVA-AUTH-001", "Plain comparison of a secret", "medium", 0.66, "java", "auth",
          ["timing-attack"], any=["secret == provided"]),
    _rule("JAVA-CRYPTO-002", "Weak random", "low", 0.55, "java", "crypto", [],
          any=["new random()"]),
    _rule("GO-CRYPTO-001", "Weak digest", "high", 0.78, "go", "crypto", ["weak-hash"],
          any=["md5.sum("]),
    _rule("GO-AUTH-001", "Plain comparison of a secret", "medium", 0.7, "go", "auth", ["token"],
          all=["secret", "=="], negative=["constanttimecompare("]),
    _rule("GO-INJ-002", "Concatenated statement", "critical", 0.92, "go", "injection",
          ["sql-injection"], all=["select *", '" +']),
]

_ALL = "python javascript java go"

# Rules for free text.
TEXT_RULES = [
    _rule("TXT-SEC-001", "Token in text", "critical", 0.9, _ALL, "auth", ["secrets"],
          any=['token = "', "secret = "]),
    _rule("TXT-LIC-001", "Permissive licence line", "info", 0.3, _ALL, "misconfig",
          ["supply-chain"], any=["mit license", "apache license"]),
    _rule("TXT-LIC-002", "Copyleft licence line", "medium", 0.35, _ALL, None, ["supply-chain"],
          all=["general public license", "version"]),
    _rule("TXT-PII-001", "Mail address", "high", 0.7, _ALL, None, ["privacy"], any=["@mail"],
          no=["noreply"]),
    _rule("TXT-JUNK-001", "Marker run", "low", 0.6, _ALL, "misconfig", ["hardening"],
          any=["###", "$$$"], negative=["mit license"]),
    _rule("TXT-ACC-001", "Accented start", "low", 0.5, "javascript go", None, [],
          any=["é ", "ó "]),
    _rule("TXT-WORD-001", "Common words", "info", 0.2, "python", None, [],
          all=["the ", "of ", "with"], no=["###"]),
]

PAGE_RULES = [
    _rule("WEB-001", "Inline script", "medium", 0.7, "php", "injection", ["xss"],
          all=["<script", "track("]),
    _rule("WEB-002", "Tracked page without footer", "low", 0.5, "php", None, [], any=["track("],
          negative=["<footer"]),
    _rule("WEB-003", "Licence text", "info", 0.3, "php", "misconfig", [], any=["license"]),
]


def rules(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return rules_from_rows(spark, rows)


def _text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]::VARCHAR[]"


def rules_sql(rows: list[dict]) -> str:
    """The rules as a SQL table, one row per rule and language."""
    out = []
    for r in rows:
        for language in r["languages"]:
            out.append("(" + ", ".join([
                _text(r["id"]), _text(r["title"]), _text(r["severity"]),
                f"{r['confidence']}::REAL", _text(language), _text(r["category"]),
                _text(r.get("cwe_id")), _text(r.get("owasp_category")),
                _text(r.get("ai_tendency")), _text(r.get("fix_suggestion")), _list(r["tags"]),
                _list(r["pattern_any"]), _list(r["pattern_all"]), _list(r["pattern_not"]),
                _list(r["negative_patterns"])]) + ")")
    names = ("rid, title, severity, prior, lang, category, cwe_id, owasp_category, ai_tendency, "
             "fix_suggestion, tags, p_any, p_all, p_not, p_neg")
    return f"rules({names}) AS (VALUES " + ",\n".join(out) + ")"
