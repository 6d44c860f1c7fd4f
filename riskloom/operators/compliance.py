"""CWE and OWASP keys for findings that do not name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.severity import literal_map
from riskloom.functions.text import ascii_lower, trim_white

_INJECTION = "A03:2021 - Injection"
_ACCESS = "A01:2021 - Broken Access Control"
_CRYPTO = "A02:2021 - Cryptographic Failures"
_MISCONFIG = "A05:2021 - Security Misconfiguration"
_OUTDATED = "A06:2021 - Vulnerable and Outdated Components"
_IDENTITY = "A07:2021 - Identification and Authentication Failures"

# CWE and OWASP key per tag, per category and per rule-id segment.
BY_TAG = {
    "sql-injection": ("CWE-89", _INJECTION), "nosql": ("CWE-943", _INJECTION),
    "command-injection": ("CWE-78", _INJECTION), "command": ("CWE-78", _INJECTION),
    "path-traversal": ("CWE-22", _ACCESS), "code-execution": ("CWE-94", _INJECTION),
    "timing-attack": ("CWE-208", _IDENTITY), "weak-hash": ("CWE-327", _CRYPTO),
    "crypto": ("CWE-327", _CRYPTO), "key-management": ("CWE-327", _CRYPTO),
    "secrets": ("CWE-798", _IDENTITY), "cors": ("CWE-942", _MISCONFIG),
    "debug": ("CWE-489", _MISCONFIG), "supply-chain": ("CWE-1104", _OUTDATED),
    "auth": ("CWE-287", _IDENTITY), "token": ("CWE-287", _IDENTITY),
    "identity": ("CWE-287", _IDENTITY), "misconfig": ("CWE-16", _MISCONFIG),
    "hardening": ("CWE-16", _MISCONFIG), "network": ("CWE-16", _MISCONFIG),
}
BY_CATEGORY = {
    "auth": ("CWE-287", _IDENTITY), "crypto": ("CWE-327", _CRYPTO),
    "injection": ("CWE-74", _INJECTION), "misconfig": ("CWE-16", _MISCONFIG),
}
BY_SEGMENT = [
    ("-AUTH-", ("CWE-287", _IDENTITY)), ("-CRYPTO-", ("CWE-327", _CRYPTO)),
    ("-INJ-", ("CWE-74", _INJECTION)), ("-MISC-", ("CWE-16", _MISCONFIG)),
    ("-MISCONFIG-", ("CWE-16", _MISCONFIG)),
]


def _pick(which: int, rule_id: Column) -> Column:
    tags = literal_map({k: v[which] for k, v in BY_TAG.items()})
    named = F.filter(F.transform(F.col("tags"), lambda t: F.try_element_at(
        tags, ascii_lower(trim_white(t)))), lambda v: v.isNotNull())
    categories = literal_map({k: v[which] for k, v in BY_CATEGORY.items()})
    segment = F.lit(None).cast("string")
    for part, values in reversed(BY_SEGMENT):
        segment = F.when(F.upper(rule_id).contains(part), values[which]).otherwise(segment)
    return F.coalesce(F.get(named, F.lit(0)),
                      F.try_element_at(categories, ascii_lower("category")), segment)


def enrich_compliance(df: DataFrame, rule_id: str = "id") -> DataFrame:
    """The given keys, else those of the first known tag, the category or the id; the two
    fields are filled independently."""
    rid = F.col(rule_id)
    return df.withColumns({
        "cwe_id": F.coalesce(F.col("cwe_id"), _pick(0, rid)),
        "owasp_category": F.coalesce(F.col("owasp_category"), _pick(1, rid))})
