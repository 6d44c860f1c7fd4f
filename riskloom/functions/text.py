"""Text helpers as column expressions: ASCII case, line splitting, byte positions, escaping."""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points with the Unicode White_Space property, and the set JavaScript trims.
_SPACES = [0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x85, *_SPACES]))
JS_WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0xFEFF, *_SPACES]))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z only; every other letter keeps its case."""
    return F.translate(_col(c), ascii_uppercase, ascii_lowercase)


def text_lower(c: Column | str) -> Column:
    """:func:`ascii_lower` of a whole text. A text of ASCII alone goes the way of bytes, which costs a fraction
    of a look-up per character; the column is named three times, so it should be a plain one."""
    col = _col(c)
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(ascii_lower(col))


def ascii_upper(c: Column | str) -> Column:
    return F.translate(_col(c), ascii_lowercase, ascii_uppercase)


def trim_white(c: Column | str) -> Column:
    """Trim all Unicode white space, not just blanks."""
    return F.trim(_col(c), F.lit(WHITE_SPACE))


def js_trim(c: Column | str) -> Column:
    return F.trim(_col(c), F.lit(JS_WHITE_SPACE))


def null_if_blank(c: Column | str) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(trim_white(c), F.lit(""))


def contains_any(c: Column, needles: list[str]) -> Column:
    """True when one of the literal needles occurs."""
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles], F.lit(False))


def lines_of(c: Column | str) -> Column:
    """Lines ended by LF or CRLF; the text after a final line end is no line.

    The final line end is cut off before the split, whose result is not looked at twice, and the split is at
    a plain character, which needs no regular expression.
    """
    col = _col(c)
    body = (F.when(col.endswith("\r\n"), F.substring(col, F.lit(1), F.length(col) - 2))
            .when(col.endswith("\n"), F.substring(col, F.lit(1), F.length(col) - 1)).otherwise(col))
    parts = F.split(F.replace(body, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return F.when(col == "", F.array().cast("array<string>")).otherwise(parts)


def byte_column(line: Column, needle: Column) -> Column:
    """1-based byte position of the first occurrence (length + 1 when absent)."""
    return F.octet_length(F.call_function("substring_index", line, needle, F.lit(1))) + 1


def normalize_snippet(c: Column | str) -> Column:
    """ASCII letters and digits, lower-cased, other runs collapsed to one blank."""
    return F.trim(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", " "))


def truncate(c: Column, width: int) -> Column:
    """Shorten to ``width`` with an ellipsis when the text is longer in bytes."""
    return F.when(F.octet_length(c) <= width, c).otherwise(
        F.concat(F.substring(c, 1, max(width - 3, 0)), F.lit("...")))


def slug(c: Column | str) -> Column:
    """File-name slug of a rule title."""
    body = F.trim(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(body == "", F.lit("new-rule")).otherwise(body)


def sanitize_id(c: Column | str) -> Column:
    """Upper-case id with every run of other characters as one underscore."""
    return F.trim(F.regexp_replace(ascii_upper(c), "[^A-Z0-9]+", "_"), F.lit("_"))


def strip_quotes(c: Column) -> Column:
    """Trim, then drop one pair of double and one pair of single quotes."""
    bare = F.regexp_replace(trim_white(c), '(?s)^"(.*)"$', "$1")
    return F.regexp_replace(bare, "(?s)^'(.*)'$", "$1")


# Escaping ------------------------------------------------------------------------------------

def escape_history(c: Column | str) -> Column:
    return F.replace(F.replace(_col(c), F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C"))


def unescape_history(c: Column | str) -> Column:
    return F.replace(F.regexp_replace(_col(c), "(?i)%7C", "|"), F.lit("%25"), F.lit("%"))


def escape_annotation_message(c: Column | str) -> Column:
    out = F.replace(_col(c), F.lit("%"), F.lit("%25"))
    out = F.replace(out, F.lit("\r"), F.lit("%0D"))
    return F.replace(out, F.lit("\n"), F.lit("%0A"))


def escape_annotation_property(c: Column | str) -> Column:
    out = F.replace(escape_annotation_message(c), F.lit(":"), F.lit("%3A"))
    return F.replace(out, F.lit(","), F.lit("%2C"))


# Paths and ids -------------------------------------------------------------------------------

def base_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def repo_id(c: Column | str) -> Column:
    """host/owner/repo out of a remote URL."""
    url = F.regexp_replace(_col(c), r"(\.git)+$", "")
    host = F.regexp_extract(url, r"(?s)^git@([^:]*):", 1)
    rest = F.regexp_extract(url, r"(?s)^git@[^:]*:(.*)$", 1)
    return (
        F.when(url.rlike(r"(?s)^git@[^:]*:"), F.concat(host, F.lit("/"), rest))
        .when(url.rlike("^https?://"), F.regexp_replace(url, "^https?://", ""))
        .otherwise(url)
    )


def scan_hash(scan_id: Column, file_path: Column, line: Column, rule_id: Column) -> Column:
    """Hash of a finding inside one scan."""
    return F.sha2(F.concat_ws("::", scan_id.cast("string"), file_path,
                              F.coalesce(line, F.lit(0)).cast("string"), rule_id), 256)


def fingerprint(repo: Column, file_path: Column, line: Column, rule_id: Column) -> Column:
    """Hash that follows a finding of a repository across scans."""
    return F.sha2(F.concat_ws("::", F.coalesce(repo, F.lit("")), file_path,
                              F.coalesce(line, F.lit(0)).cast("string"), rule_id), 256)


def short_hash(c: Column | str) -> Column:
    """First eight hex digits of SHA-1."""
    return F.substring(F.sha1(_col(c)), 1, 8)
