"""Pieces of SQL that the checks share."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from queries.rulebook import rules_sql
from riskloom.functions import scoring
from riskloom.functions.text import JS_WHITE_SPACE, WHITE_SPACE

MARK = "riskloom:ignore"


def chars(text: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in text)


WS = "(" + chars(WHITE_SPACE) + ")"
JS_WS = "(" + chars(JS_WHITE_SPACE) + ")"


def lower(x: str) -> str:
    return f"translate({x}, '{ascii_uppercase}', '{ascii_lowercase}')"


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def any_in(x: str, needles: list[str]) -> str:
    parts = [f"contains({x}, '{n.replace(chr(39), chr(39) * 2)}')" for n in needles]
    return "(" + " OR ".join(parts) + ")"


def rank(x: str) -> str:
    return (f"(CASE {x} WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 "
            "WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END)")


def severity_counts(x: str = "severity") -> str:
    return ", ".join(f"count(*) FILTER (WHERE {x} = '{s}') AS {s}"
                     for s in ("critical", "high", "medium", "low", "info"))


def exact(x: str, digits: int, ties: str = "even") -> str:
    """Rounding by the exact binary value of a double, as in ``round_exact``."""
    s = float(10 ** digits)
    rest = (f"(((({x})::REAL::DOUBLE * {s} - floor(({x}) * {s}::DOUBLE)) - 0.5::DOUBLE) "
            f"+ (({x}) - ({x})::REAL::DOUBLE) * {s}::DOUBLE)")
    odd = "true" if ties == "up" else f"floor(({x}) * {s}::DOUBLE)::BIGINT % 2 = 1"
    return (f"((floor(({x}) * {s}::DOUBLE) + CASE WHEN {rest} > 0 OR ({rest} = 0 AND {odd}) "
            f"THEN 1 ELSE 0 END) / {s}::DOUBLE)")


def change(cur: str, prev: str) -> str:
    return (f"CASE WHEN {prev} <= 0 AND {cur} <= 0 THEN 0.0::DOUBLE WHEN {prev} <= 0 THEN NULL "
            f"ELSE round(({cur} - {prev})::DOUBLE / {prev} * 1000) / 10 END")


def ratio(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {part}::DOUBLE / {whole}::DOUBLE ELSE 0.0::DOUBLE END"


# Scores of a finding -------------------------------------------------------------------------

def _pts(cond: str, value: float) -> str:
    return f"(CASE WHEN {cond} THEN {value}::REAL ELSE 0::REAL END)"


def round1(x: str) -> str:
    return f"(round(({x}) * 10::REAL) / 10::REAL)"


def likelihood(prior: str, path: str, snippet: str) -> str:
    p, s = lower(path), lower(snippet)
    tokens = (f"len(list_filter(regexp_split_to_array({s}, '[^A-Za-z0-9_]'), "
              "lambda t: length(t) >= 10 AND NOT regexp_full_match(t, '[0-9]+')))")
    x = (f"least(greatest({prior}, 0::REAL), 1::REAL) * 100::REAL"
         f" + {_pts(any_in(p, scoring.GENERATED_PATH), 8)} - {_pts(any_in(p, scoring.TEST_PATH), 14)}"
         f" + {_pts(any_in(s, scoring.SHORTCUT_SNIPPET), 7)}"
         f" - {_pts(any_in(s, scoring.SECURE_SNIPPET), 8)} + {_pts(f'strlen({s}) > 120', 2)}"
         f" - {_pts(f'strlen({s}) < 20', 2)} - {_pts(f'{tokens} >= 2', 4)}")
    return round1(f"least(greatest({x}, 0::REAL), 100::REAL)")


def context(path: str, category: str, snippet: str) -> str:
    p, s, c = lower(path), lower(snippet), lower(category)
    by_path = (f"(CASE WHEN {any_in(p, scoring.CRITICAL_PATH)} THEN 30::REAL "
               f"WHEN {any_in(p, scoring.ELEVATED_PATH)} THEN 12::REAL ELSE 0::REAL END)")
    by_cat = f"(CASE {c} WHEN 'auth' THEN 8::REAL WHEN 'crypto' THEN 6::REAL " \
             "WHEN 'injection' THEN 9::REAL ELSE 0::REAL END)"
    x = (f"50::REAL + {by_path} + {_pts(any_in(s, scoring.SENSITIVE_SNIPPET), 10)} + {by_cat}"
         f" - {_pts(any_in(p, [*scoring.TEST_PATH, 'docs']), 18)}")
    return f"least(greatest({x}, 15::REAL), 98::REAL)"


def exploit(rid: str, tags: str, category: str, path: str, snippet: str) -> str:
    w = lower(f"concat_ws(' ', array_to_string({tags}, ' '), {category}, {rid})")
    p, s = lower(path), lower(snippet)
    base = ("(CASE " + " ".join(f"WHEN contains({w}, '{k}') THEN {v}::REAL"
                                for k, v in scoring.BASE_BY_WORD) + " ELSE 58::REAL END)")
    sink = (f"(CASE WHEN {any_in(s, scoring.HIGH_SINK)} THEN 12::REAL "
            f"WHEN {any_in(s, scoring.MEDIUM_SINK)} THEN 7::REAL ELSE 0::REAL END)")
    x = (f"{base} + {sink} + {_pts(any_in(p, scoring.EXPOSED_PATH), 5)}"
         f" - {_pts(any_in(p, scoring.TEST_PATH), 10)}")
    return f"least(greatest({x}, 20::REAL), 98::REAL)"


def risk(severity: str, ai: str, ctx: str, exp: str) -> str:
    sev = ("(CASE " + severity + " " + " ".join(
        f"WHEN '{k}' THEN {v}::REAL" for k, v in scoring.SEVERITY_POINTS.items())
        + " ELSE 0::REAL END)")
    x = (f"{sev} * 0.3::REAL + least(greatest({ai}, 0::REAL), 100::REAL) * 0.3::REAL"
         f" + {ctx} * 0.2::REAL + {exp} * 0.2::REAL")
    return round1(f"least(greatest({x}, 0::REAL), 100::REAL)")


def score1(x: str) -> str:
    """A one-decimal score as a plain double."""
    return f"round({x}::DOUBLE, 1)"


# Rule matching -------------------------------------------------------------------------------

def _tail(x: str, mark: str) -> str:
    after = trim(f"substr({x}, instr({x}, '{mark}') + {len(mark)})")
    return f"{trim(f'ltrim({after}, {chr(39)}:{chr(39)})')}"


def applies(x: str, mark: str) -> str:
    return (f"(contains({x}, '{mark}') AND ({_tail(x, mark)} = '' OR "
            f"contains({_tail(x, mark)}, {lower('rid')})))")


def line_suppressed(x: str) -> str:
    return f"(NOT contains({x}, '{MARK}-file') AND {applies(x, MARK)})"


def _all(needles: str, text: str) -> str:
    return f"len(list_filter({needles}, lambda n: contains({text}, n))) = len({needles})"


def _none(needles: str, text: str) -> str:
    return f"len(list_filter({needles}, lambda n: contains({text}, n))) = 0"


def _one(needles: str, text: str) -> str:
    return (f"(len({needles}) = 0 OR len(list_filter({needles}, lambda n: contains({text}, n))) "
            "> 0)")


def lines_cte(corpus_sql: str) -> str:
    """corpus, file_lines (path, language, content, lc, line, text, low, prev)."""
    return f"""corpus AS ({corpus_sql}),
cut AS (SELECT path, language, content, {lower('content')} AS lc,
  regexp_split_to_array(content, '\\r?\\n') AS ls FROM corpus),
file_lines AS (SELECT path, language, lc, len(ls) AS n, generate_subscripts(ls, 1) AS line,
  unnest(ls) AS text FROM cut),
numbered AS (SELECT path, language, lc, line, text, {lower('text')} AS low,
  {lower("lag(text) OVER (PARTITION BY path ORDER BY line)")} AS prev
  FROM file_lines WHERE NOT (line = n AND text = ''))"""


def hits_cte(corpus_sql: str, rules: list[dict]) -> str:
    """hits: every rule hit, unscored."""
    at = ("list_min(list_transform(list_concat(p_any, p_all), "
          "lambda n: strlen(split_part(low, n, 1)))) + 1")
    marks = (f"(SELECT path, list({lower('text')}) AS marked FROM file_lines WHERE "
             f"contains({lower('text')}, '{MARK}-file') GROUP BY path)")
    file_hit = f"len(list_filter(marked, lambda x: {applies('x', MARK + '-file')})) > 0"
    return f"""WITH {lines_cte(corpus_sql)}, {rules_sql(rules)},
marks AS {marks},
hits AS (SELECT numbered.path, language, line::INT AS line, ({at})::INT AS "column",
    {trim('text')} AS snippet, rules.* FROM numbered JOIN rules ON language = lang
  LEFT JOIN marks ON numbered.path = marks.path
  WHERE {_none('p_not', 'low')} AND {_all('p_all', 'low')} AND {_one('p_any', 'low')}
    AND {_none('p_neg', 'lc')} AND NOT {line_suppressed('low')}
    AND NOT coalesce({line_suppressed('prev')}, false)
    AND NOT coalesce({file_hit}, false))"""


def scored_cte(corpus_sql: str, rules: list[dict]) -> str:
    """scored: hits with ai (likelihood) and rs (risk), single precision."""
    return f"""{hits_cte(corpus_sql, rules)},
half AS (SELECT *, {likelihood('prior', 'path', 'snippet')} AS ai FROM hits),
scored AS (SELECT *, {risk('severity', 'ai', context('path', 'category', 'snippet'),
                           exploit('rid', 'tags', 'category', 'path', 'snippet'))} AS rs FROM half)"""
