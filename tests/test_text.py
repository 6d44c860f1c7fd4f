"""Scalar helpers against values worked out by hand."""

from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.functions.numbers import percent_change, round_exact
from riskloom.functions.scoring import compliance_score, grade_label, grade_points, security_score


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}")
    rows = df.select("i", expr(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


def test_ascii_lower_keeps_other_letters(spark):
    assert column(spark, ["ÉAbZ"], tx.ascii_lower) == ["Éabz"]


def test_lines(spark):
    got = column(spark, ["a\r\nb\n", "", "\n", "a\n\nb", "a\r", "a\r\r\nb", "x\n\n"], tx.lines_of)
    assert got == [["a", "b"], [], [""], ["a", "", "b"], ["a\r"], ["a\r", "b"], ["x", ""]]


def test_byte_column(spark):
    got = column(spark, ["éa token", "token", "none"], lambda c: tx.byte_column(c, F.lit("token")))
    assert got == [5, 1, 5]


def test_trim_and_blank(spark):
    assert column(spark, ["  CWE-79 ", " \t\u00a0", None], tx.null_if_blank) == ["CWE-79", None, None]


def test_repo_id(spark):
    urls = ["https://github.com/acme/repo.git", "git@github.com:acme/repo.git",
            "https://gitlab.com/group/project", "/local/path"]
    assert column(spark, urls, tx.repo_id) == [
        "github.com/acme/repo", "github.com/acme/repo", "gitlab.com/group/project", "/local/path"]


def test_history_escape_is_reversible(spark):
    text = "foo|bar%baz"
    assert column(spark, [text], tx.escape_history) == ["foo%7Cbar%25baz"]
    assert column(spark, [text], lambda c: tx.unescape_history(tx.escape_history(c))) == [text]


def test_small_texts(spark):
    assert column(spark, ["A  b--C!"], tx.normalize_snippet) == ["a b c"]
    assert column(spark, ["Weak Hash (MD5)", "!!"], tx.slug) == ["weak-hash-md5", "new-rule"]
    assert column(spark, ["py.lang//x..y"], tx.sanitize_id) == ["PY_LANG_X_Y"]
    assert column(spark, ["abcdef"], lambda c: tx.truncate(c, 5)) == ["ab..."]
    assert column(spark, ["a%b:c,d\n"], tx.escape_annotation_property) == ["a%25b%3Ac%2Cd%0A"]


def test_percent_change(spark):
    pairs = [(0.0, 0.0), (10.0, 0.0), (12.0, 10.0), (10.55, 10.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a double, b double")
    got = df.select("i", percent_change(F.col("a"), F.col("b")).alias("y")).orderBy("i").collect()
    assert [r["y"] for r in got] == [0.0, None, 20.0, 5.5]


def test_round_exact_follows_the_stored_value(spark):
    values = [98.25, 98.75, 98.35, 0.25, 0.35, 98.2]
    assert column(spark, values, lambda c: round_exact(c, 1), "double") == [
        float(f"{v:.1f}") for v in values]
    # the other tie rule sends exact ties up
    assert column(spark, [0.03125, 0.00375], lambda c: round_exact(c, 4, "up"), "double") == [
        0.0313, 0.0037]


def test_project_scores(spark):
    rows = [(0, 0, 1, 1, 1, 1), (1, 10, 1, 1, 1, 1), (2, 1, 20, 0, 0, 0)]
    df = spark.createDataFrame(rows, "i int, t long, c long, h long, m long, l long")
    args = [F.col(x) for x in "chml"]
    out = df.select("i", compliance_score(F.col("t"), *args).alias("s"), grade_points(*args).alias("g"),
                    grade_label(grade_points(*args)).alias("l"),
                    security_score(F.col("c"), F.col("h")).alias("x")).orderBy("i").collect()
    assert [r["s"] for r in out] == ["100.0%", "98.2%", "0.0%"]
    assert [(r["g"], r["l"]) for r in out] == [(61, "C"), (61, "C"), (0, "F")]
    assert [r["x"] for r in out] == [87, 87, 0]
