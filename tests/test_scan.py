"""Rule matching, suppression, routes and whole scans on small texts, against plain Python."""

import pytest
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.functions.scoring import ai_likelihood, context_risk, exploitability
from riskloom.operators import matching as mt
from riskloom.operators import remediation as rm
from riskloom.operators.findings import parse_location, profile_settings
from riskloom.operators.routes import unguarded_routes
from riskloom.plans.scan import ScanOptions, scan, scan_many
from riskloom.sources.corpus import language_of, read_corpus, relative_path
from riskloom.sources.rules import load_rules, rules_from_rows, template


def corpus(spark, files):
    rows = [(p, p, lang, text) for p, lang, text in files]
    return spark.createDataFrame(rows, "path string, file string, language string, content string")


def rule(id="R-1", **kw):
    return {"id": id, "title": "t", "languages": ["python"], "severity": "high", **kw}


def hits(spark, files, rules, **kw):
    out = mt.match_rules(corpus(spark, files), rules_from_rows(spark, rules), **kw)
    return sorted((r["id"], r["file"], r["line"], r["column"]) for r in out.collect())


def test_all_and_not(spark):
    r = rule(pattern_all=["token", "=="], pattern_not=["compare_digest("])
    text = "if token == provided:\nok = compare_digest(token, x) == True\n"
    assert hits(spark, [("a.py", "python", text)], [r]) == [("R-1", "a.py", 1, 4)]


def test_any_with_not(spark):
    r = rule(languages=["javascript"], pattern_any=["secret === ", "apikey === "],
             pattern_not=["timingsafeequal("])
    text = "timingSafeEqual(secret === x)\nif (apiKey === given) {}\n"
    assert hits(spark, [("a.js", "javascript", text)], [r]) == [("R-1", "a.js", 2, 5)]


def test_language_is_a_key_and_case_does_not_matter(spark):
    r = rule(languages=["Python", "python", "go"], pattern_any=["x"])
    files = [("a.py", "PYTHON", "x"), ("b.rb", "ruby", "x"), ("c.go", "go", "yx")]
    assert hits(spark, files, [r]) == [("R-1", "a.py", 1, 1), ("R-1", "c.go", 1, 2)]


def test_negative_patterns_look_at_the_whole_file(spark):
    r = rule(pattern_any=["verify=false"], negative_patterns=["safe_mode"])
    files = [("a.py", "python", "verify=False\n# SAFE_MODE"), ("b.py", "python", "verify=False")]
    assert hits(spark, files, [r]) == [("R-1", "b.py", 1, 1)]


def test_byte_columns_and_crlf(spark):
    r = rule(pattern_any=["token"])
    assert hits(spark, [("a.py", "python", "éa token\r\ntoken\r\n")], [r]) == [
        ("R-1", "a.py", 1, 5), ("R-1", "a.py", 2, 1)]


SUPPRESSED = """eval(a)  # riskloom:ignore
plain
eval(b)
# riskloom:ignore R-1
eval(c)
# riskloom:ignore other-rule
eval(d)
# riskloom:ignore: r-1, r-9
eval(e)
// riskloom:ignore */
eval(f)"""


def test_line_suppression(spark):
    got = hits(spark, [("a.py", "python", SUPPRESSED)], [rule(pattern_any=["eval("])])
    assert [h[2] for h in got] == [3, 7, 11]


def test_marker_covers_the_next_line_only(spark):
    text = "# riskloom:ignore\neval(a)\neval(b)"
    got = hits(spark, [("a.py", "python", text)], [rule(pattern_any=["eval("])])
    assert [h[2] for h in got] == [3]


def test_file_suppression(spark):
    rules = [rule("R-1", pattern_any=["eval("]), rule("R-2", pattern_any=["eval("])]
    files = [("all.py", "python", "# riskloom:ignore-file\neval(a)"),
             ("one.py", "python", "eval(a)\n# riskloom:ignore-file: R-1")]
    assert [h[:2] for h in hits(spark, files, rules)] == [("R-2", "one.py")]


def test_rule_slices_give_the_same_hits(spark):
    rules = [rule(f"R-{i}", pattern_any=[w]) for i, w in enumerate(["eval(", "exec(", "a", "b"])]
    files = [("a.py", "python", "eval(a)\nexec(b)")]
    whole = hits(spark, files, rules)
    assert whole and hits(spark, files, rules, limit=200) == whole
    assert len(mt.rule_slices(rules_from_rows(spark, rules), 200)) > 1


def plain_python_scan(files, rules):
    out = []
    for path, lang, text in files:
        lines = [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]
        for r in rules:
            if lang not in r["languages"]:
                continue
            for n, line in enumerate(lines, 1):
                low = line.lower()
                any_, all_ = r.get("pattern_any", []), r.get("pattern_all", [])
                if any(x in low for x in r.get("pattern_not", [])):
                    continue
                if not all(x in low for x in all_) or (any_ and not any(x in low for x in any_)):
                    continue
                if any(x in text.lower() for x in r.get("negative_patterns", [])):
                    continue
                col = min(len(low[:low.index(x)].encode()) for x in any_ + all_ if x in low) + 1
                out.append((r["id"], path, n, col))
    return sorted(out)


def test_against_plain_python(spark):
    words = ["eval(", "token", "==", "éa", "md5(", "x = 1", "# todo", ""]
    files = [(f"f{i}.py", "python" if i % 3 else "go", "\n".join(
        f"{words[(i * j) % 8]} {words[(i + j) % 8]}" for j in range(12))) for i in range(30)]
    rules = [rule("A", pattern_any=["eval(", "md5("]), rule("B", pattern_all=["token", "=="]),
             rule("C", pattern_any=["x"], pattern_not=["todo"], languages=["go", "python"]),
             rule("D", pattern_any=["éa"], negative_patterns=["md5("])]
    want = plain_python_scan(files, rules)
    assert want and hits(spark, files, rules) == want


def test_match_plan_does_not_shuffle_the_corpus(spark, capsys):
    rules = rules_from_rows(spark, [rule(pattern_any=["x"])])
    mt.scored_findings(corpus(spark, [("a.py", "python", "x")]), rules).explain("formatted")
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def scores(spark, prior, path, snippet, severity="high", category="auth", tags=("auth",)):
    df = spark.createDataFrame([(path.lower(), snippet.lower())], "p string, s string")
    p, s, c = F.col("p"), F.col("s"), F.lit(category)
    r = df.select(ai_likelihood(F.lit(prior).cast("float"), p, s).alias("a"),
                  context_risk(p, c, s).alias("c"),
                  exploitability(F.lit("X-1"), F.array(*map(F.lit, tags)), c, p, s).alias("e")).first()
    return tuple(round(x, 1) for x in r)


def test_scores(spark):
    # 70 (prior) and nothing else; 50 + 8 (category); 80 (auth)
    assert scores(spark, 0.7, "src/x.py", "if left == right_value: go") == (70.0, 58.0, 80.0)
    # test path: -14 and -18 and -10; short snippet -2
    assert scores(spark, 0.7, "tests/x.py", "a == b") == (54.0, 40.0, 70.0)
    # two long identifiers -4, shortcut +7; sensitive snippet +10; high sink +12
    got = scores(spark, 0.9, "svc/login.py", "eval(some_long_name, other_long_name, secret)")
    assert got == (93.0, 98.0, 92.0)


def test_routes(spark):
    open_js = 'const app = express()\napp.get("/admin/users", show)'
    guarded = 'app.use(requireAuth)\napp.get("/admin/users", show)'
    late = 'app.get("/admin/users", show)\napp.use(requireAuth)'
    inline = 'app.get("/admin/users", requireAuth, show)'
    single = "app.get('/admin/users', show)"
    empty_first = "router.get(\"\", '/admin/x', show)"
    py_far = '@app.route("/user")\n' + "x\n" * 3 + "@login_required"
    py_near = '@app.route("/user")\nx\nx\n@login_required'
    java = '@PreAuthorize("a")\n\n\n\n@GetMapping("/profile")'
    java_far = '@PreAuthorize("a")\n\n\n\n\n@GetMapping("/profile")'
    texts = {"open.js": open_js, "guarded.js": guarded, "late.js": late, "inline.js": inline,
             "single.js": single, "empty.js": empty_first, "far.py": py_far, "near.py": py_near,
             "near.java": java, "far.java": java_far}
    lang = {"js": "javascript", "py": "python", "java": "java"}
    files = [(n, lang[n.split(".")[1]], t) for n, t in texts.items()]
    got = unguarded_routes(corpus(spark, files), "ACME-").collect()
    assert sorted((r["file"], r["line"], r["id"]) for r in got) == [
        ("empty.js", 1, "ACME-JS-AUTH-XF-001"), ("far.java", 6, "ACME-JAVA-AUTH-XF-001"),
        ("far.py", 1, "ACME-PY-AUTH-XF-001"), ("late.js", 1, "ACME-JS-AUTH-XF-001"),
        ("open.js", 2, "ACME-JS-AUTH-XF-001")]


def test_scan_options(spark):
    rules = rules_from_rows(spark, [
        rule("A", pattern_any=["eval("], category="injection", confidence=0.9),
        rule("B", pattern_any=["md5("], category="crypto", severity="low", confidence=0.4,
             tags=["weak"])])
    files = corpus(spark, [("src/a.py", "python", "eval(1)\nmd5(2)"),
                           ("vendor/b.py", "python", "eval(1)")])
    ids = lambda **kw: sorted((r["id"], r["file"]) for r in scan(
        files, rules, ScanOptions(**kw)).collect())
    assert ids() == [("A", "src/a.py"), ("A", "vendor/b.py"), ("B", "src/a.py")]
    assert ids(exclude=["VENDOR/"]) == [("A", "src/a.py"), ("B", "src/a.py")]
    assert ids(categories=["Weak"]) == [("B", "src/a.py")]
    assert ids(ai_only=True) == [("A", "src/a.py"), ("A", "vendor/b.py")]
    assert ids(severity="high", exclude=["vendor"]) == [("A", "src/a.py")]
    assert ids(profile="pragmatic", exclude=["vendor"]) == [("A", "src/a.py")]
    assert profile_settings("ai_focus") == (None, 0.75, True)
    out = scan_many([files, files], rules).collect()
    assert len(out) == 6 and [r["risk_score"] for r in out] == sorted(
        [r["risk_score"] for r in out], reverse=True)
    assert scan(files, rules).columns == schemas.FINDING.fieldNames()


def test_filters_come_before_the_dedup(spark):
    rules = rules_from_rows(spark, [
        rule("A-MEDIUM", pattern_any=["token =="], category="auth", severity="medium", confidence=0.99),
        rule("B-HIGH", pattern_any=["token =="], category="auth", severity="high", confidence=0.5)])
    files = corpus(spark, [("a.py", "python", "if token == x:")])
    ids = lambda **kw: [r["id"] for r in scan(files, rules, ScanOptions(**kw)).collect()]
    assert ids(dedup="normalized") == ["A-MEDIUM"]  # the riskier of the two
    assert ids(dedup="normalized", severity="high") == ["B-HIGH"]
    # findings of other tools are dedupped with ours, whatever is asked for the output
    known = scan(files, rules, ScanOptions(severity="high"))
    both = scan(files, rules, external=known)
    assert both.count() == 1
    # a baseline that drops the loud finding leaves the quiet one of another category
    assert scan(files, rules, ScanOptions(dedup="normalized"), baseline=known).count() == 0


def test_route_findings_share_the_key_of_rules(spark):
    rules = rules_from_rows(spark, [rule("JS-AUTH-XF-001", pattern_any=["admin"], languages=["javascript"])])
    files = corpus(spark, [("a.js", "javascript", "app.get('/admin/users', show)")])
    rows = scan(files, rules, ScanOptions(cross_file=True)).collect()
    assert [r["title"] for r in rows] == [rules.first()["title"]]


def test_repeated_rule_ids_give_one_finding_per_line(spark):
    rules = rules_from_rows(spark, [rule("A", pattern_any=["eval("]), rule("A", pattern_any=["eval"])])
    assert scan(corpus(spark, [("a.py", "python", "eval(1)")]), rules).count() == 1


def test_locations():
    assert parse_location("a.py") == ("a.py", None, None)
    assert parse_location("a.py:3") == ("a.py", 3, None)
    assert parse_location("c:/a.py:3:7") == ("c:/a.py", 3, 7)
    for bad in ("", ":3", "a.py:0", "a.py:0:1"):
        with pytest.raises(ValueError):
            parse_location(bad)


RULE_FILE = '''# a rule
id: WEAK-1
title: "Weak digest"
severity: High
confidence_that_ai_generated: 0.85
languages: [Python, "go"]
category: crypto
cwe: cwe-327
tags: [hash, 'weak']
pattern:
  any:
    - "MD5("
    - 'sha1('
  all: [digest, value]
  not:
    - safe
negative_patterns:
  - "USEDFORSECURITY"
fix:
  suggestion: Use sha256
unknown: 1
'''


def test_rule_files(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "weak.yaml").write_text(RULE_FILE)
    (tmp_path / "_other.yml").write_text(
        'id: O\ntitle: T\nlanguages: [go]\npattern:\n  contains: ["A, b", c]\n')
    (tmp_path / "notes.txt").write_text("id: no")
    got = {r["id"]: r.asDict() for r in load_rules(spark, str(tmp_path)).collect()}
    assert set(got) == {"WEAK-1", "O"}
    weak = got["WEAK-1"]
    assert weak["severity"] == "high" and round(weak["confidence"], 2) == 0.85
    assert weak["languages"] == ["python", "go"] and weak["tags"] == ["hash", "weak"]
    assert weak["pattern_any"] == ["md5(", "sha1("] and weak["pattern_all"] == ["digest", "value"]
    assert weak["pattern_not"] == ["safe"] and weak["negative_patterns"] == ["usedforsecurity"]
    assert weak["cwe_id"] == "CWE-327" and weak["owasp_category"] is None
    assert weak["fix_suggestion"] == "Use sha256"
    assert got["O"]["severity"] == "medium" and round(got["O"]["confidence"], 2) == 0.7
    assert got["O"]["pattern_any"] == ['"a', 'b"', "c"]


def test_bad_rule_files(spark, tmp_path):
    (tmp_path / "bad.yaml").write_text("id: X\nlanguages: [go]\nseverity: huge\n")
    with pytest.raises(ValueError, match="missing title"):
        load_rules(spark, str(tmp_path))
    assert load_rules(spark, str(tmp_path), strict=False).count() == 0
    assert template("T", severity="LOW", confidence=0.2)["severity"] == "low"
    with pytest.raises(ValueError):
        template("T", confidence=2)


def test_read_corpus(spark, tmp_path):
    texts = {"src/__init__.py": "x = 1", ".github/workflows/ci.yml": "on: push",
             "node_modules/m/a.js": "skip", "web/dist/a.js": "skip", "app/main.ts": "let a",
             "k8s/pod.yaml": "kind: Pod", "conf/plain.yaml": "a: 1", "readme.txt": "no",
             "Dockerfile": "FROM x", "a/b/c/d/e/f/deep.rs": "fn main"}
    for name, text in texts.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "broken.py").write_bytes(b"\xff\xfe\x00")
    got = {r["file"]: (r["language"], r["content"]) for r in read_corpus(spark, str(tmp_path)).collect()}
    assert got == {
        "src/__init__.py": ("python", "x = 1"), ".github/workflows/ci.yml": ("github-actions", "on: push"),
        "app/main.ts": ("javascript", "let a"), "k8s/pod.yaml": ("kubernetes", "kind: Pod"),
        "Dockerfile": ("dockerfile", "FROM x"), "a/b/c/d/e/f/deep.rs": ("rust", "fn main")}
    one = read_corpus(spark, str(tmp_path / "app" / "main.ts")).first()
    assert one["file"] == "main.ts"


def test_languages(spark):
    df = spark.createDataFrame([("x/App.CS",), (".py",), ("a.tar.gz",), ("dockerfile.dev",)], "p string")
    assert [r[0] for r in df.select(language_of(F.col("p"))).collect()] == [
        "csharp", None, None, "dockerfile"]
    assert df.limit(1).select(relative_path(F.col("p"), "x/")).first()[0] == "App.CS"


def test_fixes_fold_in_rule_order(spark):
    files = corpus(spark, [("a.py", "python", "eval(x); eval(y)\nverify=False\n"),
                           ("b.py", "python", "nothing")])
    found = spark.createDataFrame([("PY-INJ-004", "a.py"), ("PY-CRYPTO-006", "a.py"),
                                   ("PY-INJ-004", "b.py"), ("UNKNOWN", "b.py")], "id string, file string")
    out = rm.apply_fixes(files, found).collect()
    assert [(r["file"], r["fixed"], r["replacements"]) for r in out] == [
        ("a.py", "ast.literal_eval(x); ast.literal_eval(y)\nverify=True\n", 3)]
    totals = rm.fix_totals(rm.apply_fixes(files, found)).first()
    assert (totals["files"], totals["replacements"]) == (1, 3)
    prefixed = found.withColumn("id", F.concat(F.lit("ACME-"), "id"))
    assert rm.apply_fixes(files, prefixed, "ACME-").count() == 1


def test_fix_order_is_cumulative(spark):
    # the second rule sees the text the first one left
    fixes = {"A": [("one", "two")], "B": [("two", "three")]}
    files = corpus(spark, [("a", "python", "one two")])
    found = spark.createDataFrame([("A", "a"), ("B", "a")], "id string, file string")
    r = rm.apply_fixes(files, found, fixes=fixes).first()
    assert (r["fixed"], r["replacements"]) == ("three three", 3)


def test_context_and_prompt(spark):
    files = corpus(spark, [("a.py", "python", "\n".join(f"l{i}" for i in range(1, 8)))])
    found = spark.createDataFrame([("R", "T", "high", "a.py", 1, None), ("R", "T", "high", "a.py", 7, "Do")],
                                  "id string, title string, severity string, file string, line int, "
                                  "fix_suggestion string")
    got = {r["line"]: r for r in rm.fix_prompts(rm.code_context(found, files, 2)).collect()}
    assert (got[1]["context"], got[1]["context_start"]) == ("l1\nl2\nl3", 1)
    assert (got[7]["context"], got[7]["context_start"]) == ("l5\nl6\nl7", 5)
    assert "line 7 of a.py" in got[7]["prompt"] and "Advice: Do\n" in got[7]["prompt"]
    assert "safest common practice" in got[1]["prompt"]


def test_a_file_meets_its_rules_in_one_row(spark):
    rules = [rule(f"R-{i}", pattern_any=["eval(", "a"]) for i in range(9)]
    files = corpus(spark, [("a.py", "python", "eval(a)\nexec(b)")])
    met = mt.candidates(files, rules_from_rows(spark, rules))
    assert met.count() == 1 and len(met.first()["_rules"]) == 9
    found = mt.match_rules(files, rules_from_rows(spark, rules))
    assert found.count() == 9
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    splits = [line for line in plan.splitlines() if "Generate" in line and "split(" in line]
    assert len(splits) == 2 and plan.count("Join") == 1  # lower-cased lines, and those of files with hits


def test_equal_rule_ids_hit_a_line_once(spark):
    rules = [rule("R-1", pattern_any=["b"]), rule("R-1", pattern_any=["a"]), rule("R-2", pattern_any=["a"])]
    files = corpus(spark, [("a.py", "python", "x b a\n b")])
    got = sorted((r.id, r.line, r.column) for r in mt.match_rules(
        files, rules_from_rows(spark, rules), unique=True).collect())
    assert got == [("R-1", 1, 3), ("R-1", 2, 2), ("R-2", 1, 5)]


def test_fixes_and_contexts_where_the_text_lies(spark):
    source = "import hashlib\nx = hashlib.md5(a)\ny = 1\nz = hashlib.md5(b)\n"
    files = corpus(spark, [("a.py", "python", source), ("b.py", "python", "x = 1\n")])
    rules = rules_from_rows(spark, [rule("PY-CRYPTO-001", pattern_any=["hashlib.md5("])])
    found = mt.match_rules(files, rules)
    assert [tuple(r) for r in rm.fix_files(files, rules).collect()] == [
        tuple(r) for r in rm.apply_fixes(files, found).collect()] != []
    assert sorted(map(tuple, rm.preview_files(files, rules).collect())) == sorted(
        map(tuple, rm.preview_fixes(files, found).collect())) != []
    near = rm.hits_in_context(files, rules, 1)
    want = rm.code_context(found, files, 1).select(*near.columns)
    assert sorted(map(str, near.collect())) == sorted(map(str, want.collect()))
    for df in (rm.fix_files(files, rules), rm.preview_files(files, rules), near):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "Exchange" in line and "content" in line]


def test_bucketed_texts_do_not_move(spark, tmp_path):
    from riskloom.sinks.tables import write_bucketed

    files = corpus(spark, [(f"f{i}.py", "python", f"a = hashlib.md5({i})\n") for i in range(20)])
    rules = rules_from_rows(spark, [rule("PY-CRYPTO-001", pattern_any=["hashlib.md5("])])
    write_bucketed(files, "texts_by_file", 4, path=str(tmp_path / "texts"))
    write_bucketed(mt.match_rules(files, rules).drop("content"), "hits_by_file", 4,
                   path=str(tmp_path / "hits"))
    texts, hits = spark.table("texts_by_file"), spark.table("hits_by_file")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fixed = rm.apply_fixes(texts, hits, co_located=True)
        seen = rm.code_context(hits, texts, co_located=True)
        for df in (fixed, rm.preview_fixes(texts, hits, co_located=True)):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        plan = seen._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "Exchange" in line and "content" in line]
        assert fixed.count() == 20 and seen.count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql("DROP TABLE texts_by_file")
        spark.sql("DROP TABLE hits_by_file")
