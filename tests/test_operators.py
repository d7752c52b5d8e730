"""Operators on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from codelode.operators import complexity, coverage, dependencies, diffs, duplication, metrics, quality, rules, snapshots, sourcefiles, structure, tokenize, treerules

FILES = "file_id long, path string, text string, repo string, loc int, code_lines int, comment_lines int, blank_lines int, class_count int"


def files(spark, texts):
    return spark.createDataFrame([(i, p, t, "r", None, None, None, None, None) for i, (p, t) in enumerate(texts)], FILES)


def test_line_metrics_carry_block_comments(spark, collect):
    text = "/* a\n b\n*/ x\n\n# h\ny // z\n/* c */ d\n/* e */ // f\n'//*' x\nlast"
    (row,) = collect(sourcefiles.metrics_by_file(files(spark, [("a.ts", text)])))
    assert row == (0, "typescript", 10, 3, 6, 1)
    assert collect(sourcefiles.metrics_by_file(files(spark, [("a", ""), ("b.x", None)]))) == [(0, None, 0, 0, 0, 0)]


def test_markers_depend_on_the_language(spark):
    lines = [("rust", "# NOSONAR", False), ("rust", "x // nosonar", True), ("python", "x # NOSONAR", True), ("python", "// NOSONAR", False), ("html", "<!-- NOSONAR -->", True), ("json", "// NOSONAR", False), (None, "# NOSONAR", True), ("php", "/* NOSONAR", True), ("sql", "-- NOSONAR", True)]
    df = spark.createDataFrame(lines, "language string, text string, want boolean")
    assert df.where(sourcefiles.nosonar(F.col("text"), F.col("language")) != F.col("want")).count() == 0


def test_discovery_predicates(spark, collect):
    df = files(spark, [("src/a.ts", "x"), ("src/a.spec.ts", "x"), ("src/b.bin", "x"), (".git/c.ts", "x"), ("lib/d.go", "y" * 50), ("tests/e.py", "x")])
    assert [r[1] for r in collect(sourcefiles.discover(df, exclude=["tests/**"], max_bytes=40, tests=False))] == ["src/a.ts"]
    assert len(collect(sourcefiles.discover(df))) == 5 - 0 - 1 + 0


RULE_CASES = [
    ("python/avoid-print", "a.py", "print(x)", True), ("python/avoid-print", "tests_x/a_test.py", "print(x)", False), ("python/avoid-bare-except", "a.py", "except:", True), ("python/avoid-bare-except", "a.py", "except E:", False),
    ("python/avoid-mutable-default", "a.py", "def f(a=[]):", True), ("python/avoid-star-import", "a.py", "from a import *", True), ("python/explicit-return-type", "a.py", "def f(a):", True), ("python/explicit-return-type", "a.py", "def f(a) -> int:", False),
    ("rust/avoid-unwrap", "a.rs", "x.unwrap();", True), ("rust/avoid-unwrap", "a.rs", "// x.unwrap();", False), ("rust/avoid-todo", "a.rs", "todo!()", True), ("go/avoid-init", "a.go", "func init() {", True), ("go/avoid-empty-block", "a.go", "if x {}", True),
    ("dart/avoid-print", "a.dart", "print('x');", True), ("dart/avoid-empty-catch", "a.dart", "} catch (e) {}", True), ("no-eval", "a.ts", "eval(x)", True), ("no-eval", "a.ts", "'eval(x)'", False), ("no-eval", "a.ts", "a.eval(x)", False),
    ("no-eqeqeq", "a.ts", "if (a == b)", True), ("no-eqeqeq", "a.ts", "if (a === b)", False), ("no-var", "a.js", "var x = 1", True), ("no-console", "a.ts", "console.log(1)", True), ("no-console", "a.spec.ts", "console.log(1)", False),
    ("no-new-func", "a.js", "new Function('x')", True), ("no-explicit-any", "a.ts", "let x: any", True), ("no-unneeded-ternary", "a.ts", "a ? true : false", True), ("no-script-url", "a.ts", "x = 'javascript:void(0)'", True),
    ("no-empty-interface", "a.ts", "interface A {}", True), ("prefer-spread", "a.ts", "[].concat(a)", True), ("no-throw-literal", "a.ts", "throw 'x'", True), ("no-throw-literal", "a.ts", "throw new Error('x')", False),
    ("no-useless-concat", "a.ts", "'a' + 'b'", True), ("no-bitwise", "a.ts", "a & b", True), ("no-bitwise", "a.ts", "a && b", False), ("no-warning-comments", "a.ts", "// TODO fix", True), ("no-warning-comments", "a.ts", "// TODO(me): fix", False),
    ("no-octal", "a.js", "x = 017", True), ("no-compare-neg-zero", "a.ts", "x === -0", True), ("no-constant-condition", "a.ts", "while (true) {", True), ("no-magic-numbers", "a.ts", "f(x, 42)", True), ("no-magic-numbers", "a.ts", "const x = 42", False),
    ("no-nested-ternary", "a.ts", "a ? b ? 1 : 2 : 3", True), ("camelcase", "a.ts", "let my_name = 1", True), ("camelcase", "a.ts", "const MY_NAME = 1", False), ("no-prototype-builtins", "a.ts", "a.hasOwnProperty(b)", True), ("no-async-promise-executor", "a.ts", "new Promise(async (r) => {", True),
]


def test_rules_on_snippets(spark):
    df = files(spark, [(p, t) for _, p, t, _ in RULE_CASES])
    found = {(r["file_id"], r["rule_id"]) for r in quality.all_issues(df).collect()}
    wrong = [c for i, c in enumerate(RULE_CASES) if ((i, c[0]) in found) != c[3]]
    assert not wrong
    assert len({r.id for r in rules.RULES}) == len(rules.RULES) and not {r.id for r in rules.RULES} & set(treerules.SEVERITIES)
    assert quality.all_issues(df, disabled=("no-eval", "python/avoid-print")).where("rule_id in ('no-eval', 'python/avoid-print')").count() == 0


def test_rules_of_neighbours_and_names(spark, collect):
    go = "package a\nvar X = 1\n// doc\nfunc Y() {\n\terr := f()\n\tif err != nil {\n\t}\n\terr := g()\n\tx()\n\ty()\n\tz()\n}\nfunc Z() {}\n"
    ts = "import { a } from 'm';\nimport { b as b } from 'm';\nlet q = 1;\nlet w = 2;\nw = 3;\na = 4;\nconst q = 5;\nlet q = 6;\ninterface I {}\nnew I();\nif (s.t === s.t && u && u.v) {}\n"
    py = 'def f():\n\n    """doc"""\nclass A:\n    x = 1\ndef _g():\n    pass\n'
    df = files(spark, [("a.go", go), ("b.ts", ts), ("c.py", py)])
    found = quality.all_issues(df).collect()
    line = lambda rule: sorted(r["line"] for r in found if r["rule_id"] == rule)
    assert line("go/error-check") == [8] and line("go/avoid-global-var") == [2] and line("go/exported-comment") == [2, 13]
    assert line("python/docstring-required") == [4] and line("no-duplicate-imports") == [2] and line("no-redeclare") == [7, 8]
    assert line("prefer-const") == [3, 8] and line("no-import-assign") == [6]
    assert line("no-misused-new") == [10] and line("no-self-compare") == [11] and line("no-useless-rename") == [2] and line("prefer-optional-chain") == [11]


def test_globals_and_return_types(spark):
    py = "import a\nx = 1\nA=1\nA = 1\n__all__ = 1\nif x == 1:\n    y = 2\ndef f(a=1):\n    b = 1\nz: int = 3\n@d(a= 1)\n"
    rs = "pub fn a() {\n}\n\n\npub fn b(\n  x: u8,\n) -> u8 {\n}\nfn c() {\n}\npub async fn d() {\n}\npub fn e();\n"
    df = files(spark, [("a.py", py), ("b.rs", rs)])
    found = rules.issues(df).collect()
    assert sorted(r["line"] for r in found if r["rule_id"] == "python/avoid-global-var") == [2, 4, 5, 10]
    assert sorted(r["line"] for r in found if r["rule_id"] == "rust/explicit-return-type") == [1, 11]


def test_all_issues_reach_the_roll_ups(spark, collect, tmp_path):
    from codelode.plans import catalog

    sink = "function f(req) {\n  db.query(req.body);\n}\n"
    ts = "import { a } from 'm';\nimport { b as b } from 'm';\na = 4;\ninterface I {}\nnew I();\nlet q = (s.t === s.t && u && u.v);\nconst q = 1;\n"
    df = files(spark, [("a.ts", sink), ("b.ts", ts), ("c.go", "package a\nvar X = 1\nfunc y() {\n\terr := f()\n}\n"), ("d.py", "def f():\n    return 1\n"), ("e.py", "x = 1\n"), ("f.rs", "pub fn a() {\n}\n")])
    functions = spark.createDataFrame(
        [(1, 0, "a.ts", 1, 90, 16, 6), (1, 0, "a.ts", 1, 90, 16, 6), (2, 0, "a.ts", 1, 2, 16, 0)],
        "function_id long, file_id long, path string, start_line int, end_line int, complexity int, parameter_count int",
    )
    found = collect(quality.all_issues(df, functions).select("file_id", "rule_id", "severity", "line"))
    assert {"no-duplicate-imports", "no-import-assign", "no-misused-new", "no-self-compare", "no-useless-rename", "prefer-optional-chain", "python/docstring-required", "rust/explicit-return-type"} <= {r[1] for r in found}
    assert {(0, "security/sql-injection", "blocker", 2), (1, "no-import-assign", "major", 3), (2, "go/error-check", "critical", 4)} <= set(found)
    assert [r[1] for r in found if r[1].startswith("max-")].count("max-function-complexity") == 2 and len(found) == len([*set(found)]) + 1
    df.write.parquet(f"{tmp_path}/files.parquet")
    functions.write.parquet(f"{tmp_path}/functions.parquet")
    counts = {r["severity"]: r["issues"] for r in catalog.queries()["severity_counts"](spark, str(tmp_path)).collect()}
    assert counts["blocker"] == 1 and sum(counts.values()) == len(found)
    assert {"all_issues", "rule_snippets", "line_rule_issues"} <= set(catalog.queries())


def test_snippets_have_their_issues(spark, collect):
    from codelode.plans.snippets import SNIPPETS

    df = spark.createDataFrame([(i, p, t, x) for i, (p, t, _) in enumerate(SNIPPETS) for x in "ab"] + [(900, "x.ts", None, "a"), (901, None, "a == b", "a"), (None, "x.ts", "a == b", "a"), (902, "x.ts", "", "a")], "file_id long, path string, text string, line string")
    found = {(r["file_id"], r["line"], r["rule_id"]) for r in quality.all_issues(df).collect()}
    assert found == {(i, line, rule) for i, (_, _, some) in enumerate(SNIPPETS) for line, rule in some}
    known = {r.id for r in rules.RULES} | set(treerules.SEVERITIES)
    assert {rule for _, _, rule in found} == known
    assert collect(quality.all_issues(df.where("false"))) == []


def test_structure_of_texts():
    ts = "class A extends B {\n  constructor(private x: number, y?: string) { super(); }\n  async m(a: T): Promise<void> { if (a && b) { for (const q of w) { x = y ? 1 : 2; } } else { return; } }\n}\nconst h = (a, b) => a + b;\nlist.map((x) => x);\ninterface I { m(x: number): void }\ntype T = { a: (x: number) => void };\nenum E { A }\n"
    shape = structure.shape_of(ts, "typescript")
    assert [(f[0], f[1], f[3], f[4], f[5]) for f in shape.functions] == [("constructor", 2, 1, 0, 2), ("m", 3, 5, 7, 1), ("h", 5, 1, 0, 2)]
    assert (shape.classes, shape.interfaces, shape.aliases, shape.enums, shape.complexity) == (1, 1, 1, 1, 7)
    go = structure.shape_of("package a\nfunc (t *T) F(x, y int) (int, error) { if a && b { return } ; g(func(q int) { for {} }) }\ntype S struct { A int }\n", "go")
    assert [(f[0], f[3], f[5]) for f in go.functions] == [("F", 4, 2), ("<anonymous>", 2, 1)] and go.classes == 1
    rust = structure.shape_of("pub fn f<'a>(&self, x: Vec<u8>) -> Result<(), E> { let c = |a: u32, b| a + b; match x { _ => if y {} } }\nstruct S;\ntrait T {}\n", "rust")
    assert [(f[0], f[3], f[5]) for f in rust.functions] == [("f", 2, 1), ("<closure>", 1, 2)] and (rust.classes, rust.interfaces) == (1, 1)
    dart = structure.shape_of("class A {\n Future<void> f(int a, [String b]) async { if (a) { } }\n int g(x) => x + 1;\n}\nvoid main() { l.map((e) { return e; }); }\n", "dart")
    assert [(f[0], f[5]) for f in dart.functions] == [("f", 2), ("g", 1), ("main", 0), ("<anonymous>", 1)]
    py = structure.shape_of("class A:\n    def f(self, a, *b, c=1, **d):\n        return [x for x in a if x and y]\ng = lambda x: x or 1\n", "python")
    assert [(f[0], f[3], f[5]) for f in py.functions] == [("f", 4, 4), ("<lambda>", 2, 1)] and py.classes == 1
    assert structure.shape_of("def f(:", "python") is None and structure.shape_of("x", "yaml") is None and structure.shape_of("", "typescript").functions == []
    assert structure.shape_of("}){]((" * 50, "typescript").complexity == 1


def test_custom_rules(spark, collect):
    table = spark.createDataFrame([("r", "odd", [], r"a+", "got $0"), ("r", "info", [], "z", None), ("p", "info", ["python"], r"x", None), ("l", "info", [], "(?=a)", None)], "id string, severity string, languages array<string>, pattern string, message string")
    df = files(spark, [("a.ts", "b aa a\n// aa\n"), ("b.py", "x\n")])
    assert collect(rules.custom_issues(df, table)) == [(0, 1, "r", "major", "got a", 6), (0, 1, "r", "major", "got aa", 3), (1, 1, "p", "info", "Matched pattern: x", 1)]


def test_ratings_and_gate(spark, collect):
    df = spark.range(20).select(F.col("id").alias("file_id"))
    issues = spark.createDataFrame([(0, "blocker")] + [(i, "major") for i in range(1, 20)], "file_id long, severity string")
    assert {r["kind"]: r["rating"] for r in quality.ratings(issues, df).collect()} == {"reliability": "B", "security": "B", "maintainability": "E"}
    assert {r["rating"] for r in quality.ratings(issues.where("false"), df.where("false")).collect()} == {"A"}
    values = spark.createDataFrame([("a", 3.0), ("b", 79.9), ("c", None), ("d", 1.0)], "check string, value double")
    got = {r["check"]: r["passed"] for r in quality.gate(values, {"a": ("max", 3), "b": ("min", 80), "c": ("max", 1)}).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": True}


def test_winnowing_of_small_streams(spark, collect):
    hashes = lambda hs: spark.createDataFrame([(1, i, h) for i, h in enumerate(hs)], "file_id long, pos long, hash string")
    assert [r[1] for r in collect(duplication.winnow(hashes("bab"), 4))] == [1]
    assert [r[1] for r in collect(duplication.winnow(hashes("bcaacb"), 3))] == [2, 3, 5]  # rightmost of equals in a window, then the tail
    assert collect(duplication.winnow(hashes(""), 4)) == []


def test_token_duplication_totals(spark):
    rows = [(f, u, 1, f"t{u}") for f in (1, 2) for u in range(12)]
    tokens = spark.createDataFrame(rows, "file_id long, unit int, line int, text string")
    total = duplication.duplication_totals(tokens, min_tokens=10).first()
    assert total["tokens"] == 24 and total["duplicated"] == 5 and duplication.duplication_totals(tokens).first()["duplicated"] == 0
    other = spark.createDataFrame([(f, u, 1, f"t{f}{u}") for f in (1, 2) for u in range(12)], tokens.schema)
    assert duplication.duplication_totals(other, min_tokens=10).first()["duplicated"] == 0


def test_runs_of_equal_lines_collapse(spark, collect):
    lines = spark.createDataFrame([(1, i, v, i, i) for i, v in enumerate("aabbbc")], "file_id long, line int, value string, start_unit int, end_unit int")
    assert [r[1] for r in collect(duplication.collapse_runs(lines))] == [0, 1, 2, 4, 5]


def test_copied_blocks_are_found(spark, collect):
    body = [(u, u // 10 + 1, f"s{u}") for u in range(200)]
    rows = [(1, u, n, t) for u, n, t in body] + [(1, 200 + u, 21 + u // 10, f"a{u}") for u in range(40)] + [(2, u, u // 10 + 1, f"b{u}") for u in range(20)] + [(2, 20 + u, n + 2, t) for u, n, t in body]
    tokens = spark.createDataFrame(rows, "file_id long, unit int, line int, text string")
    assert collect(duplication.duplicated_runs(tokens)) == [(1, 1, 20, 200), (2, 3, 22, 200)]
    assert {r[0]: r[2] for r in collect(duplication.duplication_density(tokens))} == {1: 20, 2: 20}


def test_coverage_merges_by_sum(spark, collect):
    rows = [("a", n, 1 if n <= 5 else 0, "ut") for n in range(1, 11)] + [("a", n, 1 if n <= 7 else 0, "it") for n in range(1, 11)] + [("b", 1, None, "ut"), (None, 1, 1, "ut")]
    df = spark.createDataFrame(rows, "path string, line int, hits long, category string")
    by = {r["path"]: r for r in coverage.by_file(df).collect()}
    assert (by["a"]["total"], by["a"]["covered"], by["a"]["uncovered"]) == (20, 12, [6, 7, 8, 9, 10]) and by["b"]["percent"] == 0.0
    assert coverage.totals(df.where("false")).first()["percent"] == 0.0 and coverage.totals(coverage.excluding(df, ["b"])).first()["files"] == 1
    new = coverage.new_code(df, spark.createDataFrame([("a", 1, "c"), ("a", 9, "c"), ("a", 2, "d")], "path string, line int, commit string"), spark.createDataFrame([("c",)], "commit string")).first()
    assert (new["total"], new["covered"]) == (2, 1)


def test_lifecycles(spark, collect):
    p = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("d", None)], "path string, hash string")
    c = spark.createDataFrame([("a", "h1"), ("b", "h3"), ("c", "h4"), ("d", None)], "path string, hash string")
    assert collect(snapshots.file_status(p, c)) == [("a", "unchanged"), ("b", "changed"), ("c", "added"), ("d", "unchanged")]
    assert collect(snapshots.file_status(c, p)) == [("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "unchanged")]
    i = lambda rows: spark.createDataFrame(rows, "path string, key string")
    assert collect(snapshots.issue_lifecycle(i([("a", "1"), ("a", "2")]), i([("a", "1"), ("a", "3"), ("b", "4")]))) == [("a", "1", "persistent"), ("a", "2", "fixed"), ("a", "3", "regressed"), ("b", "4", "new")]
    again, same = snapshots.unchanged_split(c, p)
    assert [r[0] for r in collect(same)] == ["a"] and len(collect(again)) == 3 and len(collect(snapshots.merge(c, p))) == 4


def test_packages_meet_advisories(spark, collect):
    adv = spark.createDataFrame([("NPM", "a", "1", "x-1", 9.8), ("npm", "a", "1", " X-1", float("nan")), ("npm", "b", "2", "x-2", None), ("npm", None, "2", "x-3", 1.0)], "ecosystem string, name string, version string, osv_id string, cvss double")
    packages = spark.createDataFrame([("npm", "a", "1"), ("npm", "a", "1"), ("npm", "c", "1")], "ecosystem string, name string, version string")
    assert collect(dependencies.vulnerabilities(packages, adv)) == [("npm", "a", "1", "X-1", "blocker")]
    assert collect(dependencies.severity_by_ecosystem(adv)) == [("npm", "blocker", 1), ("npm", "info", 1)]
    score = spark.createDataFrame([("CVSS:3.1/AV:N",), ("7.5",), ("none",)], "v string").select(dependencies.cvss_number(F.col("v")))
    assert [r[0] for r in score.collect()] == [3.1, 7.5, None]


def test_diffs(spark, collect):
    df = spark.createDataFrame([("a", "1\n2\n3", "1\nx\n3"), ("b", None, "n"), ("c", "\n".join(map(str, range(20))), "\n".join(map(str, [*range(19), "z"])))], "path string, old string, new string")
    got = [r.asDict() for r in diffs.diff_lines(df, 2).collect()]
    assert [(r["op"], r["line"]) for r in got if r["path"] == "a"] == [("equal", "1"), ("delete", "2"), ("insert", "x"), ("equal", "3")]
    assert [(r["op"], r["line"]) for r in got if r["path"] == "b"] == [("insert", "n")]
    assert [r["op"] for r in got if r["path"] == "c"] == ["gap", "equal", "equal", "delete", "insert"]


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("typescript", "a /* b\n*/ c 'd' `e ${f}` g => 1.5 // h\n!==", [(1, "a"), (2, "c"), (2, "g"), (2, "=>"), (2, "1.5"), (3, "!==")]), ("python", 'x = """a\nb""" # c\ny', [(1, "x"), (1, "="), (3, "y")]),
        ("rust", "/* a /* b */ c */ d 'x' r#\"e\"# &'a", [(1, "d"), (1, "&"), (1, "'a")]), ("go", "a := `x\ny` 'z'", [(1, "a"), (1, ":=")]), ("dart", "a r'\\' ?. b", [(1, "a"), (1, "?."), (1, "b")]), ("generic", "", []),
    ],
)
def test_tokens(language, text, want):
    if language == "dart":
        text = text.replace("r'\\'", "'''q\n''' ''").replace("\n", "")
    assert tokenize.tokens_of(text, language) == want


def test_taint_follows_names_to_calls(spark, collect):
    bad = "function f(req) {\n  const a = req.query.id;\n  const b = a + 'x';\n  const c = b;\n  db.query(c);\n}\n"
    good = "function f(req) {\n  const a = escape(req.query.id);\n  db.query(a);\n}\nfunction g(x) {\n  redirect(x);\n}\n"
    far = "function f(req) {\n  const a = req.body;\n}\nfunction g(a) {\n  exec(a);\n}\n"
    df = files(spark, [("a.ts", bad), ("b.ts", good), ("c.ts", far), ("d.py", bad)])
    assert [(r[0], r[2], r[3]) for r in collect(treerules.tainted_sinks(df))] == [(0, 5, "security/sql-injection")]


def test_roll_ups_take_each_record_once(spark, collect):
    schema = "file_id long, path string, repo string, loc int, code_lines int, comment_lines int, blank_lines int, class_count int, ingested_at int"
    f = spark.createDataFrame([(1, "a.ts", "r", 10, 8, 1, 1, 0, 1), (1, "a.ts", "r", 10, 8, 1, 1, 0, 2), (2, "b.ts", "r", None, None, None, None, None, 1)], schema)
    g = spark.createDataFrame([(1, "r", "a.ts", 1, 5), (1, "r", "a.ts", 1, 5), (2, "r", "a.ts", 9, None)], "function_id long, repo string, path string, start_line int, complexity int")
    (row,) = [r.asDict() for r in metrics.project_metrics(f, g).collect()]
    assert (row["files"], row["loc"], row["functions"], row["average_complexity"], row["worst_function"]) == (2, 10, 2, 5.0, 1)


def test_complexity_counts_decisions_and_depth(spark, collect):
    words = "f ( ) { if ( a && b ) { for ( ; ; ) { } } } g".split()
    tokens = spark.createDataFrame([(1, u, 1 + u // 4, w) for u, w in enumerate(words)] + [(2, 0, 1, "x")], "file_id long, unit int, line int, text string")
    assert collect(complexity.by_file(tokens)) == [(1, 4, 2 + 3, 3), (2, 1, 0, 0)]
    functions = spark.createDataFrame([(7, 1, 1, 9), (7, 1, 1, 9), (8, 1, 4, 5), (9, 3, 1, 2), (None, 1, 1, 2)], "function_id long, file_id long, start_line int, end_line int")
    assert collect(complexity.by_function(tokens, functions)) == [(7, len(words), 4), (8, 8, 1), (9, 0, 1)]
