from pyspark.sql import functions as F

from codelode.functions import text as T


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_lines_follow_the_line_iterator(spark):
    for text, want in (("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\n\n", ["a", "b", ""]), ("\n", [""]), ("a\rb", ["a\rb"])):
        assert one(spark, T.lines(F.lit(text))) == want


def test_globs(spark):
    cases = [
        ("**/*.spec.ts", "a/b.spec.ts", True), ("**/*.spec.ts", "b.spec.ts", True), ("src/*", "src/a/b", False), ("src/**", "src/a/b", True), ("node_modules", "x/node_modules/y.js", True),
        ("*.{ts,js}", "a.js", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("[ab].py", "b.py", True), ("[!ab].py", "b.py", False),
    ]
    for pattern, path, want in cases:
        assert one(spark, T.matches_any(F.lit(path), [pattern])) == want, (pattern, path)
    assert one(spark, T.matches_any(F.lit("a"), [])) is False


def test_hash_wraps_like_java(spark):
    assert one(spark, T.java_hash(F.lit("abc"))) == 96354
    assert one(spark, T.java_hash(F.lit("polygenelubricants"))) == -(1 << 31)
    assert one(spark, T.java_hash(F.lit(""))) == 0


def test_severities_and_durations(spark):
    for score, want in ((9.0, "blocker"), (7.0, "critical"), (4.0, "major"), (0.1, "minor"), (0.0, "info"), (float("nan"), "info"), (None, "info")):
        assert one(spark, T.cvss_severity(F.lit(score).cast("double"))) == want
    for ms, want in ((42, "42ms"), (1500, "1.5s"), (123_000, "2m 3s")):
        assert one(spark, T.humanize_ms(F.lit(ms))) == want
    assert one(spark, T.percent(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, T.normalize_path(F.lit("C:\\Work\\a\\b.ts"), "c:/work")) == "a/b.ts"
