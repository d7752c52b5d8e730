"""Rules about lines of Python, Rust, Go and Dart, limits of functions, and rules users bring.

A rule is a row of data: an id and a condition on a line and its neighbours. All of them run in one pass over the lines of a file,
each line tested against the rules of its language only; rules about structure are in :mod:`codelode.operators.treerules`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.operators.sourcefiles import language_of, line_rows
from codelode.session import spread

TS = ("typescript", "tsx")


class Line(NamedTuple):
    """A line as the conditions see it: trimmed, as it stands, the trimmed lines around it and the path."""

    raw: Column
    full: Column
    before: Column
    after: tuple[Column, Column, Column, Column]
    path: Column


class Rule(NamedTuple):
    id: str
    severity: str
    language: str
    holds: Callable[[Line], Column]


def _any(c: Column, *values: str) -> Column:
    return reduce(or_, (c.contains(v) for v in values))


def _starts(c: Column, *values: str) -> Column:
    return reduce(or_, (c.startswith(v) for v in values))


def _ends(c: Column, *values: str) -> Column:
    return reduce(or_, (c.endswith(v) for v in values))


def _in_tests(path: Column, ending: str) -> Column:
    return _ends(path, f"_test.{ending}", f"test_.{ending}") | _any(path, "/tests/", "\\tests\\")


def _flat(full: Column) -> Column:
    """Whether a line stands at the left margin."""
    return ~_starts(full, "\t", "  ")


def _unchecked_error(x: Line) -> Column:
    checks = [_any(n, "if err", "err != nil") | (n.contains("err") & _any(n, "if", "check")) for n in x.after[:3]]
    return _any(x.raw, "err :=", "err,", ", err") & ~_starts(x.raw, "//", "/*") & ~(x.raw.contains("if") & x.raw.contains("err")) & ~(checks[0] | checks[1] | checks[2])


def _python_global(x: Line) -> Column:
    constant = x.raw.rlike(r"^\p{Lu}[\p{Lu}_0-9]*=")
    passed = _starts(x.raw, "#", "def ", "class ", "@", "import ", "from ") | (x.raw.startswith("__") & x.raw.endswith("__")) | constant | _any(x.raw, "==", "!=", "<=", ">=")
    return (x.raw.contains("= ") | x.raw.endswith("=")) & ~x.full.rlike(r"^\s") & ~passed & ~(x.raw.contains(": ") & ~x.raw.contains("= "))


def _undocumented(x: Line) -> Column:
    first = F.coalesce(*[F.when(n != "", n) for n in x.after[:3]], F.lit(""))
    return ~_ends(x.path, "_test.py", "test_.py") & _starts(x.raw, "def ", "class ") & ~_any(x.raw, "def _", "class _") & ~_starts(first, '"""', "'''", 'r"""', "r'''")


def _bare_container(x: Line) -> Column:
    block = F.concat_ws(" ", x.raw, *x.after)
    return x.raw.contains("Container(") & _any(x.raw, "width:", "height:") & ~_any(block, "child:", "decoration:", "color:")


def _without_const(x: Line) -> Column:
    names = ("EdgeInsets.", "TextStyle(", "Color(", "Size(")
    found = [x.raw.contains(n) & ~F.substring_index(x.raw, n, 1).rlike("const[ \t]$") for n in names]
    return ~x.raw.startswith("//") & reduce(or_, found)


def _no_return_type(x: Line) -> Column:
    block = F.concat_ws(" ", x.raw, *x.after[:3])
    return x.raw.rlike(r"^pub (?:async fn |fn +[^(\s])") & block.contains("{") & ~block.contains("->")


RULES: tuple[Rule, ...] = (
    Rule("python/avoid-print", "minor", "python", lambda x: x.raw.contains("print(") & ~x.raw.startswith("#") & ~_in_tests(x.path, "py")),
    Rule("python/avoid-bare-except", "major", "python", lambda x: x.raw.startswith("except:")),
    Rule("python/avoid-mutable-default", "critical", "python", lambda x: x.raw.startswith("def ") & _any(x.raw, "=[]", "={}", "=set()", "=list()", "=dict()")),
    Rule("python/avoid-global-var", "info", "python", _python_global),
    Rule("python/avoid-todo", "info", "python", lambda x: _starts(x.raw, "#", '"""', "'''") & _any(F.upper(x.raw), "TODO", "FIXME", "HACK", "XXX")),
    Rule("python/avoid-star-import", "major", "python", lambda x: x.raw.startswith("from ") & x.raw.contains(" import *")),
    Rule("python/explicit-return-type", "info", "python", lambda x: x.raw.startswith("def ") & x.raw.contains("(") & x.raw.contains(":") & ~_any(x.raw, "->", "def _") & ~_ends(x.path, "_test.py", "test_.py", "__init__.py")),
    Rule("python/docstring-required", "info", "python", _undocumented),
    Rule("rust/avoid-println", "minor", "rust", lambda x: _any(x.raw, "println!(", "dbg!(") & ~x.raw.startswith("//") & ~_in_tests(x.path, "rs")),
    Rule("rust/avoid-unwrap", "major", "rust", lambda x: x.raw.contains(".unwrap()") & ~x.raw.startswith("//") & ~_any(x.raw, "#[test]", "#[cfg(test)]") & ~_in_tests(x.path, "rs")),
    Rule("rust/avoid-expect", "minor", "rust", lambda x: x.raw.contains(".expect(") & ~x.raw.startswith("//") & ~_in_tests(x.path, "rs")),
    Rule("rust/avoid-todo", "major", "rust", lambda x: x.raw.contains("todo!(") & ~x.raw.startswith("//")),
    Rule("rust/avoid-unimplemented", "major", "rust", lambda x: x.raw.contains("unimplemented!(") & ~x.raw.startswith("//")),
    Rule("rust/explicit-return-type", "info", "rust", _no_return_type),
    Rule("go/avoid-print", "minor", "go", lambda x: _any(x.raw, "fmt.Print", "log.Println") & ~x.raw.startswith("//") & ~x.path.endswith("_test.go")),
    Rule("go/avoid-empty-block", "major", "go", lambda x: x.raw.endswith("{}")),
    Rule("go/error-check", "critical", "go", _unchecked_error),
    Rule("go/avoid-init", "minor", "go", lambda x: _starts(x.raw, "func init()", "func init (")),
    Rule("go/avoid-global-var", "info", "go", lambda x: x.raw.startswith("var ") & ~_any(x.raw, ":= ", "const") & _flat(x.full) & ~x.raw.isin("var (", "var(")),
    Rule("go/exported-comment", "info", "go", lambda x: x.raw.rlike("^(?:func|type|var|const) [A-Z]") & _flat(x.full) & ~_starts(x.before, "//", "/*")),
    Rule("dart/avoid-print", "minor", "dart", lambda x: x.raw.contains("print(") & ~x.raw.startswith("//") & ~_any(x.raw, "blueprint", "sprintf")),
    Rule("dart/avoid-unnecessary-containers", "minor", "dart", _bare_container),
    Rule("dart/prefer-const-constructors", "minor", "dart", _without_const),
    Rule("dart/prefer-async-await", "minor", "dart", lambda x: x.raw.contains(".then(") & ~_starts(x.raw, "//", "expect")),
    Rule("dart/avoid-web-libraries-in-flutter", "major", "dart", lambda x: _starts(x.raw, "import ", "export ") & _any(x.raw, "dart:html", "dart:js", "dart:web_gl")),
)
LIMITS = {"max-function-lines": "major", "max-function-complexity": "major", "max-params": "major"}


def issues(files: DataFrame, rules: tuple[Rule, ...] = RULES, disabled: tuple[str, ...] = ()) -> DataFrame:
    """``(file_id, path, line, rule_id, severity)`` of all line rules, each once.

    One scan and one explode whatever the number of rules. The neighbours of a line are fields of its own row, so there is no window and
    no shuffle but that of the issues. Which rules hold is one number a line; only lines with a rule are taken apart.
    """
    kept = [r for r in rules if r.id not in disabled]
    by_language = {k: [r for r in kept if r.language == k] for k in dict.fromkeys(r.language for r in kept)}
    texts = files.where("file_id is not null and text is not null").select("file_id", "path", language_of(F.col("path")).alias("language"), "text")
    texts = spread(texts.where(F.col("language").isin(*by_language)))
    lines = texts.select("file_id", "path", "language", T.lines(F.col("text")).alias("full"))
    lines = lines.select("file_id", "path", "language", "full", F.transform("full", T.trim).alias("raw"))

    def near(i: Column, k: int) -> Column:
        return F.coalesce(F.get("raw", i + k), F.lit(""))

    each = F.transform(
        "full",
        lambda x, i: F.struct((i + 1).alias("line"), x.alias("full"), near(i, 0).alias("raw"), near(i, -1).alias("before"), *(near(i, k).alias(f"n{k}") for k in range(1, 5))),
    )
    rows = lines.select("file_id", "path", "language", F.explode(each).alias("x")).select("file_id", "path", "language", "x.*").where("raw <> ''")
    seen = Line(F.col("raw"), F.col("full"), F.col("before"), tuple(F.col(f"n{k}") for k in range(1, 5)), F.col("path"))
    mask = F.lit(0).cast("long")
    for language, some in by_language.items():
        bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(r.holds(seen), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, r in enumerate(some)))
        mask = F.when(F.col("language") == language, bits).otherwise(mask)
    found = rows.select("file_id", "path", "line", "language", mask.alias("mask")).where("mask <> 0")
    named = F.lit(None).cast("array<struct<rule_id string, severity string>>")
    for language, some in by_language.items():
        all_of = F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"))) for k, r in enumerate(some)])
        named = F.when(F.col("language") == language, F.array_compact(all_of)).otherwise(named)
    return found.select("file_id", "path", "line", F.explode(named).alias("hit")).select("file_id", "path", "line", "hit.*").distinct()


def function_limits(functions: DataFrame, files: DataFrame, max_lines: int = 50, max_complexity: int = 15, max_params: int = 5) -> DataFrame:
    """``(function_id, file_id, rule_id)``: functions above a limit, each once for each rule; lines are limited in TypeScript only."""
    return _over_limits(functions, max_lines, max_complexity, max_params).select("function_id", "file_id", "rule_id").distinct()


def _over_limits(functions: DataFrame, max_lines: int = 50, max_complexity: int = 15, max_params: int = 5) -> DataFrame:
    f = functions.where("function_id is not null").select("function_id", "file_id", "path", "start_line", "end_line", "complexity", "parameter_count").distinct()
    typescript = language_of(F.col("path")).isin(*TS)
    hits = F.array(
        F.when(typescript & (F.col("end_line") - F.col("start_line") + 1 > max_lines), F.lit("max-function-lines")),
        F.when(F.col("complexity") > max_complexity, F.lit("max-function-complexity")),
        F.when(F.col("parameter_count") > max_params, F.lit("max-params")),
    )
    return f.select("function_id", "file_id", "path", "start_line", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("rule_id"))


def limit_issues(functions: DataFrame) -> DataFrame:
    """``(file_id, path, line, rule_id, severity)``: :func:`function_limits` at the first line of each function, one for each function and rule."""
    over = _over_limits(functions).where("file_id is not null").groupBy("function_id", "file_id", "rule_id").agg(F.min("path").alias("path"), F.min("start_line").alias("line"))
    severity = F.create_map(*[F.lit(x) for r in ("max-function-lines", "max-function-complexity", "max-params") for x in (r, LIMITS[r])])
    return over.select("file_id", "path", "line", "rule_id", F.element_at(severity, F.col("rule_id")).alias("severity"))


def custom_issues(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``(file_id, line, rule_id, severity, message, start_column)``: every match of user rules, line by line.

    ``rules`` is ``(id, severity, languages array, pattern, message)``, a table of settings, read on the driver, so that each line is
    tested against the patterns of its language as constants. Lines
    that begin as comments are passed over; an empty list of languages means all; ``$0`` in the message is the match; an
    unknown severity counts as major; of equal ids the first pattern in order counts. Columns are characters from 1. Patterns with lookaround or back references are rejected.
    """
    kept = rules.where("id is not null and pattern is not null").where(~F.col("pattern").rlike(r"\(\?[=!<]|\\[1-9]"))
    first = kept.groupBy("id").agg(F.min(F.struct("pattern", "severity", "languages", "message")).alias("r")).select("id", "r.*").orderBy("id")
    settings = [r.asDict() for r in first.collect()]
    rows = line_rows(spread(files.select("file_id", "text", language_of(F.col("path")).alias("language"))), "language")
    rows = rows.where(~_starts(T.trim(F.col("text")), "//", "#", "/*", "*"))
    text = F.col("text")
    tests = []
    for k, r in enumerate(settings):
        here = text.rlike(r["pattern"])
        if r["languages"]:
            here = F.col("language").isin(*r["languages"]) & here
        tests.append(F.when(here, F.lit(k)))
    if not tests:
        tests = [F.lit(None).cast("int")]
    rows = rows.select("file_id", "line", "text", F.explode(F.array_compact(F.array(*tests))).alias("k"))
    chosen = lambda f: reduce(lambda a, kr: F.when(F.col("k") == kr[0], f(kr[1])).otherwise(a), enumerate(settings), F.lit(None))
    severity = {k: r["severity"].lower() if (r["severity"] or "").lower() in T.SEVERITIES else "major" for k, r in enumerate(settings)}
    matches = chosen(lambda r: F.regexp_extract_all(text, F.lit(r["pattern"]), F.lit(0)))
    gaps = chosen(lambda r: F.split(text, r["pattern"], -1))
    rows = rows.select(
        "file_id", "line", "k", matches.cast("array<string>").alias("matches"), gaps.cast("array<string>").alias("gaps"),
        chosen(lambda r: F.lit(r["id"])).cast("string").alias("rule_id"), chosen(lambda r: F.lit(r["message"] if r["message"] is not None else "Matched pattern: " + r["pattern"])).cast("string").alias("template"),
        chosen(lambda r: F.lit(severity[settings.index(r)])).cast("string").alias("severity"),
    )
    hits = rows.select("*", F.posexplode("matches").alias("n", "m"))
    before = F.expr("aggregate(slice(gaps, 1, n + 1), 0, (a, x) -> a + length(x)) + aggregate(slice(matches, 1, n), 0, (a, x) -> a + length(x))")
    message = F.replace("template", F.lit("$0"), F.col("m"))
    return hits.select("file_id", "line", "rule_id", "severity", message.alias("message"), (before + 1).alias("start_column")).distinct()
