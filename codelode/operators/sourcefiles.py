"""Files, their languages, line counts and markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.session import spread

# Languages with their extensions, in the order in which they are listed.
LANGUAGES = {
    "rust": ("rs",), "typescript": ("ts", "mts", "cts"), "javascript": ("js", "mjs", "cjs"), "tsx": ("tsx",), "jsx": ("jsx",),
    "python": ("py", "pyi"), "go": ("go",), "java": ("java",), "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx"),
    "csharp": ("cs",), "ruby": ("rb",), "php": ("php",), "kotlin": ("kt", "kts"), "swift": ("swift",), "dart": ("dart",), "scala": ("scala", "sc"),
    "bash": ("sh", "bash", "zsh"), "sql": ("sql",), "html": ("html", "htm"), "css": ("css",), "scss": ("scss", "sass"), "json": ("json",),
    "yaml": ("yaml", "yml"), "toml": ("toml",), "markdown": ("md", "markdown"),
}
HASH_STYLE = ("python", "ruby", "bash", "yaml", "toml", "php")
BLOCK_STYLE = ("html", "css", "scss", "php")
NO_STYLE = ("json", "markdown")

# Drops closed block comments and keeps line comments, whichever begins first.
CLOSED_BLOCKS = r"(//.*)|/\*.*?\*/"


def language_of(path: Column) -> Column:
    """The language of a path's extension, null for one that is not listed."""
    by_ext = F.create_map(*[F.lit(x) for lang, exts in LANGUAGES.items() for e in exts for x in (e, lang)])
    return F.try_element_at(by_ext, T.extension(path))


def once(files: DataFrame, *columns: str) -> DataFrame:
    """Each file once: rows delivered again carry the same content."""
    return files.where("file_id is not null").select("file_id", *columns).distinct()


def is_test_or_generated(path: Column) -> Column:
    """Whether a path names a test, a generated file or one that is not source."""
    p = F.lower(path)
    name = F.regexp_extract(p, r"([^/\\]*)$", 1)
    return (
        name.rlike(r"\.(spec|test)\.(ts|tsx|js|jsx)$|_test\.(dart|go|rs|py)$|\.test\.dart$|^test_.*\.(rs|py)$")
        | p.rlike(r"__tests__|[/\\]tests?[/\\]")
        | name.rlike(r"\.d\.ts$|\.generated\.tsx?$|\.min\.")
        | name.rlike(r"\.(json|ya?ml|toml|xml|html|css|scss|md|lock|prisma|graphql|gql|sql)$")
    )


def duplication_eligible(path: Column) -> Column:
    """Whether duplication detection looks at a path."""
    return ~is_test_or_generated(path) & T.extension(path).isin("ts", "tsx", "js", "jsx", "dart", "py")


def discover(files: DataFrame, include: list[str] = (), exclude: list[str] = (), max_bytes: int = 1 << 20, tests: bool = True, ignored: list[str] = ()) -> DataFrame:
    """Files to scan: include, exclude, repository folder, patterns of ignore files, size and known language, in order of path; predicates that need no text come first."""
    path = F.col("path")
    kept = files.where(T.matches_any(path, list(include))) if include else files
    kept = kept.where(~T.matches_any(path, [*exclude, *ignored, ".git/**", "**/.git/**"])).where(language_of(path).isNotNull())
    if not tests:
        kept = kept.where(~is_test_or_generated(path))
    return kept.where(F.octet_length("text") <= max_bytes).orderBy("path")


def single_file(files: DataFrame, path: str) -> DataFrame:
    """The one file that was asked for, however else its folder is filtered."""
    return files.where(T.normalize_path(F.col("path")) == path.replace("\\", "/"))


def nosonar(line: Column, language: Column) -> Column:
    """Whether a line carries the marker in a comment style of its language; ``#`` for unknown ones."""
    slash, hashed, block = (
        line.rlike(r"(?i)(?:^|\s)(?://[!/]?|--)\s*NOSONAR\b"), line.rlike(r"(?i)(?:^|\s)#\s*NOSONAR\b"), line.rlike(r"(?i)(?:/\*|<!--)\s*NOSONAR\b"),
    )
    return (
        F.when(language.isNull(), hashed)
        .when(language == "php", hashed | block)
        .when(language.isin(*HASH_STYLE), hashed)
        .when(language.isin(*BLOCK_STYLE), block)
        .when(language.isin(*NO_STYLE), F.lit(False))
        .otherwise(slash)
    )


def line_rows(files: DataFrame, *columns: str) -> DataFrame:
    """``(file_id, *columns, line, text)``: the lines of each file, from 1. Null texts have none."""
    return files.where("file_id is not null and text is not null").select(
        "file_id", *columns, F.posexplode(T.lines(F.col("text"))).alias("line", "text")
    ).withColumn("line", F.col("line") + 1)


def nosonar_counts(files: DataFrame) -> DataFrame:
    """``(file_id, markers)`` of the files with marked lines; a file delivered twice counts once."""
    rows = line_rows(files.select("file_id", "text", language_of(F.col("path")).alias("language")), "language")
    marked = rows.where(nosonar(F.col("text"), F.col("language"))).select("file_id", "line").distinct()
    return marked.groupBy("file_id").agg(F.count(F.lit(1)).alias("markers"))


def line_metrics(raw: Column) -> Column:
    """``struct(loc, code, comment, blank)`` of the trimmed lines of a text.

    A line is a comment if ``#`` begins it, ``//`` stands in it outside a block comment, or it ends inside one; the line that
    closes a block counts as code. What each line does to the open or closed state, and how it counts in either, is found first, by
    plain searches for most lines; the fold over the lines then only looks these up.
    """

    def effect(line: Column) -> Column:
        slash, star, closes = F.instr(line, "//"), F.instr(line, "/*"), F.instr(line, "*/")
        # Only a line with a block comment before any line comment needs its closed blocks taken out.
        rest = F.when((star > 0) & ((slash == 0) | (star < slash)), F.regexp_replace(line, CLOSED_BLOCKS, "$1"))
        inner = F.when(closes > 0, F.regexp_replace(F.substr(line, closes + 2), CLOSED_BLOCKS, "$1"))
        hashed = line.startswith("#")
        opens, noted = _opens(rest), F.when(rest.isNull(), slash > 0).otherwise(_line_comment(rest))
        return (
            F.when(line == "", F.lit(0))
            # Bits: 1 not blank, 2 open after when closed before, 4 a comment then, 8 open after when open before, 16 a comment then.
            .otherwise(
                F.lit(1)
                + F.when(hashed, 4).when(F.coalesce(opens, F.lit(False)), 2 + 4).when(noted, 4).otherwise(0)
                + F.when(closes == 0, 8 + 16).when(_opens(inner), 8 + 16).when(_line_comment(inner), 16).otherwise(0)
            )
        )

    def step(acc: Column, e: Column) -> Column:
        opened = acc["inside"] == 1
        comment = e.bitwiseAND(F.when(opened, 16).otherwise(4)) != 0
        return F.struct(
            F.when(e == 0, acc["inside"]).when(e.bitwiseAND(F.when(opened, 8).otherwise(2)) != 0, 1).otherwise(0).alias("inside"),
            (acc["loc"] + 1).alias("loc"), (acc["code"] + F.when((e != 0) & ~comment, 1).otherwise(0)).alias("code"),
            (acc["comment"] + F.when((e != 0) & comment, 1).otherwise(0)).alias("comment"), (acc["blank"] + F.when(e == 0, 1).otherwise(0)).alias("blank"),
        )

    empty = F.struct(*[F.lit(0).alias(n) for n in ("inside", "loc", "code", "comment", "blank")])
    return F.aggregate(F.transform(raw, effect), empty, step)


def _opens(rest: Column) -> Column:
    slash, star = F.instr(rest, "//"), F.instr(rest, "/*")
    return (star > 0) & ((slash == 0) | (star < slash))


def _line_comment(rest: Column) -> Column:
    slash, star = F.instr(rest, "//"), F.instr(rest, "/*")
    return (slash > 0) & ((star == 0) | (slash < star))


def metrics_by_file(files: DataFrame) -> DataFrame:
    """``(file_id, language, loc, code, comment, blank)`` of each file once."""
    rows = spread(files.where("file_id is not null and text is not null").select("file_id", "path", "text"))
    raw = rows.select("file_id", language_of(F.col("path")).alias("language"), F.transform(T.lines(F.col("text")), T.trim).alias("raw"))
    m = raw.select("file_id", "language", line_metrics(F.col("raw")).alias("m"))
    return m.select("file_id", "language", "m.loc", "m.code", "m.comment", "m.blank").distinct()


def metrics_by_language(files: DataFrame) -> DataFrame:
    """Files, lines and comment density by language."""
    return (
        metrics_by_file(files)
        .groupBy("language")
        .agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in ("loc", "code", "comment", "blank")])
        .withColumn("density", F.round(T.percent(F.col("comment"), F.col("code") + F.col("comment")), 4))
    )
