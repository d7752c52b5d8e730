"""Project roll-ups over files and functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.operators.sourcefiles import LANGUAGES, language_of, once
from codelode.operators.structure import shape_of
from codelode.session import spread

_FUNCTION = ("name", "start_line", "end_line", "cyclomatic", "cognitive", "parameters")


def project_metrics(files: DataFrame, functions: DataFrame) -> DataFrame:
    """``(repo, files, loc, code_lines, comment_lines, blank_lines, functions, average_complexity, worst_function)`` of each repository.

    Deliveries of one record count once; null counters add nothing; the average is over functions with a complexity. The worst function is the most complex one, of equals that of the
    least path, line and id.
    """
    f = once(files, "repo", "loc", "code_lines", "comment_lines", "blank_lines", "class_count")
    sums = f.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("loc", "code_lines", "comment_lines", "blank_lines")]
    )
    g = functions.where("function_id is not null").select("function_id", "repo", "path", "start_line", "complexity").distinct()
    worst = F.min(F.when(F.col("complexity").isNotNull(), F.struct((-F.col("complexity")).alias("c"), "path", "start_line", "function_id")))
    stats = g.groupBy("repo").agg(
        F.count(F.lit(1)).alias("functions"), F.round(F.sum("complexity") / F.count("complexity"), 4).alias("average_complexity"), worst["function_id"].alias("worst_function")
    )
    return sums.join(stats, "repo", "left").withColumn("functions", F.coalesce("functions", F.lit(0)))


def language_histogram(files: DataFrame) -> DataFrame:
    """Files by language of their extension, most first."""
    return once(files, "path").groupBy(language_of(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "language")


def comment_density(files: DataFrame) -> DataFrame:
    """``(repo, comment_density)``: comments over code and comments, 0 without either."""
    f = once(files, "repo", "code_lines", "comment_lines").groupBy("repo").agg(F.sum("code_lines").alias("code"), F.sum("comment_lines").alias("comment"))
    whole = F.coalesce(F.col("code"), F.lit(0)) + F.coalesce(F.col("comment"), F.lit(0))
    return f.select("repo", F.round(F.when(whole > 0, F.coalesce(F.col("comment"), F.lit(0)) / whole).otherwise(0.0), 6).alias("comment_density"))


def complexity_histogram(functions: DataFrame) -> DataFrame:
    """Functions by complexity; nulls have a row of their own."""
    return functions.where("function_id is not null").select("function_id", "complexity").distinct().groupBy("complexity").agg(F.count(F.lit(1)).alias("functions"))


def recently_modified(files: DataFrame, days: int, now: str) -> DataFrame:
    """``(file_id, path)`` of files modified in the ``days`` before ``now``."""
    edge = F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days))
    return files.where((F.col("modified_at") >= edge) & (F.col("modified_at") <= F.to_timestamp(F.lit(now)))).select("file_id", "path").distinct()


def scan_settings(scans: DataFrame) -> DataFrame:
    """``(scan_id, mode, min_tokens, min_lines, normalize_identifiers)`` with the defaults in place of nulls, each scan once by its latest delivery."""
    latest = scans.where("scan_id is not null").groupBy("scan_id").agg(
        F.max_by(F.struct("mode", "min_tokens", "min_lines", "normalize_identifiers"), F.struct("ingested_at", F.coalesce("total_files", F.lit(-1)))).alias("s")
    )
    m = F.lower("s.mode")
    mode = F.when(m.isin("token", "tokens", "shingle"), "token").otherwise("sonar")
    return latest.select(
        "scan_id", mode.alias("mode"), F.coalesce("s.min_tokens", F.lit(100)).alias("min_tokens"), F.coalesce("s.min_lines", F.lit(10)).alias("min_lines"),
        F.coalesce("s.normalize_identifiers", F.lit(False)).alias("normalize_identifiers"),
    )


def _shape_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, rows = [], []
        for n, (language, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
            shape = shape_of(text, language)
            if shape is not None:
                at.append(n)
                rows.append((shape.classes, shape.interfaces, shape.aliases, shape.enums, shape.complexity, [dict(zip(_FUNCTION, f, strict=True)) for f in shape.functions]))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [*[pa.int32()] * 5, pa.list_(pa.struct([(k, pa.string() if k == "name" else pa.int32()) for k in _FUNCTION]))]
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
            names=["file_id", "classes", "interfaces", "aliases", "enums", "complexity", "functions"],
        )


def file_shapes(files: DataFrame) -> DataFrame:
    """``(file_id, classes, interfaces, aliases, enums, complexity, functions)`` of each source file once.

    ``functions`` has name, first and last line, cyclomatic and cognitive complexity and parameters of each. Null texts, languages without a
    structure here and Python that does not parse give no row.
    """
    rows = files.where("file_id is not null and text is not null").select("file_id", language_of(F.col("path")).alias("language"), "text")
    rows = spread(rows.where(F.col("language").isin("typescript", "tsx", "javascript", "jsx", "dart", "go", "rust", "python")))
    fields = ", ".join(f"{k}: {'string' if k == 'name' else 'int'}" for k in _FUNCTION)
    schema = f"file_id long, classes int, interfaces int, aliases int, enums int, complexity int, functions array<struct<{fields}>>"
    return rows.mapInArrow(_shape_rows, schema).dropDuplicates(["file_id"])


def function_shapes(files: DataFrame) -> DataFrame:
    """``(file_id, name, start_line, end_line, cyclomatic, cognitive, parameters)`` of each function of :func:`file_shapes`."""
    return file_shapes(files).select("file_id", F.inline("functions"))


# The short forms of languages' names; a name stands for itself.
SHORT_NAMES = {
    "rs": "rust", "ts": "typescript", "js": "javascript", "py": "python", "golang": "go", "c++": "cpp", "cxx": "cpp", "cs": "csharp", "c#": "csharp", "rb": "ruby",
    "kt": "kotlin", "sh": "bash", "shell": "bash", "sass": "scss", "yml": "yaml", "md": "markdown",
}


def language_of_name(name: Column) -> Column:
    """The language that a user's word for it means, in any case; ``other`` for none."""
    table = F.create_map(*[F.lit(x) for pair in ({k: k for k in LANGUAGES} | SHORT_NAMES).items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(name)), F.lit("other"))
