"""Line coverage: merged reports, totals, new code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions import text as T


def by_file(lines: DataFrame) -> DataFrame:
    """``(path, total, covered, percent, uncovered)`` over coverage lines ``(path, line, hits)``.

    Rows of one line from several reports are counted each, as totals of reports add up; the uncovered lines are a sorted set.
    """
    rows = lines.where("path is not null and line is not null")
    return rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("hits") > 0).alias("covered"),
        F.array_sort(F.collect_set(F.when(F.coalesce("hits", F.lit(0)) <= 0, F.col("line")))).alias("uncovered"),
    ).withColumn("percent", F.round(T.percent(F.col("covered"), F.col("total")), 4))


def totals(lines: DataFrame, *by: str) -> DataFrame:
    """Files, lines and covered lines, over all or by columns; aggregated in two steps so the first combines before the shuffle."""
    rows = lines.where("path is not null and line is not null")
    per_file = rows.groupBy(*by, "path").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("hits") > 0).alias("covered"))
    return per_file.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("covered"), F.lit(0)).alias("covered")
    ).withColumn("percent", F.round(T.percent(F.col("covered"), F.col("total")), 4))


def lowest(lines: DataFrame, n: int = 10) -> DataFrame:
    """The files of least coverage below 100 %, ties by path."""
    return by_file(lines).where("covered < total").select("path", "total", "covered", "percent").orderBy("percent", "path").limit(n)


def new_code(lines: DataFrame, blame: DataFrame, new_commits: DataFrame) -> DataFrame:
    """One row of coverage over the lines whose commit is new: ``blame(path, line, commit)`` semi-joined with ``new_commits(commit)``."""
    fresh = blame.join(new_commits.select("commit").distinct(), "commit", "left_semi").select("path", "line").distinct()
    state = lines.groupBy("path", "line").agg(F.max("hits").alias("hits"))
    return state.join(fresh, ["path", "line"], "left_semi").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("hits") > 0).alias("covered")
    ).withColumn("percent", F.round(T.percent(F.col("covered"), F.col("total")), 4))


def excluding(lines: DataFrame, globs: list[str]) -> DataFrame:
    """Lines of files that match none of the globs; totals follow from what is left."""
    return lines.where(~T.matches_any(F.col("path"), globs))


def new_code_by_file(totals_: DataFrame, status: DataFrame) -> DataFrame:
    """One row of coverage over files that ``status(path, status)`` calls added or changed: what is left to count where lines have no commits."""
    fresh = status.where("status in ('added', 'changed')").select("path").distinct()
    return totals_.join(fresh, "path", "left_semi").agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("covered"), F.lit(0)).alias("covered")
    ).withColumn("percent", F.round(T.percent(F.col("covered"), F.col("total")), 4))
