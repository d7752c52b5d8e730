"""Complexity from token streams: decisions, nesting and the functions they lie in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Tokens that open another path, and those that nest what follows.
DECISIONS = ("if", "elif", "for", "while", "do", "case", "catch", "except", "&&", "||", "??", "and", "or", "?")
NESTING = ("if", "elif", "for", "while", "do", "catch", "except", "switch", "match")


def by_file(tokens: DataFrame) -> DataFrame:
    """``(file_id, cyclomatic, nested, depth)``: one more than the decisions; decisions weighted by the depth of braces they stand in; the greatest depth.

    ``tokens`` has each unit once. The depth is a running sum over one file's tokens, which is the largest thing a task holds.
    """
    step = F.when(F.col("text") == "{", 1).when(F.col("text") == "}", -1).otherwise(0)
    depth = F.sum(step).over(Window.partitionBy("file_id").orderBy("unit").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = tokens.select("file_id", "text", depth.alias("depth"))
    return rows.groupBy("file_id").agg(
        (F.count_if(F.col("text").isin(*DECISIONS)) + 1).alias("cyclomatic"),
        F.coalesce(F.sum(F.when(F.col("text").isin(*NESTING), 1 + F.greatest(F.col("depth"), F.lit(0)))), F.lit(0)).alias("nested"),
        F.greatest(F.max("depth"), F.lit(0)).alias("depth"),
    )


def by_function(tokens: DataFrame, functions: DataFrame) -> DataFrame:
    """``(function_id, tokens, cyclomatic)`` of functions by their lines; a nested function's decisions count in the outer one too.

    Decisions are counted by line before they meet the functions, so the join, on the file and within the span, moves a row per line.
    """
    lines = tokens.groupBy("file_id", "line").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").isin(*DECISIONS)).alias("decisions"))
    spans = functions.where("function_id is not null and file_id is not null").select("function_id", "file_id", "start_line", "end_line").distinct()
    inside = (spans["file_id"] == lines["file_id"]) & lines["line"].between(spans["start_line"], spans["end_line"])
    return spans.join(lines, inside, "left").groupBy("function_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), (F.coalesce(F.sum("decisions"), F.lit(0)) + 1).alias("cyclomatic")
    )
