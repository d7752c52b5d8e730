"""Comparison of two runs: states of files and lifecycles of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_status(previous: DataFrame, current: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """``(key, status)``: ``added``, ``changed``, ``unchanged`` or ``removed`` by a full outer join of two snapshots."""
    p = previous.select(key, F.col(value).alias("_p"), F.lit(True).alias("_in_p"))
    c = current.select(key, F.col(value).alias("_c"), F.lit(True).alias("_in_c"))
    status = (
        F.when(F.col("_in_p").isNull(), "added").when(F.col("_in_c").isNull(), "removed").when(F.col("_p").eqNullSafe(F.col("_c")), "unchanged").otherwise("changed")
    )
    return p.join(c, key, "full_outer").select(key, status.alias("status"))


def issue_key(rule: str = "rule_id", line: str = "line", message: str = "message") -> Column:
    """A key that stays the same while rule, line and message do."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (rule, line, message)]
    return F.concat_ws(":", parts[0], parts[1], F.md5(F.concat_ws("\x01", *parts)))


def issue_lifecycle(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``(path, key, status)`` over issues ``(path, key)``: ``persistent``, ``regressed`` (new in a file that had issues), ``new`` or ``fixed``."""
    p = previous.select("path", "key").distinct()
    c = current.select("path", "key").distinct()
    had = p.select("path").distinct().withColumn("_had", F.lit(True))
    known = c.join(p.withColumn("_known", F.lit(True)), ["path", "key"], "left").join(had, "path", "left")
    status = F.when(F.col("_known"), "persistent").when(F.col("_had"), "regressed").otherwise("new")
    fixed = p.join(c, ["path", "key"], "left_anti").select("path", "key", F.lit("fixed").alias("status"))
    return known.select("path", "key", status.alias("status")).unionByName(fixed)


def merge(previous: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """The next snapshot: all of the current one, and of the previous what was not scanned again."""
    return current.unionByName(previous.join(current.select(key).distinct(), key, "left_anti"))


def unchanged_split(current: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to analyse and files whose hash equals that of the last run, by ``path``."""
    joined = current.join(previous.select("path", F.col("hash").alias("_last")), "path", "left")
    same = F.col("hash").eqNullSafe(F.col("_last")) & F.col("_last").isNotNull()
    return joined.where(~same).drop("_last"), joined.where(same).drop("_last")
