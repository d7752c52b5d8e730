"""What follows from issues: counts, ratings, gates and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.operators import rules, treerules


def all_issues(files: DataFrame, functions: DataFrame | None = None, disabled: tuple[str, ...] = ()) -> DataFrame:
    """``(file_id, path, line, rule_id, severity)`` of line rules, structural rules, tainted sinks and, with ``functions``, their limits."""
    kinds = [rules.issues(files, disabled=disabled), treerules.tree_issues(files, disabled)]
    if functions is not None:
        kinds.append(rules.limit_issues(functions).where(~F.col("rule_id").isin(*disabled)) if disabled else rules.limit_issues(functions))
    first, *others = (x.select("file_id", "path", F.col("line").cast("int").alias("line"), "rule_id", "severity") for x in kinds)
    for x in others:
        first = first.unionByName(x)
    return first


def severity_counts(issues: DataFrame) -> DataFrame:
    """``(severity, issues)`` with a row for each of the five severities."""
    spark = issues.sparkSession
    every = spark.createDataFrame([(s,) for s in T.SEVERITIES], "severity string")
    counted = issues.groupBy("severity").agg(F.count(F.lit(1)).alias("issues"))
    return F.broadcast(every).join(counted, "severity", "left").select("severity", F.coalesce("issues", F.lit(0)).alias("issues"))


def top_rules(issues: DataFrame, n: int = 5) -> DataFrame:
    """The rules with most issues, ties by id."""
    return issues.groupBy("rule_id").agg(F.count(F.lit(1)).alias("issues")).orderBy(F.desc("issues"), "rule_id").limit(n)


def top_issues(issues: DataFrame, n: int = 10) -> DataFrame:
    """The first issues by severity, path, line and rule."""
    ranked = issues.withColumn("severity_rank", T.severity_rank(F.col("severity")))
    return ranked.orderBy("severity_rank", "path", "line", "rule_id", "file_id").limit(n).select("severity", "path", "line", "rule_id")


def rating(share: Column) -> Column:
    """A letter for a percentage of files."""
    return F.when(share.isNull() | (share < 5), "A").when(share < 10, "B").when(share < 20, "C").when(share < 50, "D").otherwise("E")


def ratings(issues: DataFrame, files: DataFrame) -> DataFrame:
    """``(kind, share, rating)``: the share of files with an issue at least as severe as the kind's threshold.

    Reliability counts blockers, security blockers and criticals, maintainability down to major. Both sides are aggregated before they meet.
    """
    total = files.where("file_id is not null").agg(F.countDistinct("file_id").alias("total"))
    worst = issues.groupBy("file_id").agg(F.min(T.severity_rank(F.col("severity"))).alias("worst"))
    counts = worst.agg(*[F.count_if(F.col("worst") <= k).alias(name) for k, name in enumerate(("reliability", "security", "maintainability"))])
    one = counts.crossJoin(total)  # one row each
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(n).alias("n")) for n in ("reliability", "security", "maintainability")]))
    rows = one.select("total", kinds.alias("k")).select("k.kind", T.percent(F.col("k.n"), F.col("total")).alias("share"))
    return rows.select("kind", F.round("share", 4).alias("share"), rating(F.col("share")).alias("rating"))


def gate(values: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """``(check, value, threshold, passed)``; ``values`` is ``(check, value)`` and a null value passes.

    A limit is ``("max", x)`` or ``("min", x)``. Checks without a limit are informational and pass.
    """
    spark = values.sparkSession
    table = spark.createDataFrame([(k, d, float(x)) for k, (d, x) in limits.items()], "check string, direction string, threshold double")
    rows = values.join(F.broadcast(table), "check", "left")
    passed = F.when(F.col("direction") == "max", F.col("value") <= F.col("threshold")).when(F.col("direction") == "min", F.col("value") >= F.col("threshold"))
    return rows.select("check", "value", "threshold", F.coalesce(passed, F.lit(True)).alias("passed"))


RATINGS = ("A", "B", "C", "D", "E")


def rating_rank(letter: Column) -> Column:
    """0 for ``A`` to 4 for ``E``, so that ratings compare."""
    return F.array_position(F.array(*[F.lit(x) for x in RATINGS]), letter) - 1


def rating_checks(ratings_: DataFrame, most: str) -> DataFrame:
    """``(check, value, threshold, passed)``: whether each rating is ``most`` or better."""
    worst = RATINGS.index(most)
    rank = rating_rank(F.col("rating")).cast("double")
    return ratings_.select(F.concat("kind", F.lit("_rating")).alias("check"), rank.alias("value"), F.lit(float(worst)).alias("threshold"), (rank <= worst).alias("passed"))


def severity_checks(counts: DataFrame, prefix: str = "") -> DataFrame:
    """The checks that no blocker and no critical is left, over ``(severity, issues)``: issues, dependencies or alerts."""
    rows = counts.where("severity in ('blocker', 'critical')")
    return rows.select(F.concat(F.lit(prefix), "severity", F.lit("_issues")).alias("check"), F.col("issues").cast("double").alias("value"), F.lit(0.0).alias("threshold"), (F.col("issues") <= 0).alias("passed"))


def coverage_check(name: str, totals_: DataFrame, least: float) -> DataFrame:
    """The check of a coverage ``(total, percent)``; without lines there is none."""
    rows = totals_.where("total > 0")
    return rows.select(F.lit(name).alias("check"), F.col("percent").alias("value"), F.lit(least).alias("threshold"), (F.col("percent") >= least).alias("passed"))


def verdict(checks: DataFrame) -> DataFrame:
    """The checks and a last row ``gate``: passed if all of them are; its value is the number that failed. No checks pass."""
    one = checks.agg(F.lit("gate").alias("check"), F.count_if(~F.col("passed")).cast("double").alias("value"), F.lit(0.0).alias("threshold"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))
    return checks.unionByName(one)


def selected(issues: DataFrame, new_keys: DataFrame | None = None, modified: DataFrame | None = None) -> DataFrame:
    """Issues of new code: those ``new_keys(path, key)`` has, those of files in ``modified(path)``, of either if both are given, all without them."""
    if new_keys is None and modified is None:
        return issues
    marked = issues
    for table, keys, name in ((new_keys, ["path", "key"], "_new"), (modified, ["path"], "_recent")):
        if table is not None:
            marked = marked.join(table.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left")
        else:
            marked = marked.withColumn(name, F.lit(False))
    return marked.where("coalesce(_new, false) or coalesce(_recent, false)").drop("_new", "_recent")


def significant_split(issues: DataFrame, significant: Column) -> DataFrame:
    """``(significant, other)``: how many issues lie in significant code and how many do not."""
    return issues.agg(F.count_if(significant).alias("significant"), F.count_if(~significant).alias("other"))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("blocker", "critical"), "error").when(severity == "major", "warning").otherwise("note")


def sarif_results(issues: DataFrame) -> DataFrame:
    """One JSON result per issue, ``(file_id, line, rule_id, result)``, as SARIF 2.1.0 has them.

    ``end_line`` and ``start_column`` (from 1) of the issues are used where there are such columns; a line is an issue of its own otherwise.
    """
    column = F.coalesce("start_column", F.lit(1)) if "start_column" in issues.columns else F.lit(1)
    end = F.greatest("line", "end_line") if "end_line" in issues.columns else F.col("line")
    location = F.struct(
        F.struct(
            F.struct(F.col("path").alias("uri")).alias("artifactLocation"),
            F.struct(F.col("line").alias("startLine"), end.alias("endLine"), column.alias("startColumn")).alias("region"),
        ).alias("physicalLocation")
    )
    body = F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.array(location).alias("locations"))
    return issues.select("file_id", "line", "rule_id", F.to_json(body).alias("result"))


def sarif_rules(issues: DataFrame) -> DataFrame:
    """The distinct rules with their level and number of results, by id."""
    return issues.groupBy("rule_id").agg(F.min(sarif_level(F.col("severity"))).alias("level"), F.count(F.lit(1)).alias("results")).orderBy("rule_id")
