"""Packages and the advisories that concern them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import text as T


def clean_advisories(advisories: DataFrame) -> DataFrame:
    """Advisory rows once each: ``(ecosystem, name, version, osv_id, cvss, severity)``, names of ecosystems and ids in one case, severity by score."""
    rows = advisories.where("osv_id is not null and name is not null").select(
        F.lower("ecosystem").alias("ecosystem"), "name", "version", F.upper(T.trim(F.col("osv_id"))).alias("osv_id"),
        F.when(~F.isnan("cvss"), F.col("cvss")).alias("cvss"),
    ).distinct()
    return rows.withColumn("severity", T.cvss_severity(F.col("cvss")))


def vulnerabilities(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """``(ecosystem, name, version, osv_id, severity)`` of the packages that an advisory names; one packages row suffices however often it is locked."""
    keys = ["ecosystem", "name", "version"]
    p = packages.select(F.lower("ecosystem").alias("ecosystem"), "name", "version").distinct()
    worst = clean_advisories(advisories).groupBy(*keys, "osv_id").agg(F.min(T.severity_rank(F.col("severity"))).alias("rank"))
    names = F.array(*[F.lit(s) for s in T.SEVERITIES])
    return p.join(worst, keys).select(*keys, "osv_id", F.element_at(names, F.col("rank") + 1).alias("severity"))


def severity_by_ecosystem(advisories: DataFrame) -> DataFrame:
    """``(ecosystem, severity, advisories)``: distinct ids, each with its most severe score there."""
    worst = clean_advisories(advisories).groupBy("ecosystem", "osv_id").agg(F.min(T.severity_rank(F.col("severity"))).alias("rank"))
    names = F.array(*[F.lit(s) for s in T.SEVERITIES])
    return worst.groupBy("ecosystem", F.element_at(names, F.col("rank") + 1).alias("severity")).agg(F.count(F.lit(1)).alias("advisories"))


def packages_at_risk(advisories: DataFrame, n: int = 20) -> DataFrame:
    """The packages with most advisories, ties by name: ``(ecosystem, name, advisories, versions, worst_cvss)``."""
    rows = clean_advisories(advisories).groupBy("ecosystem", "name").agg(
        F.countDistinct("osv_id").alias("advisories"), F.countDistinct("version").alias("versions"), F.max("cvss").alias("worst_cvss")
    )
    return rows.orderBy(F.desc("advisories"), "ecosystem", "name").limit(n)


def by_severity(found: DataFrame) -> DataFrame:
    """``(severity, issues)`` of vulnerabilities or alerts, a row for each of the five severities."""
    every = found.sparkSession.createDataFrame([(s,) for s in T.SEVERITIES], "severity string")
    return every.join(found.groupBy("severity").agg(F.count(F.lit(1)).alias("issues")), "severity", "left").select("severity", F.coalesce("issues", F.lit(0)).alias("issues"))


def listed(found: DataFrame) -> DataFrame:
    """Vulnerabilities in the order of a report: the least severe first, then by name; ``position`` from 1 within an ecosystem."""
    w = Window.partitionBy("ecosystem").orderBy(T.severity_rank(F.col("severity")).desc(), "name", "version", "osv_id")
    return found.withColumn("position", F.row_number().over(w))


def lock_files(packages: DataFrame) -> DataFrame:
    """One row: distinct lock files and packages."""
    return packages.agg(F.countDistinct("source_file").alias("lock_files"), F.countDistinct("ecosystem", "name", "version").alias("packages"))


def cvss_number(vector: Column) -> Column:
    """The first decimal in a score text."""
    return F.try_to_number(F.regexp_extract(vector, r"(\d+\.\d+)", 1), F.lit("99.9")).cast("double")
