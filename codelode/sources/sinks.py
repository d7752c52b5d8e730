"""Reports: JSON, SARIF, markdown and HTML, and snapshots as tables."""

from __future__ import annotations

import json
from html import escape

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.operators import dependencies, quality, rules, taint, treerules
from codelode.operators.structure import WEB


def write_snapshot(files: DataFrame, folder: str, scan_time: str) -> None:
    """``files(path, hash, ...)`` as one partition of a snapshot table; a run of the same time is replaced, others stay."""
    stamped = files.withColumn("scan_time", F.lit(scan_time))
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_time").parquet(folder)


def read_snapshot(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The latest snapshot in a folder, or an empty table of ``schema`` where there is none that can be read."""
    try:
        rows = spark.read.parquet(folder)
        latest = rows.agg(F.max("scan_time")).first()[0]
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.where(F.col("scan_time") == latest).drop("scan_time")


def rules_listing(spark: SparkSession, language: str | None = None) -> DataFrame:
    """``(rule_id, severity, languages)`` of all rules, or of those of a language."""
    rows: dict[str, tuple[str, set[str]]] = {}
    for r in rules.RULES:
        rows.setdefault(r.id, (r.severity, set()))[1].add(r.language)
    for table in (treerules.TREE_RULES, treerules.TEXT_RULES):
        for name, (severity, languages, _) in table.items():
            rows.setdefault(name, (severity, set()))[1].update(languages)
    for name in taint.SEVERITIES:
        rows[name] = (taint.SEVERITIES[name], {"dart"} if name in taint.DART_CLASSES else set(WEB))
    for name, severity in rules.LIMITS.items():
        rows[name] = (severity, {*WEB, "dart"} if name != "max-function-lines" else {"typescript", "tsx"})
    every = spark.createDataFrame([(k, s, sorted(v)) for k, (s, v) in sorted(rows.items())], "rule_id string, severity string, languages array<string>")
    return every.where(F.array_contains("languages", language)) if language else every


def dependency_json(found: DataFrame, packages: DataFrame) -> str:
    """Counts and the vulnerabilities of each ecosystem in the order of a report."""
    rows = dependencies.listed(found).orderBy("ecosystem", "position").drop("position")
    counts = {r["severity"]: r["issues"] for r in dependencies.by_severity(found).collect()}
    return json.dumps({"summary": {**counts, **dependencies.lock_files(packages).first().asDict()}, "vulnerabilities": [r.asDict() for r in rows.toLocalIterator()]})


def alerts_json(found: DataFrame, target: str) -> str:
    """Counts and the alerts of a web scan, the gravest first."""
    counts = {r["severity"]: r["issues"] for r in dependencies.by_severity(found).collect()}
    return json.dumps({"target": target, "summary": counts, "alerts": [r.asDict() for r in found.orderBy(F.desc("risk"), "alert").toLocalIterator()]})


def text_report(issues: DataFrame, metrics: DataFrame) -> str:
    """What a terminal shows: languages, issues by severity, the rules with most issues and the first ten issues."""
    out = ["Languages"]
    out += [f"  {r['language'] or 'other':<12} {r['files']:>8} files {r['code']:>10} lines of code" for r in metrics.orderBy(F.desc("files"), "language").toLocalIterator()]
    out += ["Issues", *(f"  {r['severity']:<10} {r['issues']:>8}" for r in quality.severity_counts(issues).collect())]
    out += ["Top rules", *(f"  {r['rule_id']:<32} {r['issues']:>8}" for r in quality.top_rules(issues).collect())]
    out += ["Top issues", *(f"  {r['severity']:<10} {r['path']}:{r['line']} {r['rule_id']}" for r in quality.top_issues(issues).collect())]
    return "\n".join(out) + "\n"


def html_report(title: str, issues: DataFrame, metrics: DataFrame, blocks: DataFrame | None = None, lowest: DataFrame | None = None) -> str:
    """One page: a table for the languages, the issues by severity, the first ten, and the largest duplicates and least covered files if they are given."""
    tables = [("Languages", metrics.orderBy(F.desc("files"), "language")), ("Issues", quality.severity_counts(issues)), ("Top issues", quality.top_issues(issues))]
    tables += [(name, x.limit(10)) for name, x in (("Duplicates", blocks), ("Least covered", lowest)) if x is not None]
    escaped = lambda v: escape("" if v is None else str(v))
    parts = [f"<!doctype html><html><head><meta charset='utf-8'><title>{escaped(title)}</title></head><body><h1>{escaped(title)}</h1>"]
    for name, rows in tables:
        head = "".join(f"<th>{escaped(c)}</th>" for c in rows.columns)
        body = "".join("<tr>" + "".join(f"<td>{escaped(v)}</td>" for v in r) + "</tr>" for r in rows.collect())
        parts.append(f"<h2>{escaped(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "".join([*parts, "</body></html>"])


def combined_comment(scan: str, dependency: str | None = None) -> str:
    """A comment on a change from the JSON of a scan and that of its dependencies."""
    report = json.loads(scan)
    out = ["## Scan", "", "| severity | issues |", "|---|---|", *(f"| {k} | {v} |" for k, v in report.get("issues", {}).items())]
    out += ["", *(f"- `{r['path']}:{r['line']}` {r['severity']} {r['rule_id']}" for r in report.get("top_issues", [])[:10])]
    if dependency:
        deps = json.loads(dependency)
        out += ["", "## Dependencies", "", "| severity | vulnerabilities |", "|---|---|", *(f"| {k} | {v} |" for k, v in deps["summary"].items() if k in T.SEVERITIES)]
    return "\n".join(out)


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def sarif(issues: DataFrame, tool: str, limit: int = 25_000) -> str:
    """A SARIF 2.1.0 document of the first ``limit`` issues by severity and place; write ``quality.sarif_results`` for all of any number."""
    first = quality.top_issues(issues, limit)
    results = [r["result"] for r in quality.sarif_results(first.withColumn("file_id", F.lit(0))).select("result").toLocalIterator()]
    rules = [{"id": r["rule_id"], "defaultConfiguration": {"level": r["level"]}} for r in quality.sarif_rules(issues).collect()]
    run = {"tool": {"driver": {"name": tool, "rules": rules}}, "results": [json.loads(r) for r in results]}
    return json.dumps({"version": "2.1.0", "runs": [run]})


def markdown_comment(issues: DataFrame, passed: bool) -> str:
    """Counts by severity, the first ten issues and whether the gate passed."""
    counts = {r["severity"]: r["issues"] for r in quality.severity_counts(issues).collect()}
    lines = [f"## Quality gate {'passed' if passed else 'failed'}", "", "| severity | issues |", "|---|---|", *[f"| {k} | {v} |" for k, v in counts.items()], ""]
    lines += [f"- `{r['path']}:{r['line']}` {r['severity']} {r['rule_id']}" for r in quality.top_issues(issues).collect()]
    return "\n".join(lines)


def json_report(issues: DataFrame, metrics: DataFrame, **more: DataFrame) -> str:
    """One nested document: totals of the metrics by language, issues by severity and rule, the first ten issues, and the rows of small
    tables by name (ratings, duplication, coverage)."""
    return json.dumps(
        {
            **{name: [r.asDict(True) for r in x.collect()] for name, x in more.items()},
            "metrics": [r.asDict() for r in metrics.collect()], "issues": {r["severity"]: r["issues"] for r in quality.severity_counts(issues).collect()},
            "rules": [r.asDict() for r in quality.top_rules(issues, 200).collect()], "top_issues": [r.asDict() for r in quality.top_issues(issues).collect()],
        }
    )
