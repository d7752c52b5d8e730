"""Coverage reports, lock files and test output as tables. Each reader takes ``(path, text)`` rows, one per file."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import text as T


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(path, text, size, mtime)`` of all files under a folder; bytes that are no UTF-8 give a null text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def coverage_format(text: Column) -> Column:
    """``lcov``, ``cobertura``, ``jacoco`` or null."""
    return F.when(text.contains("end_of_record"), "lcov").when(text.contains("<coverage"), "cobertura").when(text.contains("<report"), "jacoco")


def lcov(reports: DataFrame) -> DataFrame:
    """``(report, path, line, hits)``: a record runs from ``SF:`` to ``end_of_record``, the next ``SF:`` or the end."""
    chunk = F.explode(F.slice(F.split("text", r"(?m)^\s*SF:"), 2, 1 << 30))
    rows = reports.select(F.col("path").alias("report"), chunk.alias("chunk"))
    body = F.get(F.split("chunk", r"(?m)^\s*end_of_record"), F.lit(0))
    name = T.normalize_path(T.trim(F.regexp_extract("chunk", r"^([^\r\n]*)", 1)))
    da = rows.select("report", name.alias("path"), F.explode(F.regexp_extract_all(body, F.lit(r"(?m)^\s*DA:(\d+,\d+)"), F.lit(1))).alias("da"))
    part = F.split("da", ",")
    return da.select("report", "path", part[0].try_cast("int").alias("line"), part[1].try_cast("bigint").alias("hits")).where("line > 0")


def _xml_rows(rows: Callable[[ElementTree.Element], Iterator[tuple]], kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for report, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    root = ElementTree.fromstring(text or "")
                except ElementTree.ParseError:
                    continue
                out += ((report, *r) for r in rows(root))
            columns = list(zip(*out, strict=True)) or [()] * (len(kinds) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, [pa.string(), *kinds], strict=True)], names=[f"c{i}" for i in range(len(kinds) + 1)])

    return run


def _number(text: str | None, default: int | None) -> int | None:
    return int(text) if text and re.fullmatch(r"\d{1,18}", text.strip()) else default


def _cobertura_lines(root: ElementTree.Element) -> Iterator[tuple]:
    for c in root.iter("class"):
        for line in c.iter("line") if c.get("filename") else ():
            if number := _number(line.get("number"), None):
                yield c.get("filename"), number, _number(line.get("hits"), 0)


def _jacoco_counters(root: ElementTree.Element) -> Iterator[tuple]:
    for c in root.iter("class"):
        counters = [x for x in c.iter("counter") if x.get("type") == "LINE"]
        if counters:
            missed, covered = (_number(counters[-1].get(k), 0) for k in ("missed", "covered"))
            yield c.get("sourcefilename") or c.get("name"), missed + covered, covered


def cobertura(reports: DataFrame) -> DataFrame:
    """``(report, path, line, hits)`` of the lines of each class, each once; a text that is no XML gives none."""
    rows = reports.select("path", "text").mapInArrow(_xml_rows(_cobertura_lines, [pa.string(), pa.int64(), pa.int64()]), "c0 string, c1 string, c2 long, c3 long")
    return rows.select(F.col("c0").alias("report"), T.normalize_path(F.col("c1")).alias("path"), F.col("c2").cast("int").alias("line"), F.col("c3").alias("hits")).distinct()


def jacoco(reports: DataFrame) -> DataFrame:
    """``(report, path, total, covered)``: the last line counter of each class; no line numbers are made up."""
    rows = reports.select("path", "text").mapInArrow(_xml_rows(_jacoco_counters, [pa.string(), pa.int64(), pa.int64()]), "c0 string, c1 string, c2 long, c3 long")
    return rows.select(F.col("c0").alias("report"), F.col("c1").alias("path"), F.col("c2").alias("total"), F.col("c3").alias("covered"))


def coverage_totals_by_file(reports: DataFrame, categories: dict[str, str] | None = None) -> DataFrame:
    """``(category, path, total, covered)`` of all reports of whatever format, added up by file; a report of none is passed over.

    ``categories`` gives the kind of a report by its path (unit or integration tests, say).
    """
    kinds = reports.withColumn("format", coverage_format(F.col("text")))
    of = lambda name: kinds.where(F.col("format") == name)
    lines = lcov(of("lcov")).unionByName(cobertura(of("cobertura")))
    counted = lines.groupBy("report", "path").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("hits") > 0).alias("covered"))
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in categories.items() for x in pair]), F.col("report")) if categories else F.lit(None).cast("string")
    every = counted.unionByName(jacoco(of("jacoco"))).withColumn("category", named)
    return every.groupBy("category", "path").agg(F.sum("total").alias("total"), F.sum("covered").alias("covered"))


def npm_packages(locks: DataFrame) -> DataFrame:
    """``(name, version, ecosystem, source_file)``: of ``dependencies``; only where there are none, of ``packages``. Local files are left out."""
    schema = "dependencies map<string, struct<version: string>>, packages map<string, struct<version: string>>"
    rows = locks.select("path", F.from_json("text", schema).alias("j"))
    entries = F.when(F.size("j.dependencies") > 0, F.col("j.dependencies")).otherwise(F.col("j.packages"))
    flat = rows.select("path", F.explode(entries).alias("key", "value"))
    name = F.regexp_replace("key", r"^.*node_modules/", "")
    found = flat.select(name.alias("name"), F.col("value.version").alias("version"), F.lit("npm").alias("ecosystem"), F.col("path").alias("source_file"))
    return found.where("name <> '' and version is not null and version not like 'file:%'")


def cargo_packages(locks: DataFrame) -> DataFrame:
    """Packages of ``[[package]]`` blocks that come from the public registry, and whatever their source those that another section or the end of the file closes."""
    blocks = F.slice(F.split("text", r"(?m)^[ \t]*\[\[package\]\][ \t]*\r?$"), 2, 1 << 30)
    rows = locks.select("path", F.size(blocks).alias("n"), F.posexplode(blocks).alias("i", "b"))
    value = lambda key: F.regexp_extract("own", rf"(?m)^\s*{key} = \"([^\"]*)\"", 1)
    section = F.col("b").rlike(r"(?m)^[ \t]*\[(?!\[)")
    rows = rows.withColumn("own", F.get(F.split("b", r"(?m)^[ \t]*\[(?!\[)"), F.lit(0))).withColumn("closed", section | (F.col("i") == F.col("n") - 1))
    found = rows.select(value("name").alias("name"), value("version").alias("version"), F.lit("crates.io").alias("ecosystem"), F.col("path").alias("source_file"), value("source").alias("s"), "closed")
    return found.where("name <> '' and version <> '' and (closed or s like '%crates.io%')").drop("s", "closed")


def go_packages(locks: DataFrame) -> DataFrame:
    """Distinct modules of ``go.sum`` without their ``/go.mod`` lines; versions without the leading ``v``."""
    rows = locks.select("path", F.explode(T.lines(F.col("text"))).alias("l")).select("path", F.split(T.trim(F.col("l")), r"\s+").alias("p")).where(F.size("p") >= 2)
    kept = rows.where(~F.endswith(F.col("p")[1], F.lit("/go.mod")))
    return kept.select(F.col("p")[0].alias("name"), F.regexp_replace(F.col("p")[1], "^v", "").alias("version"), F.lit("Go").alias("ecosystem"), F.col("path").alias("source_file")).distinct()


def pub_packages(locks: DataFrame) -> DataFrame:
    """Packages of ``pubspec.lock``: names indented by two, fields by four."""
    block = F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^  [A-Za-z_]\w*:[ \t]*\r?\n(?:    .*(?:\r?\n|$))+"), F.lit(0)))
    rows = locks.select("path", block.alias("b"))
    found = rows.select(
        F.regexp_extract("b", r"^  (\w+):", 1).alias("name"), F.regexp_extract("b", r"(?m)^    version: \"?([^\"\r\n]+)\"?", 1).alias("version"),
        F.lit("Pub").alias("ecosystem"), F.col("path").alias("source_file"),
    )
    return found.where("version <> ''")


def lock_packages(texts: DataFrame) -> DataFrame:
    """The packages of all lock files among ``(path, text)`` rows."""
    named = lambda name: texts.where(F.regexp_extract("path", r"([^/\\]*)$", 1) == name)
    parts = [npm_packages(named("package-lock.json")), cargo_packages(named("Cargo.lock")), go_packages(named("go.sum")), pub_packages(named("pubspec.lock"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def test_summary(outputs: DataFrame) -> DataFrame:
    """``(path, passed, failed, skipped, total)`` of test output: the line ``Tests: ...``, or passing and failing counts."""
    low = F.lower("text")
    line = F.regexp_extract(low, r"(?m)^.*tests:.*(?:passed|total).*$", 0)
    n = lambda where, word: F.coalesce(F.regexp_extract(where, rf"(\d+)\s+{word}", 1).try_cast("int"), F.lit(0))
    rows = outputs.select("path", low.alias("low"), line.alias("line"))
    jest = F.col("line") != ""
    passed = F.when(jest, n(F.col("line"), "passed")).otherwise(n(F.col("low"), "passing"))
    failed = F.when(jest, n(F.col("line"), "failed")).otherwise(n(F.col("low"), "failing"))
    skipped = F.when(jest, n(F.col("line"), "skipped")).otherwise(F.lit(0))
    total = F.when(jest & (n(F.col("line"), "total") > 0), n(F.col("line"), "total")).otherwise(passed + failed)
    return rows.select("path", passed.alias("passed"), failed.alias("failed"), skipped.alias("skipped"), total.alias("total"))


def test_cases(outputs: DataFrame) -> DataFrame:
    """``(report, file, name, status, duration_ms)`` of each test a text output names, with the file whose heading stands above it.

    The heading of a line is the last one before it, by position in the array of lines.
    """
    lines = F.transform(T.lines(F.col("text")), T.trim)
    rows = outputs.select(F.col("path").alias("report"), lines.alias("all"))
    headed = F.aggregate(
        "all", F.struct(F.lit(None).cast("string").alias("file"), F.array().cast("array<struct<file string, line string>>").alias("out")),
        lambda acc, x: F.when(x.rlike("^(?:PASS|FAIL) "), F.struct(T.trim(F.regexp_replace(F.substr(x, F.lit(6)), r" \(.*", "")).alias("file"), acc["out"].alias("out")))
        .when(x.rlike(_MARKS), F.struct(acc["file"].alias("file"), F.array_append(acc["out"], F.struct(acc["file"].alias("file"), x.alias("line"))).alias("out"))).otherwise(acc),
    )
    found = rows.select("report", F.explode(headed["out"]).alias("c")).select("report", "c.file", "c.line")
    mark, rest = F.regexp_extract("line", _MARKS, 1), T.trim(F.regexp_replace("line", _MARKS, ""))
    status = F.when(mark.isin("✓", "✅"), "passed").when(mark.isin("○", "◌", "SKIP"), "skipped").otherwise("failed")
    amount, unit = F.regexp_extract(rest, _TOOK, 1).try_cast("double"), F.regexp_extract(rest, _TOOK, 2)
    took = F.when(unit == "ms", amount).when(unit == "s", amount * 1000)
    return found.select("report", "file", F.regexp_replace(rest, r"\s*" + _TOOK, "").alias("name"), status.alias("status"), took.cast("long").alias("duration_ms"))


# The marks of passed, failed and skipped tests.
_MARKS = r"^(✓|✅|✕|✗|✘|●|○|◌|SKIP)"
_TOOK = r"\((\d+(?:\.\d+)?)\s*(ms|s)\)$"


def alerts(texts: DataFrame) -> DataFrame:
    """``(alert, severity, risk, cweid, instances)`` of the alerts of a web scan in JSON, each name once; the highest risk counts."""
    schema = "alerts array<struct<alert: string, riskcode: string, cweid: string, instances: array<struct<uri: string, method: string>>>>"
    rows = texts.select(F.explode(F.from_json("text", schema)["alerts"]).alias("a")).where("a.alert is not null")
    risk = F.coalesce(F.col("a.riskcode").try_cast("int"), F.lit(0))
    one = rows.select("a.alert", risk.alias("risk"), F.coalesce(F.col("a.cweid").try_cast("int"), F.lit(0)).alias("cweid"), F.coalesce(F.size("a.instances"), F.lit(0)).alias("instances"))
    one = one.groupBy("alert").agg(F.max(F.struct("risk", "cweid", "instances")).alias("m")).select("alert", "m.*")
    severity = F.when(F.col("risk") == 3, "blocker").when(F.col("risk") == 2, "critical").when(F.col("risk") == 1, "major").when(F.col("risk") == 0, "info").otherwise("minor")
    return one.select("alert", severity.alias("severity"), "risk", "cweid", "instances")


def sarif_issues(texts: DataFrame) -> DataFrame:
    """``(path, line, rule_id, level, message)`` of the results of SARIF documents: of their first run."""
    place = "physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>"
    schema = f"runs array<struct<results: array<struct<ruleId: string, level: string, message: struct<text: string>, locations: array<struct<{place}>>>>>>"
    rows = texts.select(F.explode(F.from_json("text", schema)["runs"][0]["results"]).alias("r"))
    at = F.get("r.locations", F.lit(0))["physicalLocation"]
    return rows.select(at["artifactLocation"]["uri"].alias("path"), at["region"]["startLine"].alias("line"), F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level"), F.col("r.message.text").alias("message"))
