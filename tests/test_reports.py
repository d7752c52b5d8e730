"""Reports, listings, selections and gates."""

import json

import pytest
from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.operators import dependencies, diffs, quality, rules, snapshots, sourcefiles, treerules
from codelode.session import scratch_dir
from codelode.sources import reports, sinks

ISSUES = "file_id long, path string, line int, rule_id string, severity string, start_column int, end_line int"


def issues(spark):
    return spark.createDataFrame([(1, "a.ts", 3, "no-eval", "blocker", 5, 4), (2, "b<.ts", 1, "no-var", "major", 1, 1)], ISSUES)


def test_sarif_goes_out_and_comes_back(spark, collect):
    found = issues(spark)
    region = json.loads(quality.sarif_results(found).where("file_id = 1").first()["result"])["locations"][0]["physicalLocation"]["region"]
    assert region == {"startLine": 3, "endLine": 4, "startColumn": 5}
    text = spark.createDataFrame([("r", sinks.sarif(found, "x"))], "path string, text string")
    assert [r[:4] for r in collect(reports.sarif_issues(text))] == [("a.ts", 3, "no-eval", "error"), ("b<.ts", 1, "no-var", "warning")]


def test_reports_for_people(spark):
    metrics = spark.createDataFrame([("typescript", 2, 10)], "language string, files long, code long")
    page = sinks.html_report("A & B", issues(spark), metrics, metrics.limit(1))
    assert "A &amp; B" in page and "b&lt;.ts" in page and "<h2>Duplicates</h2>" in page and "Least covered" not in page
    assert "no-eval" in sinks.text_report(issues(spark), metrics)
    scan = sinks.json_report(issues(spark), metrics, ratings=metrics)
    assert json.loads(scan)["ratings"][0]["files"] == 2
    found = spark.createDataFrame([("npm", "p", "1", "X-1", "critical"), ("npm", "p", "1", "X-2", "info")], "ecosystem string, name string, version string, osv_id string, severity string")
    packages = spark.createDataFrame([("npm", "p", "1", "package-lock.json")], "ecosystem string, name string, version string, source_file string")
    deps = sinks.dependency_json(found, packages)
    assert json.loads(deps)["summary"]["critical"] == 1 and [v["osv_id"] for v in json.loads(deps)["vulnerabilities"]] == ["X-2", "X-1"]
    assert "## Dependencies" in sinks.combined_comment(scan, deps) and "no-eval" in sinks.combined_comment(scan)
    alerts = reports.alerts(spark.createDataFrame([("z", '{"alerts": [{"alert": "A", "riskcode": "2"}]}'), ("bad", "{"), ("none", None)], "path string, text string"))
    assert json.loads(sinks.alerts_json(alerts, "t"))["alerts"][0]["severity"] == "critical"
    assert sinks.rules_listing(spark).count() == len(rules.RULES) + len(treerules.SEVERITIES) + len(rules.LIMITS)
    assert {r["rule_id"] for r in sinks.rules_listing(spark, "rust").collect()} == {r.id for r in rules.RULES if r.language == "rust"}


def test_snapshots_of_nothing(spark, tmp_path):
    empty = sinks.read_snapshot(spark, str(tmp_path / "none"), "path string, hash string")
    assert empty.count() == 0 and empty.columns == ["path", "hash"]
    now = spark.createDataFrame([("a", "1")], "path string, hash string")
    sinks.write_snapshot(now, str(tmp_path / "s"), "t1")
    sinks.write_snapshot(now.withColumn("hash", F.lit("2")), str(tmp_path / "s"), "t2")
    assert [tuple(r) for r in sinks.read_snapshot(spark, str(tmp_path / "s"), "path string, hash string").collect()] == [("a", "2")]
    todo, same = snapshots.unchanged_split(now, empty)
    assert todo.count() == 1 and same.count() == 0


def test_gates(spark, collect):
    none = spark.createDataFrame([], "check string, value double, threshold double, passed boolean")
    assert collect(quality.verdict(none)) == [("gate", 0.0, 0.0, True)]
    ratings = spark.createDataFrame([("security", "D"), ("reliability", "A")], "kind string, rating string")
    assert {r["check"]: r["passed"] for r in quality.verdict(quality.rating_checks(ratings, "C")).collect()} == {"security_rating": False, "reliability_rating": True, "gate": False}
    zero = spark.createDataFrame([(0, 0.0)], "total long, percent double")
    assert quality.coverage_check("c", zero, 80.0).count() == 0
    assert {r["severity"]: r["issues"] for r in dependencies.by_severity(issues(spark)).collect()} == {"blocker": 1, "critical": 0, "major": 1, "minor": 0, "info": 0}


def test_selection_of_issues(spark):
    found = issues(spark).withColumn("key", F.col("rule_id"))
    new = spark.createDataFrame([("a.ts", "no-eval")], "path string, key string")
    recent = spark.createDataFrame([("b<.ts",)], "path string")
    counts = [quality.selected(found, n, m).count() for n, m in ((None, None), (new, None), (None, recent), (new, recent))]
    assert counts == [2, 1, 1, 2] and quality.selected(found, new).columns.count("path") == 1
    assert tuple(quality.significant_split(found, F.col("path").startswith("a")).first()) == (1, 1)


def test_texts_of_tools(spark):
    rows = spark.createDataFrame([("x\n```ts\nlet a\n```\n```\nb\n```",), ("none",), ("=== FILE: a/b.ts ===\none\ntwo\n=== FILE: c.ts ===\nthree",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.first_code_block(F.col("t"))).collect()] == ["let a\n", None, None, None]
    sections = rows.select(T.file_sections(F.col("t"))).collect()[2][0]
    assert [(s["path"], s["text"]) for s in sections] == [("a/b.ts", "one\ntwo\n"), ("c.ts", "three")]
    assert [r[0] for r in spark.createDataFrame([(" a b \t",)], "t string").select(T.trim(F.col("t"))).collect()] == ["a b"]
    assert [r[0] for r in spark.createDataFrame([("_a1",), ("1a",), ("a-b",)], "t string").select(T.is_identifier(F.col("t"))).collect()] == [True, False, False]


def test_one_file_and_ignore_files(spark):
    files = spark.createDataFrame([(1, "src\\a.ts", "x"), (2, "src/b.ts", "x"), (3, "out/c.ts", "x")], "file_id long, path string, text string")
    assert [r["file_id"] for r in sourcefiles.single_file(files, "src/a.ts").collect()] == [1]
    assert [r["file_id"] for r in sourcefiles.discover(files, ignored=["out"]).collect()] == [2, 1]


def test_diffs_as_text(spark, collect):
    pairs = spark.createDataFrame([("a", "1\n2\n", "1\n3\n"), ("b", None, "x"), ("c", "x", "x"), ("d", None, None)], "path string, old string, new string")
    assert collect(diffs.unified(pairs)) == [("a", "--- a\n+++ a\n 1\n-2\n+3"), ("b", "--- b\n+++ b\n+x")]


def test_a_cluster_must_name_its_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(RuntimeError):
        scratch_dir(Session())
