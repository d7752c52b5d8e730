"""Readers, settings, sinks, the stream and the driver's entry."""

import json
import subprocess
import sys
from pathlib import Path

from codelode.operators import quality, sourcefiles
from codelode.sources import reports, settings, sinks
from codelode.streaming import watch

ROOT = Path(__file__).resolve().parents[1]


def texts(spark, *pairs):
    return spark.createDataFrame(list(pairs), "path string, text string")


def test_lcov(spark, collect):
    text = "TN:\nSF:src\\a.ts\nDA:1,5\nDA:2,0\nDA:x,1\nLF:2\nend_of_record\nDA:9,9\nSF:b.ts\nDA:1,0,abc\n"
    assert collect(reports.lcov(texts(spark, ("r", text), ("n", None), ("e", "")))) == [("r", "b.ts", 1, 0), ("r", "src/a.ts", 1, 5), ("r", "src/a.ts", 2, 0)]


def test_xml_reports(spark, collect):
    cobertura = '<coverage><class name="A" filename="a.ts"><lines><line number="1" hits="3"/><line hits="0" number="2"/></lines></class><class filename="b.ts"></class></coverage>'
    assert collect(reports.cobertura(texts(spark, ("r", cobertura)))) == [("r", "a.ts", 1, 3), ("r", "a.ts", 2, 0)]
    jacoco = '<report><class name="x/A" sourcefilename="A.java"><method><counter type="LINE" missed="1" covered="1"/></method><counter type="LINE" missed="2" covered="6"/></class><class name="x/B"><counter type="BRANCH" missed="1" covered="1"/></class></report>'
    assert collect(reports.jacoco(texts(spark, ("r", jacoco)))) == [("r", "A.java", 8, 6)]
    kinds = texts(spark, ("a", "x end_of_record"), ("b", "<coverage>"), ("c", "<report>"), ("d", "?"))
    assert [r[0] for r in kinds.select(reports.coverage_format(kinds["text"])).collect()] == ["lcov", "cobertura", "jacoco", None]


def test_lock_files(spark, collect):
    npm = json.dumps({"dependencies": {}, "packages": {"": {"version": "0"}, "node_modules/a": {"version": "1.0.0"}, "node_modules/b": {"version": "file:../b"}}})
    cargo = '[[package]]\nname = "quartz"\nversion = "1.0.1"\nsource = "registry+https://registry.example/crates.io-index"\n\n[[package]]\nname = "tree"\nversion = "0.2.0"\n\n[[package]]\nname = "own"\nversion = "0.1.0"\n'
    go = "x.example/m v1.2.3 h1:a=\nx.example/m v1.2.3/go.mod h1:b=\n"
    pub = "packages:\n  http:\n    dependency: direct\n    version: \"0.13.4\"\n  path:\n    version: \"1.8.0\"\nsdks:\n  dart: x\n"
    df = texts(spark, ("p/package-lock.json", npm), ("Cargo.lock", cargo), ("go.sum", go), ("pubspec.lock", pub), ("other", npm))
    assert [r[:3] for r in collect(reports.lock_packages(df))] == [("a", "1.0.0", "npm"), ("http", "0.13.4", "Pub"), ("own", "0.1.0", "crates.io"), ("path", "1.8.0", "Pub"), ("quartz", "1.0.1", "crates.io"), ("x.example/m", "1.2.3", "Go")]


def test_test_output(spark, collect):
    df = texts(spark, ("jest", "PASS a\nTests:       2 failed, 1 skipped, 5 passed, 8 total\n"), ("mocha", "  5 passing (2s)\n  1 failing\n"), ("none", "hello"))
    assert collect(reports.test_summary(df)) == [("jest", 5, 2, 1, 8), ("mocha", 5, 1, 0, 6), ("none", 0, 0, 0, 0)]


def test_texts_of_a_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.ts").write_text("let a\n")
    (tmp_path / "b.ts").write_bytes(b"\xff\xfe")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in reports.read_texts(spark, str(tmp_path), "*.ts").collect()}
    assert got == {"x.ts": "let a\n", "b.ts": None}


def test_settings():
    got = settings.load('[duplication]\nmin_tokens = 50\n[x]\ny = 1\n', "sonar.exclusions=a/**, b\n#sonar.inclusions=c\n")
    assert got["duplication"]["min_tokens"] == 50 and got["duplication"]["mode"] == "sonar" and got["scan"]["exclude"] == ["a/**", "b"] and got["scan"]["include"] == []
    assert settings.load()["coverage"]["fail_below_percent"] == 80.0 and settings.ignore_patterns("# a\n\nb\n") == ["b"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a.ts", 'eval(x) // <"&>\n')], "file_id long, path string, text string")
    found = quality.all_issues(df)
    document = json.loads(sinks.sarif(found, "codelode"))
    assert document["version"] == "2.1.0" and document["runs"][0]["results"][0]["level"] == "error"
    assert "no-eval" in sinks.markdown_comment(found, False) and json.loads(sinks.json_report(found, sourcefiles.metrics_by_language(df)))["issues"]["blocker"] == 1
    assert df.select(sinks.html_escape(df["text"])).first()[0] == "eval(x) // &lt;&quot;&amp;&gt;\n"
    assert quality.top_issues(found).first()["severity"] == "blocker"
    sinks.write_snapshot(df.select("path"), str(tmp_path / "s"), "t1")
    sinks.write_snapshot(df.select("path"), str(tmp_path / "s"), "t2")
    sinks.write_snapshot(df.select("path"), str(tmp_path / "s"), "t2")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_the_stream_gives_what_the_batch_does(spark, tmp_path, collect):
    rows = [(i, f"2031-01-01 {h:02d}:{m:02d}:00", u) for i, (u, h, m) in enumerate([(1, 0, 0), (1, 1, 30), (1, 4, 0), (2, 0, 0), (None, 1, 0)])]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id")
    for k in range(2):
        df.where(f"event_id % 2 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    streamed = collect(watch.bursts_streamed(spark, str(tmp_path / "events.parquet")))
    assert streamed == collect(watch.bursts(df)) and [r[3] for r in streamed] == [2, 1, 1]


def test_every_query_has_its_columns_and_runs_without_the_optional_package(tmp_path):
    code = (
        "import sys; sys.modules['codelode.llm'] = None\nimport __spark_entry__ as e\n"
        "q, s = e.queries(), e.oracle_sql()\nassert len(q) > 50 and not any(n.startswith('p1') for n in q) and set(s) <= set(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
