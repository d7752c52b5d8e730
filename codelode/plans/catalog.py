"""The registered queries over the project's own operators, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.operators import clones, complexity, coverage, dependencies, diffs, duplication, metrics, quality, rules, snapshots, tokenize, treerules
from codelode.operators import sourcefiles as S
from codelode.plans import oracles, samples
from codelode.plans.snippets import SNIPPETS
from codelode.session import cut, load
from codelode.sources import reports, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CUSTOM_RULES = [
    ("todo", "minor", [], r"TODO: \w+", "open task: $0"),
    ("null-compare", "weird", ["typescript", "javascript"], r"=== null", None),
    ("none-compare", "major", ["python"], r"is (?:not )?None", "compare: $0"),
    ("modulo", "info", [], r"% \d+", "modulo $0"),
    ("modulo", "blocker", [], r"zzz", "a second rule of one id"),
    ("look", "major", [], r"(?=a)b", "lookahead is rejected"),
]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _files(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "files")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return duplication.clean_tokens(load(spark, d, "tokens"), _files(spark, d))


def _issues(spark: SparkSession, d: str) -> DataFrame:
    return quality.all_issues(_files(spark, d), load(spark, d, "functions"))


def _coverage_lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as coverage lines: an order is a file, its category the return flag, and more than 25 pieces are a hit."""
    return load(spark, d, "lineitem").select(
        F.concat(F.lit("src/"), F.col("l_orderkey").cast("string"), F.lit(".ts")).alias("path"), F.col("l_linenumber").alias("line"),
        (F.col("l_quantity") >= 25).cast("long").alias("hits"), F.col("l_returnflag").alias("category"), F.col("l_suppkey").alias("commit"),
    )


def _event_snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each user's last event up to the middle and the end of the stream, as two snapshots."""
    events = load(spark, d, "events").where("user_id is not null")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = events.agg((F.min(at) / 2 + F.max(at) / 2).alias("middle"))
    marked = events.join(F.broadcast(bounds)).withColumn("early", at <= F.col("middle"))  # one row
    last = lambda x: x.groupBy(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("path")).agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("hash")
    )
    return last(marked.where("early")), last(marked)


def _event_issues(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Event types by user in the first and in the second half of the stream, as the issues of two runs."""
    events = load(spark, d, "events").where("user_id is not null")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = events.agg((F.min(at) / 2 + F.max(at) / 2).alias("middle"))
    marked = events.join(F.broadcast(bounds)).withColumn("early", at <= F.col("middle"))  # one row
    rows = marked.select(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("path"), F.concat_ws(":", "event_type", F.hour("ts")).alias("key"), "early")
    return rows.where("early").drop("early"), rows.where("not early").drop("early")


@query
def language_metrics(spark, d):
    return S.metrics_by_language(_files(spark, d))


@query
def file_line_metrics(spark, d):
    return S.metrics_by_file(_files(spark, d))


@query
def language_histogram(spark, d):
    return metrics.language_histogram(_files(spark, d))


@query
def nosonar_by_file(spark, d):
    return S.nosonar_counts(_files(spark, d))


@query
def path_predicates(spark, d):
    rows = S.once(_files(spark, d), "path")
    return rows.select(
        "file_id", S.language_of(F.col("path")).alias("language"), T.extension(F.col("path")).alias("ext"),
        S.is_test_or_generated(F.col("path")).alias("excluded"), S.duplication_eligible(F.col("path")).alias("eligible"),
    )


@query
def discovered_files(spark, d):
    found = S.discover(_files(spark, d), ["src/**", "**/lib/**/*.{rs,go}", "pkg"], ["**/vendors/**", "**/*_generator.*"], tests=False)
    return found.select("file_id", "path").distinct()


@query
def project_metrics(spark, d):
    return metrics.project_metrics(_files(spark, d), load(spark, d, "functions"))


@query
def comment_density(spark, d):
    return metrics.comment_density(_files(spark, d))


@query
def complexity_histogram(spark, d):
    return metrics.complexity_histogram(load(spark, d, "functions"))


@query
def recently_modified(spark, d):
    return metrics.recently_modified(_files(spark, d), 365, "2031-06-30 00:00:00")


@query
def scan_settings(spark, d):
    return metrics.scan_settings(load(spark, d, "scans"))


@query
def line_rule_issues(spark, d):
    return rules.issues(_files(spark, d))


@query
def all_issues(spark, d):
    return _issues(spark, d)


@query
def rule_counts(spark, d):
    return _issues(spark, d).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("issues"))


@query
def severity_counts(spark, d):
    return quality.severity_counts(_issues(spark, d))


@query
def top_rules(spark, d):
    return quality.top_rules(_issues(spark, d))


@query
def top_issues(spark, d):
    return quality.top_issues(_issues(spark, d))


@query
def quality_ratings(spark, d):
    return quality.ratings(_issues(spark, d), _files(spark, d))


@query
def sarif_rules(spark, d):
    return quality.sarif_rules(_issues(spark, d))


@query
def custom_rule_issues(spark, d):
    table = spark.createDataFrame(CUSTOM_RULES, "id string, severity string, languages array<string>, pattern string, message string")
    return rules.custom_issues(_files(spark, d), table)


@query
def function_limits(spark, d):
    return rules.function_limits(load(spark, d, "functions"), _files(spark, d))


@query
def token_shingles(spark, d):
    counted = duplication.shingles(_tokens(spark, d)).groupBy("hash").agg(F.count(F.lit(1)).alias("places"), F.countDistinct("file_id").alias("files"))
    return counted.where("files > 1")


@query
def winnowed_fingerprints(spark, d):
    return duplication.winnow(duplication.shingles(_tokens(spark, d)))


@query
def token_duplication(spark, d):
    return duplication.duplication_totals(_tokens(spark, d))


@query
def shared_fingerprints(spark, d):
    return duplication.shared_fingerprints(_tokens(spark, d))


@query
def collapsed_lines(spark, d):
    kept = duplication.collapse_runs(duplication.token_lines(_tokens(spark, d)))
    return kept.groupBy("file_id").agg(F.count(F.lit(1)).alias("lines"), F.max("line").alias("last_line"))


@query
def repeated_blocks(spark, d):
    blocks = duplication.line_blocks(duplication.collapse_runs(duplication.token_lines(_tokens(spark, d))))
    return blocks.groupBy("hash").agg(F.count(F.lit(1)).alias("places"), F.countDistinct("file_id").alias("files")).where("places > 1")


@query
def duplicated_runs(spark, d):
    return duplication.duplicated_runs(_tokens(spark, d))


@query
def duplication_density(spark, d):
    return duplication.duplication_density(_tokens(spark, d))


@query
def clone_groups(spark, d):
    """Clone groups with their parts, named by their first place, as group ids are hashes."""
    parts = clones.clone_parts(_tokens(spark, d))
    first = parts.groupBy("group_id").agg(F.min(F.struct("file_id", "start_line")).alias("f"))
    groups = clones.clone_groups(parts).join(first, "group_id")
    return groups.select(F.col("f.file_id").alias("first_file"), F.col("f.start_line").alias("first_line"), "parts", "files", "blocks", "lines")


@query
def normalized_clone_groups(spark, d):
    """The same with identifiers taken as alike."""
    parts = clones.clone_parts(_tokens(spark, d), normalize_identifiers=True)
    return clones.clone_groups(parts).groupBy("parts", "files", "blocks", "lines").agg(F.count(F.lit(1)).alias("groups"))


@query
def top_blocks(spark, d):
    return clones.top_blocks(clones.clone_parts(_tokens(spark, d)))


@query
def file_pairs(spark, d):
    return clones.file_pairs(clones.fingerprints(_tokens(spark, d)))


@query
def fingerprint_blocks(spark, d):
    prints = cut(clones.fingerprints(_tokens(spark, d)), "prints")
    return clones.undominated(clones.fingerprint_blocks(prints, _tokens(spark, d), clones.file_pairs(prints)))


@query
def fingerprint_runs(spark, d):
    prints = cut(clones.fingerprints(_tokens(spark, d)), "prints")
    return clones.fingerprint_blocks(prints, _tokens(spark, d), clones.file_pairs(prints))


@query
def legacy_pairs(spark, d):
    tokens = _tokens(spark, d)
    return clones.legacy_pairs(tokens, clones.file_pairs(clones.fingerprints(tokens)))


@query
def duplication_report(spark, d):
    """Both modes, and lines with identifiers taken as alike."""
    tokens = _tokens(spark, d)
    alike = duplication.duplication_report(tokens, "line", normalize_identifiers=True).withColumn("mode", F.lit("sonar-normalized"))
    return duplication.duplication_report(tokens, "token").unionByName(duplication.duplication_report(tokens, "sonar-compat")).unionByName(alike)


@query
def function_shapes(spark, d):
    """Functions read from the texts, as far as the scan lists them with a complexity."""
    listed = load(spark, d, "functions").where("complexity is not null").select("file_id", "name", "start_line").distinct()
    found = metrics.function_shapes(_files(spark, d)).join(listed, ["file_id", "name", "start_line"], "left_semi")
    return found.select("file_id", "name", "start_line", "end_line", "cyclomatic", "parameters")


@query
def file_shapes(spark, d):
    return metrics.file_shapes(_files(spark, d)).select("file_id", F.size("functions").alias("functions"), "classes", "interfaces", "aliases", "enums", "complexity")


@query
def file_counts(spark, d):
    """Functions, classes and complexity read from the texts, of the files for which the scan counts functions."""
    counted = load(spark, d, "files").where("function_count > 0 and class_count is not null and cyclomatic_complexity is not null").select("file_id").distinct()
    found = metrics.file_shapes(_files(spark, d)).join(counted, "file_id", "left_semi")
    return found.select("file_id", F.size("functions").alias("functions"), "classes", "complexity")


@query
def reported_blocks(spark, d):
    return duplication.reported_blocks(load(spark, d, "duplicate_blocks"))


@query
def coverage_by_file(spark, d):
    return coverage.by_file(_coverage_lines(spark, d))


@query
def coverage_totals(spark, d):
    return coverage.totals(_coverage_lines(spark, d))


@query
def coverage_by_category(spark, d):
    return coverage.totals(_coverage_lines(spark, d), "category")


@query
def coverage_lowest(spark, d):
    return coverage.lowest(_coverage_lines(spark, d))


@query
def new_code_coverage(spark, d):
    lines = _coverage_lines(spark, d)
    recent = load(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("commit"))
    return coverage.new_code(lines, lines.select("path", "line", "commit"), recent)


@query
def snapshot_status(spark, d):
    return snapshots.file_status(*_event_snapshots(spark, d))


@query
def issue_lifecycle(spark, d):
    return snapshots.issue_lifecycle(*_event_issues(spark, d))


@query
def lifecycle_counts(spark, d):
    return snapshots.issue_lifecycle(*_event_issues(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("issues"))


@query
def advisory_severity(spark, d):
    return dependencies.severity_by_ecosystem(load(spark, d, "advisories"))


@query
def packages_at_risk(spark, d):
    return dependencies.packages_at_risk(load(spark, d, "advisories"))


@query
def package_vulnerabilities(spark, d):
    advisories = load(spark, d, "advisories")
    return dependencies.vulnerabilities(advisories.where("cvss >= 4").select("ecosystem", "name", "version"), advisories)


def _gate(spark, d, issues):
    counts = quality.severity_counts(issues).where("severity in ('blocker', 'critical')")
    values = counts.select(F.concat("severity", F.lit("_issues")).alias("check"), F.col("issues").cast("double").alias("value"))
    cov = coverage.totals(_coverage_lines(spark, d)).select(F.lit("coverage").alias("check"), F.col("percent").alias("value"))
    dup = duplication.duplication_totals(_tokens(spark, d)).select(F.lit("duplication").alias("check"), F.col("percent").alias("value"))
    limits = {"blocker_issues": ("max", 0), "critical_issues": ("max", 0), "coverage": ("min", 80), "duplication": ("max", 3)}
    return quality.gate(values.unionByName(cov).unionByName(dup), limits)


@query
def quality_gate(spark, d):
    return _gate(spark, d, _issues(spark, d))


def _snippets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, path, text) for i, (path, text, _) in enumerate(SNIPPETS)], "file_id long, path string, text string")


@query
def rule_snippets(spark, d):
    """All rules over texts whose issues are known by hand."""
    return quality.all_issues(_snippets(spark))


@query
def snippet_rule_counts(spark, d):
    return quality.all_issues(_snippets(spark)).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("issues"))


@query
def snippet_severity_counts(spark, d):
    return quality.severity_counts(quality.all_issues(_snippets(spark)))


@query
def snippet_top_rules(spark, d):
    return quality.top_rules(quality.all_issues(_snippets(spark)))


@query
def snippet_top_issues(spark, d):
    return quality.top_issues(quality.all_issues(_snippets(spark)))


@query
def snippet_quality_ratings(spark, d):
    return quality.ratings(quality.all_issues(_snippets(spark)), _snippets(spark))


@query
def snippet_sarif_rules(spark, d):
    return quality.sarif_rules(quality.all_issues(_snippets(spark)))


@query
def snippet_quality_gate(spark, d):
    return _gate(spark, d, quality.all_issues(_snippets(spark)))


def _texts(spark: SparkSession, *names: str) -> DataFrame:
    rows = [(p, t) for p, t in samples.TEXTS if not names or p in names]
    return spark.createDataFrame(rows, "path string, text string")


@query
def read_lcov(spark, d):
    return reports.lcov(_texts(spark, "unit/lcov.info"))


@query
def read_cobertura(spark, d):
    return reports.cobertura(_texts(spark, "it/cobertura.xml", "it/broken.xml"))


@query
def read_jacoco(spark, d):
    return reports.jacoco(_texts(spark, "it/jacoco.xml"))


@query
def read_coverage(spark, d):
    """All reports of whatever format, by kind and file."""
    return reports.coverage_totals_by_file(_texts(spark), samples.CATEGORIES)


@query
def read_coverage_kept(spark, d):
    """Line coverage without test files."""
    lines = reports.lcov(_texts(spark, "unit/lcov.info"))
    return coverage.totals(coverage.excluding(lines, ["**/*.spec.ts"]))


@query
def coverage_formats(spark, d):
    return _texts(spark).select("path", reports.coverage_format(F.col("text")).alias("format"))


@query
def read_locks(spark, d):
    return reports.lock_packages(_texts(spark))


@query
def read_lock_files(spark, d):
    return dependencies.lock_files(reports.lock_packages(_texts(spark)))


@query
def read_test_cases(spark, d):
    return reports.test_cases(_texts(spark, "out/jest.txt"))


@query
def read_test_summary(spark, d):
    return reports.test_summary(_texts(spark, "out/jest.txt"))


@query
def read_alerts(spark, d):
    return reports.alerts(_texts(spark, "zap.json"))


@query
def alert_gate(spark, d):
    return quality.verdict(quality.severity_checks(dependencies.by_severity(reports.alerts(_texts(spark, "zap.json"))), "alert_"))


@query
def read_sarif(spark, d):
    return reports.sarif_issues(_texts(spark, "report.sarif"))


@query
def significant_paths(spark, d):
    rows = spark.createDataFrame([(p,) for p in samples.PATHS], "path string")
    return rows.select("path", T.significant(F.col("path"), ("src/**/*.ts", "*.go"), ("tests/*", "*_test.ts"), ("**/gen/*",)).alias("significant"))


@query
def language_names(spark, d):
    rows = spark.createDataFrame([(n,) for n in samples.NAMES], "name string")
    return rows.select("name", metrics.language_of_name(F.col("name")).alias("language"))


@query
def unified_diff(spark, d):
    return diffs.unified(spark.createDataFrame([("a.txt", samples.OLD, samples.NEW), ("same.txt", "x", "x")], "path string, old string, new string"))


@query
def rules_listing(spark, d):
    return sinks.rules_listing(spark, "go").select("rule_id", "severity")


@query
def vulnerability_list(spark, d):
    advisories = load(spark, d, "advisories")
    found = dependencies.vulnerabilities(advisories.where("cvss >= 4").select("ecosystem", "name", "version"), advisories)
    return dependencies.listed(found).where("position <= 20")


@query
def vulnerability_counts(spark, d):
    advisories = load(spark, d, "advisories")
    return dependencies.by_severity(dependencies.vulnerabilities(advisories.select("ecosystem", "name", "version"), advisories))


@query
def dependency_gate(spark, d):
    advisories = load(spark, d, "advisories")
    return quality.verdict(quality.severity_checks(dependencies.by_severity(dependencies.vulnerabilities(advisories.select("ecosystem", "name", "version"), advisories)), "dependency_"))


@query
def full_gate(spark, d):
    """All conditions over the known issues: ratings, duplication, coverage, coverage of new code, blockers and criticals, and the verdict."""
    issues = quality.all_issues(_snippets(spark))
    lines = _coverage_lines(spark, d)
    recent = load(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("commit"))
    fresh = coverage.new_code(lines, lines.select("path", "line", "commit"), recent)
    dup = duplication.duplication_totals(_tokens(spark, d)).select(F.lit("duplication").alias("check"), F.col("percent").alias("value"))
    checks = quality.rating_checks(quality.ratings(issues, _snippets(spark)), "C").unionByName(quality.gate(dup, {"duplication": ("max", 3)}))
    checks = checks.unionByName(quality.coverage_check("coverage", coverage.totals(lines), 50.0)).unionByName(quality.coverage_check("new_coverage", fresh, 80.0))
    return quality.verdict(checks.unionByName(quality.severity_checks(quality.severity_counts(issues))))


@query
def new_code_issues(spark, d):
    """Issues of events that are new, or of users seen in the last tenth of the stream; both, as new or recent."""
    previous, current = _event_issues(spark, d)
    fresh = snapshots.issue_lifecycle(previous, current).where("status in ('new', 'regressed')").select("path", "key")
    recent = load(spark, d, "events").where("event_type = 'error' and user_id is not null").select(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("path"))
    kept = quality.selected(current.distinct(), fresh, recent)
    return kept.groupBy("path").agg(F.count(F.lit(1)).alias("issues"))


@query
def significant_issues(spark, d):
    return quality.significant_split(rules.issues(_files(spark, d)), T.significant(F.col("path"), ("src/*",), ("*test*",)))


@query
def new_coverage_by_file(spark, d):
    """Coverage of files that a snapshot calls added or changed: the way without commits."""
    lines = _coverage_lines(spark, d)
    half = lines.where("line <= 3")
    digest = lambda x: x.groupBy("path").agg(F.sum("line").alias("hash"))
    return coverage.new_code_by_file(coverage.by_file(lines), snapshots.file_status(digest(half), digest(lines)))


@query
def merged_snapshot(spark, d):
    """The next snapshot: users of the second half, and those of the first that did not come back; by status of their content."""
    previous, current = _event_snapshots(spark, d)
    kept = snapshots.merge(previous, current.where("hash <> 'error'"))
    todo, same = snapshots.unchanged_split(current, previous)
    return kept.agg(F.count(F.lit(1)).alias("paths"), F.countDistinct("hash").alias("hashes")).crossJoin(todo.agg(F.count(F.lit(1)).alias("todo"))).crossJoin(same.agg(F.count(F.lit(1)).alias("unchanged")))  # one row each


@query
def event_bursts(spark, d):
    """Bursts of events per user with two hours of quiet around them: the batch form of the watch stream."""
    from codelode.streaming import watch

    return watch.bursts(load(spark, d, "events"))


@query
def event_bursts_streamed(spark, d):
    """The same bursts, computed by a stream that takes what is there and stops."""
    from codelode.streaming import watch

    return watch.bursts_streamed(spark, f"{d}/events.parquet")


@query
def test_cases(spark, d):
    """Events as test cases: those of type error failed; passed and failed by day."""
    events = load(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("file"), F.when(F.col("event_type") == "error", "failed").otherwise("passed").alias("status"))
    return events.groupBy("file").agg(F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") == "failed").alias("failed"))


@query
def content_hashes(spark, d):
    """Hash, size and lines of each file, as a snapshot keeps them; and the Java hash of its path."""
    rows = _files(spark, d).where("file_id is not null")
    return rows.select("file_id", F.sha2("text", 256).alias("hash"), F.length("text").alias("chars"), F.size(T.lines(F.col("text"))).alias("lines"), T.java_hash(F.col("path")).alias("path_hash")).distinct()


@query
def largest_functions(spark, d):
    """The ten most complex functions over all repositories, ties by path, line and id."""
    f = load(spark, d, "functions").where("function_id is not null").select("function_id", "path", "start_line", "name", "complexity").distinct()
    return f.orderBy(F.desc_nulls_last("complexity"), "path", "start_line", "function_id").limit(10)


@query
def function_rank_by_file(spark, d):
    """Functions by complexity within their file, nulls last."""
    f = load(spark, d, "functions").where("function_id is not null").select("function_id", "file_id", "complexity").distinct()
    w = Window.partitionBy("file_id").orderBy(F.desc_nulls_last("complexity"), "function_id")
    return f.select("function_id", "file_id", F.row_number().over(w).alias("rank"), F.lag("function_id").over(w).alias("before"))


@query
def file_tokens(spark, d):
    """All tokens of the files that were analyzed; the stored streams are what these should be."""
    rows = S.once(_files(spark, d).where("analyzed"), "path", "text")
    return tokenize.tokenize(rows.select("file_id", S.language_of(F.col("path")).alias("language"), "text"))


@query
def file_complexity(spark, d):
    return complexity.by_file(duplication.clean_tokens(load(spark, d, "tokens")))


@query
def function_complexity(spark, d):
    return complexity.by_function(duplication.clean_tokens(load(spark, d, "tokens")), load(spark, d, "functions"))


@query
def tainted_sinks(spark, d):
    return treerules.tainted_sinks(_files(spark, d))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.sql(CUSTOM_RULES)
