"""The registered queries in the SQL of DuckDB, written apart from the Spark code: nothing here is taken from the operators."""

from __future__ import annotations

from codelode.plans.snippets import SNIPPETS

NL = "chr(10)"
_LINES = f"string_split(regexp_replace(replace(text, chr(13) || chr(10), {NL}), '\\n$', ''), {NL})"
_EXT = r"lower(regexp_extract(path, '\.([^./\\]+)$', 1))"
_LANG = f"""CASE WHEN {_EXT} = 'rs' THEN 'rust' WHEN {_EXT} IN ('ts', 'mts', 'cts') THEN 'typescript' WHEN {_EXT} IN ('js', 'mjs', 'cjs') THEN 'javascript'
  WHEN {_EXT} IN ('tsx', 'jsx', 'go', 'java', 'swift', 'dart', 'sql', 'css', 'json', 'toml', 'php') THEN {_EXT} WHEN {_EXT} IN ('py', 'pyi') THEN 'python'
  WHEN {_EXT} IN ('c', 'h') THEN 'c' WHEN {_EXT} IN ('cpp', 'cc', 'cxx', 'hpp', 'hh', 'hxx') THEN 'cpp' WHEN {_EXT} = 'cs' THEN 'csharp' WHEN {_EXT} = 'rb' THEN 'ruby'
  WHEN {_EXT} IN ('kt', 'kts') THEN 'kotlin' WHEN {_EXT} IN ('scala', 'sc') THEN 'scala' WHEN {_EXT} IN ('sh', 'bash', 'zsh') THEN 'bash' WHEN {_EXT} IN ('html', 'htm') THEN 'html'
  WHEN {_EXT} IN ('scss', 'sass') THEN 'scss' WHEN {_EXT} IN ('yaml', 'yml') THEN 'yaml' WHEN {_EXT} IN ('md', 'markdown') THEN 'markdown' ELSE NULL END"""
_WHITE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160) || chr(5760) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288) || " + " || ".join(f"chr({c})" for c in range(8192, 8203))
_F = f"""files0 AS (SELECT DISTINCT file_id, path, text, {_LANG} AS language FROM files WHERE file_id IS NOT NULL),
lines0 AS (
  SELECT file_id, path, language, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text
  FROM (SELECT file_id, path, language, {_LINES} AS l FROM files0 WHERE text IS NOT NULL AND text <> '')
), trimmed AS (SELECT *, trim(text, {_WHITE}) AS raw FROM lines0)"""


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


_PY_TEST = "(path LIKE '%\\_test.py' ESCAPE '\\' OR path LIKE '%test\\_.py' ESCAPE '\\')"
_IN_TESTS = "(path LIKE '%/tests/%' OR contains(path, '\\tests\\'))"
_RS_TEST = f"({_IN_TESTS} OR ends_with(path, '_test.rs') OR ends_with(path, 'test_.rs'))"
_MARGIN = "NOT starts_with(text, chr(9)) AND NOT starts_with(text, '  ')"
_CHECKED = " OR ".join(f"n{k} LIKE '%if err%' OR n{k} LIKE '%err != nil%' OR (n{k} LIKE '%err%' AND (n{k} LIKE '%if%' OR n{k} LIKE '%check%'))" for k in (1, 2, 3))
_BLOCK = "concat_ws(' ', raw, n1, n2, n3, n4)"
#: Id, severity, language and condition of each rule about a line and the lines around it.
_LINE_RULES = [
    ("python/avoid-print", "minor", "python", f"raw LIKE '%print(%' AND raw NOT LIKE '#%' AND NOT ({_PY_TEST} OR {_IN_TESTS})"),
    ("python/avoid-bare-except", "major", "python", "raw LIKE 'except:%'"),
    ("python/avoid-mutable-default", "critical", "python", "raw LIKE 'def %' AND regexp_matches(raw, '=(\\[\\]|\\{\\}|set\\(\\)|list\\(\\)|dict\\(\\))')"),
    ("python/avoid-global-var", "info", "python", """NOT regexp_matches(text, '^\\s') AND (raw LIKE '%= %' OR raw LIKE '%=') AND NOT regexp_matches(raw, '^(#|@|def |class |import |from )')
      AND NOT (starts_with(raw, '__') AND ends_with(raw, '__')) AND NOT regexp_matches(raw, '^\\p{Lu}[\\p{Lu}_0-9]*=') AND NOT regexp_matches(raw, '==|!=|<=|>=') AND NOT (raw LIKE '%: %' AND raw NOT LIKE '%= %')"""),
    ("python/avoid-todo", "info", "python", "regexp_matches(raw, '^(#|\"\"\"|['']{3})') AND regexp_matches(raw, '(?i)todo|fixme|hack|xxx')"),
    ("python/avoid-star-import", "major", "python", "raw LIKE 'from % import *%'"),
    ("python/explicit-return-type", "info", "python", f"raw LIKE 'def %' AND raw LIKE '%(%' AND raw LIKE '%:%' AND raw NOT LIKE '%->%' AND NOT contains(raw, 'def _') AND NOT {_PY_TEST} AND NOT ends_with(path, '__init__.py')"),
    ("python/docstring-required", "info", "python", f"regexp_matches(raw, '^(def|class) ') AND NOT regexp_matches(raw, 'def _|class _') AND NOT {_PY_TEST} AND NOT regexp_matches(coalesce(nullif(n1, ''), nullif(n2, ''), nullif(n3, ''), ''), '^r?(\"\"\"|['']{3})')"),
    ("rust/avoid-println", "minor", "rust", f"(raw LIKE '%println!(%' OR raw LIKE '%dbg!(%') AND raw NOT LIKE '//%' AND NOT {_RS_TEST}"),
    ("rust/avoid-unwrap", "major", "rust", f"raw LIKE '%.unwrap()%' AND raw NOT LIKE '//%' AND raw NOT LIKE '%#[test]%' AND raw NOT LIKE '%#[cfg(test)]%' AND NOT {_RS_TEST}"),
    ("rust/avoid-expect", "minor", "rust", f"raw LIKE '%.expect(%' AND raw NOT LIKE '//%' AND NOT {_RS_TEST}"),
    ("rust/avoid-todo", "major", "rust", "raw LIKE '%todo!(%' AND raw NOT LIKE '//%'"),
    ("rust/avoid-unimplemented", "major", "rust", "raw LIKE '%unimplemented!(%' AND raw NOT LIKE '//%'"),
    ("rust/explicit-return-type", "info", "rust", "(starts_with(raw, 'pub async fn ') OR regexp_matches(raw, '^pub fn +[^(\\s]')) AND contains(concat_ws(' ', raw, n1, n2, n3), '{') AND NOT contains(concat_ws(' ', raw, n1, n2, n3), '->')"),
    ("go/avoid-print", "minor", "go", "(raw LIKE '%fmt.Print%' OR raw LIKE '%log.Println%') AND raw NOT LIKE '//%' AND NOT ends_with(path, '_test.go')"),
    ("go/avoid-empty-block", "major", "go", "raw LIKE '%{}'"),
    ("go/error-check", "critical", "go", f"regexp_matches(raw, 'err :=|err,|, err') AND NOT regexp_matches(raw, '^(//|/\\*)') AND NOT (raw LIKE '%if%' AND raw LIKE '%err%') AND NOT ({_CHECKED})"),
    ("go/avoid-init", "minor", "go", "raw LIKE 'func init()%' OR raw LIKE 'func init (%'"),
    ("go/avoid-global-var", "info", "go", f"raw LIKE 'var %' AND raw NOT LIKE '%:= %' AND raw NOT LIKE '%const%' AND raw NOT IN ('var (', 'var(') AND {_MARGIN}"),
    ("go/exported-comment", "info", "go", f"regexp_matches(raw, '^(func|type|var|const) [A-Z]') AND {_MARGIN} AND p NOT LIKE '//%' AND p NOT LIKE '/*%'"),
    ("dart/avoid-print", "minor", "dart", "raw LIKE '%print(%' AND raw NOT LIKE '//%' AND raw NOT LIKE '%blueprint%' AND raw NOT LIKE '%sprintf%'"),
    ("dart/avoid-unnecessary-containers", "minor", "dart", f"raw LIKE '%Container(%' AND (raw LIKE '%width:%' OR raw LIKE '%height:%') AND NOT regexp_matches({_BLOCK}, 'child:|decoration:|color:')"),
    ("dart/prefer-const-constructors", "minor", "dart", "raw NOT LIKE '//%' AND (" + " OR ".join(f"(contains(raw, '{n}') AND NOT regexp_matches(string_split(raw, '{n}')[1], 'const[ \\t]$'))" for n in ("EdgeInsets.", "TextStyle(", "Color(", "Size(")) + ")"),
    ("dart/prefer-async-await", "minor", "dart", "raw LIKE '%.then(%' AND NOT starts_with(raw, '//') AND NOT starts_with(raw, 'expect')"),
    ("dart/avoid-web-libraries-in-flutter", "major", "dart", "regexp_matches(raw, '^(import|export) ') AND regexp_matches(raw, 'dart:(html|js|web_gl)')"),
]
_ISSUES = f"""WITH {_F}, near AS (
  SELECT file_id, path, language, line, text, raw, coalesce(lag(raw) OVER w, '') AS p, {", ".join(f"coalesce(lead(raw, {k}) OVER w, '') AS n{k}" for k in (1, 2, 3, 4))}
  FROM trimmed WINDOW w AS (PARTITION BY file_id ORDER BY line)
), issues AS (""" + "\nUNION ALL ".join(
    f"SELECT DISTINCT file_id, path, line, '{rule}' AS rule_id, '{severity}' AS severity FROM near WHERE language = '{language}' AND ({holds})" for rule, severity, language, holds in _LINE_RULES
) + ")\n"
_SEVERITY_OF = {
    "blocker": "no-buffer-constructor no-eval no-new-func security/sql-injection security/command-injection security/flutter-sql-injection",
    "critical": "no-async-promise-executor no-constant-condition no-delete-var no-dupe-keys no-empty-pattern no-fallthrough no-html-link no-implied-eval no-new-require no-obj-calls no-octal"
    " no-prototype-builtins no-redeclare no-script-url no-unreachable no-unsafe-finally no-unsafe-negation no-with security/xss security/ssrf security/path-traversal security/flutter-path-traversal"
    " python/avoid-mutable-default go/error-check",
    "info": "no-magic-numbers no-warning-comments python/avoid-global-var python/avoid-todo python/explicit-return-type python/docstring-required rust/explicit-return-type go/avoid-global-var go/exported-comment",
    "major": "dart/avoid-empty-catch dart/avoid-web-libraries-in-flutter default-case no-bitwise no-compare-neg-zero no-control-regex no-duplicate-imports no-empty-interface no-eqeqeq no-explicit-any"
    " no-import-assign no-misused-new no-new-buffer no-new-symbol no-param-reassign no-proto no-self-compare no-sparse-arrays no-throw-literal no-unused-vars no-var prefer-promise-reject-errors require-await"
    " python/avoid-bare-except python/avoid-star-import rust/avoid-unwrap rust/avoid-todo rust/avoid-unimplemented go/avoid-empty-block security/prototype-pollution security/open-redirect security/flutter-http-injection",
}


def _severity(rule: str) -> str:
    return next((s for s, rules in _SEVERITY_OF.items() if rule in rules.split()), "minor")


def _snippet_issues() -> str:
    rows = ", ".join(f"({i}, {_q(path)}, {line}, {_q(rule)}, '{_severity(rule)}')" for i, (path, _, some) in enumerate(SNIPPETS) for line, rule in some)
    return f"WITH issues AS (SELECT * FROM (VALUES {rows}) v(file_id, path, line, rule_id, severity))\n"


_RANK = "CASE severity WHEN 'blocker' THEN 0 WHEN 'critical' THEN 1 WHEN 'major' THEN 2 WHEN 'minor' THEN 3 ELSE 4 END"
_LEVEL = "CASE WHEN severity IN ('blocker', 'critical') THEN 'error' WHEN severity = 'major' THEN 'warning' ELSE 'note' END"

_TEST_NAME = r"\.(spec|test)\.(ts|tsx|js|jsx)$|_test\.(dart|go|rs|py)$|\.test\.dart$|^test_.*\.(rs|py)$|\.d\.ts$|\.generated\.tsx?$|\.min\.|\.(json|ya?ml|toml|xml|html|css|scss|md|lock|prisma|graphql|gql|sql)$"
_EXCLUDED = rf"(regexp_matches(regexp_extract(lower(path), '([^/\\]*)$', 1), '{_TEST_NAME}') OR regexp_matches(lower(path), '__tests__|[/\\]tests?[/\\]'))"
_ELIGIBLE = f"(NOT {_EXCLUDED} AND {_EXT} IN ('ts', 'tsx', 'js', 'jsx', 'dart', 'py'))"

_METRICS = rf"""
{_F}, rests AS (
  SELECT *, strpos(raw, '*/') AS c, regexp_replace(raw, '(//.*)|/\*.*?\*/', '\1', 'g') AS o, regexp_replace(substr(raw, strpos(raw, '*/') + 2), '(//.*)|/\*.*?\*/', '\1', 'g') AS i FROM trimmed
), effect AS (
  SELECT *, strpos(o, '//') > 0 AND (strpos(o, '/*') = 0 OR strpos(o, '//') < strpos(o, '/*')) AS o_line, strpos(i, '//') > 0 AND (strpos(i, '/*') = 0 OR strpos(i, '//') < strpos(i, '/*')) AS i_line
  FROM rests
), states AS (
  SELECT *, CASE WHEN starts_with(raw, '#') OR o_line OR strpos(o, '/*') = 0 THEN 0 ELSE 1 END AS from_out, CASE WHEN c = 0 THEN 1 WHEN i_line OR strpos(i, '/*') = 0 THEN 0 ELSE 1 END AS from_in FROM effect
), resets AS (
  SELECT *, CASE WHEN raw <> '' AND from_out = from_in THEN from_in END AS fixed FROM states
), inside AS (
  SELECT *, coalesce(last_value(fixed IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM resets
), judged AS (
  SELECT *, raw = '' AS is_blank, raw <> '' AND CASE WHEN before = 0 THEN starts_with(raw, '#') OR o_line OR from_out = 1 ELSE from_in = 1 OR (c > 0 AND i_line) END AS is_comment
  FROM inside
), counted AS (
  SELECT file_id, count(*) AS loc, count(*) FILTER (NOT is_blank AND NOT is_comment) AS code, count(*) FILTER (is_comment) AS comment, count(*) FILTER (is_blank) AS blank
  FROM judged GROUP BY file_id
), metrics0 AS (
  SELECT f.file_id, f.language, CAST(coalesce(loc, 0) AS INTEGER) AS loc, CAST(coalesce(code, 0) AS INTEGER) AS code,
    CAST(coalesce(comment, 0) AS INTEGER) AS comment, CAST(coalesce(blank, 0) AS INTEGER) AS blank
  FROM files0 f LEFT JOIN counted c USING (file_id) WHERE f.text IS NOT NULL
)"""

_TOKENS = f"""tok AS (
  SELECT file_id, unit, min(line) AS line, min(text) AS text FROM tokens
  WHERE file_id IS NOT NULL AND unit IS NOT NULL AND text IS NOT NULL
    AND file_id IN (SELECT file_id FROM files WHERE {_ELIGIBLE})
  GROUP BY file_id, unit
)"""
_ALL_TOKENS = """tok AS (
  SELECT file_id, unit, min(line) AS line, min(text) AS text FROM tokens WHERE file_id IS NOT NULL AND unit IS NOT NULL AND text IS NOT NULL GROUP BY file_id, unit
)"""
_SHINGLES = _TOKENS + """, led AS (
  SELECT file_id, text, row_number() OVER w - 1 AS pos, lead(text, 1) OVER w AS t1, lead(text, 2) OVER w AS t2, lead(text, 3) OVER w AS t3, lead(text, 4) OVER w AS t4
  FROM tok WINDOW w AS (PARTITION BY file_id ORDER BY unit)
), sh AS (
  SELECT file_id, pos, md5(text || chr(1) || t1 || chr(1) || t2 || chr(1) || t3 || chr(1) || t4) AS hash FROM led WHERE t4 IS NOT NULL
)"""
_WINNOW = _SHINGLES + """, wn AS (
  SELECT file_id, pos, hash, min(hash || lpad(CAST(99999999 - pos AS VARCHAR), 8, '0')) OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS m,
    count(*) OVER (PARTITION BY file_id) AS n FROM sh
), picked AS (
  SELECT DISTINCT file_id, 99999999 - CAST(right(m, 8) AS BIGINT) AS pos, left(m, 32) AS hash FROM wn WHERE n > 10 AND pos + 10 <= n
), tail AS (
  SELECT w.file_id, min(w.hash || lpad(CAST(w.pos AS VARCHAR), 8, '0')) AS m FROM wn w
  JOIN (SELECT file_id, max(pos) AS last FROM picked GROUP BY 1) l ON w.file_id = l.file_id AND w.pos > l.last GROUP BY 1
), short AS (
  SELECT file_id, min(hash || lpad(CAST(pos AS VARCHAR), 8, '0')) AS m FROM wn WHERE n <= 10 GROUP BY 1
), fp AS (
  SELECT * FROM picked UNION ALL SELECT file_id, CAST(right(m, 8) AS BIGINT), left(m, 32) FROM tail
  UNION ALL SELECT file_id, CAST(right(m, 8) AS BIGINT), left(m, 32) FROM short
)"""
_DUP_TOTALS = _WINNOW + """, totals AS (
  SELECT (SELECT count(*) FROM tok) AS tokens, coalesce((SELECT sum(c - 1) * 5 FROM (SELECT count(DISTINCT file_id) AS c FROM fp GROUP BY hash)), 0) AS dup
), dup0 AS (SELECT tokens, CASE WHEN tokens < 100 THEN 0 ELSE dup END AS duplicated FROM totals)"""
_COLLAPSED = _TOKENS + """, tl AS (
  SELECT file_id, line, string_agg(text, '' ORDER BY unit) AS value, min(unit) AS start_unit, max(unit) AS end_unit FROM tok GROUP BY file_id, line
), nb AS (
  SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM tl WINDOW w AS (PARTITION BY file_id ORDER BY line)
), col AS (SELECT * FROM nb WHERE b IS NULL OR a IS NULL OR b <> value OR a <> value)"""
_BLOCKS = _COLLAPSED + """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line) - 1 AS idx FROM col
), bl AS (
  SELECT a.file_id, a.idx, md5(string_agg(b.value, chr(10) ORDER BY b.idx)) AS hash, min(b.line) AS start_line, max(b.line) AS end_line,
    min(b.start_unit) AS start_unit, max(b.end_unit) AS end_unit
  FROM numbered a JOIN numbered b ON a.file_id = b.file_id AND b.idx BETWEEN a.idx AND a.idx + 9 GROUP BY a.file_id, a.idx HAVING count(*) = 10
)"""
_RUNS = _BLOCKS + """, hit AS (
  SELECT *, idx - row_number() OVER (PARTITION BY file_id ORDER BY idx) AS island FROM bl WHERE hash IN (SELECT hash FROM bl GROUP BY hash HAVING count(*) > 1)
), runs AS (
  SELECT file_id, min(start_line) AS start_line, max(end_line) AS end_line, max(end_unit) - min(start_unit) + 1 AS tokens
  FROM hit GROUP BY file_id, island HAVING max(end_unit) - min(start_unit) + 1 >= 100
)"""
_ALIKE = ("min(text) AS text", "CASE WHEN regexp_full_match(min(text), '[A-Za-z_][A-Za-z0-9_]*') THEN '$id' ELSE min(text) END AS text")
_GROUPS = """, pr AS (
  SELECT a.file_id AS fa, a.idx AS ia, b.file_id AS fb, b.idx - a.idx AS d FROM bl a JOIN bl b ON a.hash = b.hash AND (a.file_id <> b.file_id OR a.idx <> b.idx)
), isl AS (
  SELECT *, ia - row_number() OVER (PARTITION BY fa, fb, d ORDER BY ia) AS g FROM pr
), pair_runs AS (SELECT fa, fb, d, min(ia) AS s, max(ia) AS e FROM isl GROUP BY fa, fb, d, g
), keys AS (
  SELECT i.file_id, s, e, md5(string_agg(bl.hash, '|' ORDER BY bl.idx)) AS k FROM (SELECT DISTINCT fa AS file_id, s, e FROM pair_runs) i
  JOIN bl ON bl.file_id = i.file_id AND bl.idx BETWEEN s AND e GROUP BY i.file_id, s, e
), members AS (
  SELECT DISTINCT k, r.fb AS file_id, x.s + r.d AS s, x.e + r.d AS e FROM keys x JOIN pair_runs r ON r.fa = x.file_id AND r.s <= x.s AND r.e >= x.e
  UNION SELECT k, file_id, s, e FROM keys
), placed AS (
  SELECT m.*, a.start_line, b.end_line, b.end_unit - a.start_unit + 1 AS tokens FROM members m
  JOIN bl a ON a.file_id = m.file_id AND a.idx = m.s JOIN bl b ON b.file_id = m.file_id AND b.idx = m.e
), large AS (SELECT * FROM placed WHERE k IN (SELECT k FROM placed GROUP BY k HAVING max(tokens) >= 100)
), sizes AS (SELECT k, count(*) AS parts, count(DISTINCT file_id) AS files, max(e - s) + 1 AS blocks, max(end_line - start_line + 1) AS lines, min(file_id) AS f FROM large GROUP BY k
), held AS (
  SELECT DISTINCT g FROM (
    SELECT a.k AS g, b.k AS h, count(DISTINCT (a.file_id, a.s)) AS n, count(DISTINCT a.file_id) AS nf FROM large a
    JOIN large b ON a.file_id = b.file_id AND a.k <> b.k AND b.s <= a.s AND b.e >= a.e AND b.e - b.s > a.e - a.s GROUP BY 1, 2)
  JOIN sizes x ON x.k = g JOIN sizes y ON y.k = h WHERE n = x.parts AND nf = y.files
), groups0 AS (
  SELECT z.k, z.parts, z.files, z.blocks, z.lines, f AS first_file, (SELECT min(start_line) FROM large l WHERE l.k = z.k AND l.file_id = f) AS first_line
  FROM sizes z WHERE z.k NOT IN (SELECT g FROM held)
)"""
_PAIRS = """, ph AS (SELECT DISTINCT file_id, hash FROM fp), cls AS (
  SELECT min(file_id) AS rep, count(*) AS copies FROM (SELECT file_id, list_sort(list(hash)) AS h FROM ph GROUP BY file_id) GROUP BY h
), pairs0 AS (
  SELECT a.file_id AS file_a, b.file_id AS file_b, count(*) AS shared FROM (SELECT * FROM ph SEMI JOIN cls ON rep = file_id) a JOIN (SELECT * FROM ph SEMI JOIN cls ON rep = file_id) b
  ON a.hash = b.hash AND a.file_id < b.file_id GROUP BY 1, 2 ORDER BY shared DESC, file_a, file_b LIMIT 500
)"""
_LEGACY = """, leg AS (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line) AS o, sum(fresh) OVER (PARTITION BY file_id ORDER BY line) AS r FROM (
    SELECT *, CASE WHEN lag(value) OVER (PARTITION BY file_id ORDER BY line) = value THEN 0 ELSE 1 END AS fresh FROM tl)
), legk AS (
  SELECT file_id, line, value, row_number() OVER (PARTITION BY file_id ORDER BY line) - 1 AS idx FROM (
    SELECT *, count(*) OVER (PARTITION BY file_id, r) AS n, row_number() OVER (PARTITION BY file_id, r ORDER BY line) AS i FROM leg) WHERE i = 1 OR (i = n AND n >= 3)
), lb AS (
  SELECT a.file_id, md5(string_agg(b.value, chr(10) ORDER BY b.idx)) AS hash, min(b.line) AS s, max(b.line) AS e
  FROM legk a JOIN legk b ON a.file_id = b.file_id AND b.idx BETWEEN a.idx AND a.idx + 9 GROUP BY a.file_id, a.idx HAVING count(*) = 10
)"""
_COV = """cov AS (
  SELECT 'src/' || CAST(l_orderkey AS VARCHAR) || '.ts' AS path, l_linenumber AS line, CAST(l_quantity >= 25 AS BIGINT) AS hits, l_returnflag AS category, l_suppkey AS commit
  FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
), cf AS (
  SELECT path, count(*) AS total, count(*) FILTER (hits > 0) AS covered FROM cov GROUP BY path
)"""
_PCT = "round(CASE WHEN {b} > 0 THEN {a} * 100.0::DOUBLE / {b} ELSE 0 END, 4)"
_HALVES = """marked AS (
  SELECT *, epoch_us(ts) <= (SELECT epoch_us(min(ts)) / 2 + epoch_us(max(ts)) / 2 FROM events WHERE user_id IS NOT NULL) AS early FROM events WHERE user_id IS NOT NULL
)"""
_LIFE = f"""{_HALVES}, i AS (
  SELECT DISTINCT 'u/' || CAST(user_id AS VARCHAR) AS path, event_type || ':' || CAST(hour(ts) AS VARCHAR) AS key, early FROM marked
), p AS (SELECT path, key FROM i WHERE early), c AS (SELECT path, key FROM i WHERE NOT early), life AS (
  SELECT c.path, c.key, CASE WHEN p.key IS NOT NULL THEN 'persistent' WHEN c.path IN (SELECT path FROM p) THEN 'regressed' ELSE 'new' END AS status
  FROM c LEFT JOIN p ON c.path = p.path AND c.key = p.key
  UNION ALL SELECT path, key, 'fixed' FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.path = p.path AND c.key = p.key)
)"""
_SEV = "CASE WHEN cvss >= 9 THEN 0 WHEN cvss >= 7 THEN 1 WHEN cvss >= 4 THEN 2 WHEN cvss > 0 THEN 3 ELSE 4 END"
_NAMES = "(['blocker', 'critical', 'major', 'minor', 'info'])"
_ADV = f"""adv AS (
  SELECT *, {_SEV} AS rank FROM (
    SELECT DISTINCT lower(ecosystem) AS ecosystem, name, version, upper(trim(osv_id, {_WHITE})) AS osv_id,
      CASE WHEN isnan(cvss) THEN NULL ELSE cvss END AS cvss
    FROM advisories WHERE osv_id IS NOT NULL AND name IS NOT NULL)
)"""


def _rows(columns: str, *rows: tuple) -> str:
    """Rows that are known by hand."""
    value = lambda v: "NULL" if v is None else str(v) if isinstance(v, bool | int) else f"{v}::DOUBLE" if isinstance(v, float) else _q(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) v({columns})"


def _custom(rules: list[tuple]) -> str:
    parts, seen = [], set()
    for i, severity, languages, pattern, message in sorted(rules, key=lambda r: (r[0], r[3])):
        if "(?=" in pattern or i in seen:
            continue
        seen.add(i)
        sev = severity if severity in ("blocker", "critical", "major", "minor", "info") else "major"
        text = f"replace({_q(message)}, '$0', m)" if message else _q("Matched pattern: " + pattern)
        lang = f" AND language IN {_in(languages)}" if languages else ""
        parts.append(
            f"""SELECT file_id, line, '{i}' AS rule_id, '{sev}' AS severity, {text} AS message,
  CAST(list_sum([length(x) for x in gaps[1:k]]) + coalesce(list_sum([length(x) for x in ms[1:k - 1]]), 0) + 1 AS INTEGER) AS start_column
FROM (SELECT file_id, line, ms, gaps, unnest(range(1, len(ms) + 1)) AS k, unnest(ms) AS m FROM (
  SELECT file_id, line, regexp_extract_all(text, {_q(pattern)}) AS ms, regexp_split_to_array(text, {_q(pattern)}) AS gaps
  FROM trimmed WHERE NOT regexp_matches(raw, '^(//|#|/\\*|\\*)'){lang}) WHERE len(ms) > 0)"""
        )
    return f"WITH {_F} SELECT DISTINCT * FROM (" + "\nUNION ALL ".join(parts) + ")"


def sql(custom: list[tuple]) -> dict[str, str]:
    snippets = _snippet_issues()
    slash = r"regexp_matches(text, '(?i)(?:^|\s)(?://[!/]?|--)\s*NOSONAR\b')"
    hashed = r"regexp_matches(text, '(?i)(?:^|\s)#\s*NOSONAR\b')"
    block = r"regexp_matches(text, '(?i)(?:/\*|<!--)\s*NOSONAR\b')"
    pct = lambda a, b: _PCT.format(a=a, b=b)
    rating = "CASE WHEN share < 5 THEN 'A' WHEN share < 10 THEN 'B' WHEN share < 20 THEN 'C' WHEN share < 50 THEN 'D' ELSE 'E' END"
    bursts = """
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS events FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh
    FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)) GROUP BY user_id, burst"""
    found = {
        "language_metrics": f"""WITH {_METRICS} SELECT language, count(*) AS files, sum(loc) AS loc, sum(code) AS code, sum(comment) AS comment, sum(blank) AS blank,
  {pct("sum(comment)", "sum(code + comment)")} AS density FROM metrics0 GROUP BY language""",
        "file_line_metrics": f"WITH {_METRICS} SELECT * FROM metrics0",
        "language_histogram": f"SELECT language, count(*) AS files FROM (SELECT DISTINCT file_id, {_LANG} AS language FROM files WHERE file_id IS NOT NULL) GROUP BY language",
        "nosonar_by_file": f"""WITH {_F} SELECT file_id, count(*) AS markers FROM lines0 WHERE CASE WHEN language IS NULL THEN {hashed} WHEN language = 'php' THEN {hashed} OR {block}
  WHEN language IN ('python', 'ruby', 'bash', 'yaml', 'toml', 'php') THEN {hashed} WHEN language IN ('html', 'css', 'scss', 'php') THEN {block} WHEN language IN ('json', 'markdown') THEN false ELSE {slash} END GROUP BY file_id""",
        "path_predicates": f"SELECT DISTINCT file_id, {_LANG} AS language, {_EXT} AS ext, {_EXCLUDED} AS excluded, {_ELIGIBLE} AS eligible FROM files WHERE file_id IS NOT NULL",
        "discovered_files": rf"""SELECT DISTINCT file_id, path FROM files WHERE (starts_with(path, 'src/') OR regexp_matches(path, '^(.*/)?lib/(.*/)?[^/]*\.(rs|go)$') OR regexp_matches(path, '(^|/)pkg'))
  AND NOT regexp_matches(path, '(^|/)vendors/') AND NOT regexp_matches(path, '_generator\.[^/]*$') AND NOT regexp_matches(path, '(^|/)\.git/')
  AND {_LANG} IS NOT NULL AND NOT {_EXCLUDED} AND strlen(text) <= 1048576""",
        "project_metrics": """WITH f AS (SELECT DISTINCT file_id, repo, loc, code_lines, comment_lines, blank_lines, class_count FROM files WHERE file_id IS NOT NULL),
g AS (SELECT DISTINCT function_id, repo, path, start_line, complexity FROM functions WHERE function_id IS NOT NULL),
a AS (SELECT repo, count(*) AS files, coalesce(sum(loc), 0) AS loc, coalesce(sum(code_lines), 0) AS code_lines, coalesce(sum(comment_lines), 0) AS comment_lines,
  coalesce(sum(blank_lines), 0) AS blank_lines FROM f GROUP BY repo),
b AS (SELECT repo, count(*) AS functions, round(sum(complexity) / count(complexity)::DOUBLE, 4) AS average_complexity FROM g GROUP BY repo),
w AS (SELECT repo, function_id AS worst_function FROM g WHERE complexity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo ORDER BY complexity DESC, path, start_line, function_id) = 1)
SELECT a.*, coalesce(functions, 0) AS functions, average_complexity, worst_function FROM a LEFT JOIN b USING (repo) LEFT JOIN w USING (repo)""",
        "comment_density": """WITH f AS (SELECT DISTINCT file_id, repo, code_lines, comment_lines FROM files WHERE file_id IS NOT NULL),
s AS (SELECT repo, coalesce(sum(code_lines), 0) AS a, coalesce(sum(comment_lines), 0) AS b FROM f GROUP BY repo)
SELECT repo, round(CASE WHEN a + b > 0 THEN b / (a + b)::DOUBLE ELSE 0 END, 6) AS comment_density FROM s""",
        "complexity_histogram": "SELECT complexity, count(*) AS functions FROM (SELECT DISTINCT function_id, complexity FROM functions WHERE function_id IS NOT NULL) GROUP BY complexity",
        "recently_modified": """SELECT DISTINCT file_id, path FROM files
WHERE CAST(modified_at AS TIMESTAMP) BETWEEN TIMESTAMP '2031-06-30 00:00:00' - INTERVAL 365 DAY AND TIMESTAMP '2031-06-30 00:00:00'""",
        "scan_settings": """SELECT scan_id, CASE WHEN lower(mode) IN ('token', 'tokens', 'shingle') THEN 'token' ELSE 'sonar' END AS mode, coalesce(min_tokens, 100) AS min_tokens,
  coalesce(min_lines, 10) AS min_lines, coalesce(normalize_identifiers, false) AS normalize_identifiers
FROM scans WHERE scan_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ingested_at DESC, coalesce(total_files, -1) DESC) = 1""",
        "line_rule_issues": _ISSUES + "SELECT * FROM issues",
        "rule_snippets": snippets + "SELECT * FROM issues",
        "snippet_rule_counts": snippets + "SELECT rule_id, severity, count(*) AS issues FROM issues GROUP BY ALL",
        "snippet_severity_counts": snippets + "SELECT s AS severity, (SELECT count(*) FROM issues WHERE severity = s) AS issues FROM (VALUES ('blocker'), ('critical'), ('major'), ('minor'), ('info')) v(s)",
        "snippet_top_rules": snippets + "SELECT rule_id, count(*) AS issues FROM issues GROUP BY rule_id ORDER BY issues DESC, rule_id LIMIT 5",
        "snippet_top_issues": snippets + f"SELECT severity, path, line, rule_id FROM issues ORDER BY {_RANK}, path, line, rule_id, file_id LIMIT 10",
        "snippet_quality_ratings": snippets + f""", worst AS (SELECT file_id, min({_RANK}) AS w FROM issues GROUP BY file_id), t AS (SELECT {len(SNIPPETS)} AS n),
r AS (SELECT kind, (SELECT count(*) FROM worst WHERE w <= k) * 100.0::DOUBLE / n AS share FROM t, (VALUES ('reliability', 0), ('security', 1), ('maintainability', 2)) v(kind, k))
SELECT kind, round(share, 4) AS share, {rating} AS rating FROM r""",
        "snippet_sarif_rules": snippets + f"SELECT rule_id, min({_LEVEL}) AS level, count(*) AS results FROM issues GROUP BY rule_id",
        "custom_rule_issues": _custom(custom),
        "function_limits": rf"""WITH f AS (SELECT DISTINCT function_id, file_id, {_LANG} AS language, start_line, end_line, complexity, parameter_count FROM functions WHERE function_id IS NOT NULL)
SELECT function_id, file_id, 'max-function-lines' AS rule_id FROM f WHERE language IN ('typescript', 'tsx') AND end_line - start_line + 1 > 50
UNION SELECT function_id, file_id, 'max-function-complexity' FROM f WHERE complexity > 15
UNION SELECT function_id, file_id, 'max-params' FROM f WHERE parameter_count > 5""",
        "token_shingles": f"WITH {_SHINGLES} SELECT hash, count(*) AS places, count(DISTINCT file_id) AS files FROM sh GROUP BY hash HAVING count(DISTINCT file_id) > 1",
        "winnowed_fingerprints": f"WITH {_WINNOW} SELECT * FROM fp",
        "token_duplication": f"WITH {_DUP_TOTALS} SELECT tokens, duplicated, {pct('duplicated', 'tokens')} AS percent FROM dup0",
        "shared_fingerprints": f"""WITH {_WINNOW}, d AS (SELECT DISTINCT file_id, hash FROM fp), c AS (SELECT hash FROM d GROUP BY hash HAVING count(*) > 1)
SELECT file_id, count(*) AS fingerprints, count(c.hash) AS shared FROM d LEFT JOIN c USING (hash) GROUP BY file_id""",
        "collapsed_lines": f"WITH {_COLLAPSED} SELECT file_id, count(*) AS lines, max(line) AS last_line FROM col GROUP BY file_id",
        "repeated_blocks": f"WITH {_BLOCKS} SELECT hash, count(*) AS places, count(DISTINCT file_id) AS files FROM bl GROUP BY hash HAVING count(*) > 1",
        "duplicated_runs": f"WITH {_RUNS} SELECT * FROM runs",
        "duplication_density": f"""WITH {_RUNS}, l AS (SELECT file_id, max(line) AS lines FROM tok GROUP BY file_id),
d AS (SELECT file_id, count(DISTINCT line) AS n FROM (SELECT file_id, unnest(range(start_line, end_line + 1)) AS line FROM runs) GROUP BY file_id)
SELECT l.file_id, lines, coalesce(n, 0) AS duplicated_lines, {pct("coalesce(n, 0)", "lines")} AS density FROM l LEFT JOIN d USING (file_id)""",
        "clone_groups": f"WITH {_BLOCKS}{_GROUPS} SELECT first_file, first_line, parts, files, blocks, lines FROM groups0",
        "normalized_clone_groups": f"WITH {_BLOCKS.replace(*_ALIKE)}{_GROUPS} SELECT parts, files, blocks, lines, count(*) AS groups FROM groups0 GROUP BY ALL",
        "top_blocks": f"WITH {_BLOCKS}{_GROUPS} SELECT lines, parts, first_file AS file_id, first_line AS start_line FROM groups0 ORDER BY lines DESC, file_id, start_line, parts LIMIT 20",
        "file_pairs": f"WITH {_WINNOW}{_PAIRS} SELECT p.*, a.copies AS copies_a, b.copies AS copies_b FROM pairs0 p JOIN cls a ON a.rep = file_a JOIN cls b ON b.rep = file_b",
        "fingerprint_runs": f"""WITH {_WINNOW}{_PAIRS}, q AS (
  SELECT file_id, pos, hash, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY file_id) AS m FROM fp
), met AS (
  SELECT file_a, file_b, x.i AS ia, x.pos AS pa, y.pos AS pb, y.i - x.i AS d FROM pairs0 JOIN q x ON x.file_id = file_a JOIN q y ON y.file_id = file_b AND y.hash = x.hash WHERE x.m * y.m <= 4000000
), runs0 AS (
  SELECT file_a, file_b, d, count(*) AS n, min(ia) AS i, min(pa) AS fa, max(pa) + 4 AS ta, min(pb) AS fb, max(pb) + 4 AS tb
  FROM (SELECT *, ia - row_number() OVER (PARTITION BY file_a, file_b, d ORDER BY ia) AS g FROM met) GROUP BY file_a, file_b, d, g
), best AS (SELECT * FROM runs0 QUALIFY row_number() OVER (PARTITION BY file_a, file_b ORDER BY n DESC, i + n, d) = 1
), pl AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY unit) - 1 AS pos, line FROM tok)
SELECT file_a, w.line AS start_a, x.line AS end_a, file_b, y.line AS start_b, z.line AS end_b, greatest(ta - fa, tb - fb) + 1 AS tokens FROM best
JOIN pl w ON w.file_id = file_a AND w.pos = fa JOIN pl x ON x.file_id = file_a AND x.pos = ta JOIN pl y ON y.file_id = file_b AND y.pos = fb JOIN pl z ON z.file_id = file_b AND z.pos = tb
WHERE n >= 10""",
        "legacy_pairs": f"""WITH {_WINNOW}{_PAIRS}, {_COLLAPSED[len(_TOKENS) + 2:]}{_LEGACY}
SELECT file_a, file_b, count(DISTINCT x.hash) AS blocks, min(x.s) AS start_a, max(x.e) AS end_a, min(y.s) AS start_b, max(y.e) AS end_b
FROM pairs0 JOIN lb x ON x.file_id = file_a JOIN lb y ON y.file_id = file_b AND y.hash = x.hash GROUP BY file_a, file_b HAVING count(DISTINCT x.hash) >= 2""",
        "duplication_report": f"""SELECT 'token' AS mode, tokens AS total, duplicated, {pct('duplicated', 'tokens')} AS percent FROM (WITH {_DUP_TOTALS} SELECT * FROM dup0)
""" + "".join(f"""UNION ALL SELECT '{mode}', total, duplicated, {pct('duplicated', 'total')} FROM (WITH {runs} SELECT (SELECT sum(l) FROM (SELECT max(line) AS l FROM tok GROUP BY file_id)) AS total,
  (SELECT count(DISTINCT (file_id, line)) FROM (SELECT file_id, unnest(range(start_line, end_line + 1)) AS line FROM runs)) AS duplicated)
""" for mode, runs in (("sonar", _RUNS), ("sonar-normalized", _RUNS.replace(*_ALIKE)))),
        "function_shapes": "SELECT DISTINCT file_id, name, start_line, end_line, complexity AS cyclomatic, parameter_count AS parameters FROM functions WHERE complexity IS NOT NULL",
        "file_counts": """SELECT DISTINCT file_id, function_count AS functions, class_count AS classes, cyclomatic_complexity AS complexity FROM files
WHERE function_count > 0 AND class_count IS NOT NULL AND cyclomatic_complexity IS NOT NULL AND file_id IS NOT NULL""",
        "reported_blocks": r"""WITH o AS (SELECT block_id, token_count, unnest(occurrences) AS o FROM duplicate_blocks WHERE block_id IS NOT NULL),
b AS (SELECT DISTINCT block_id, token_count FROM duplicate_blocks WHERE block_id IS NOT NULL),
d AS (SELECT DISTINCT block_id, token_count, replace(o.file, '\', '/') AS file, o.start_line AS s, o.end_line AS e FROM o)
SELECT b.block_id, max(b.token_count) AS token_count, (SELECT count(file) FROM d WHERE d.block_id = b.block_id) AS occurrences, (SELECT count(DISTINCT file) FROM d WHERE d.block_id = b.block_id) AS files
FROM b GROUP BY b.block_id""",
        "coverage_by_file": f"""WITH {_COV} SELECT cf.path, total, covered, coalesce(u, []) AS uncovered, {pct("covered", "total")} AS percent FROM cf LEFT JOIN (
  SELECT path, list_sort(list(DISTINCT line)) AS u FROM cov WHERE coalesce(hits, 0) <= 0 GROUP BY path) x USING (path)""",
        "coverage_totals": f"WITH {_COV} SELECT count(*) AS files, sum(total) AS total, sum(covered) AS covered, {pct('sum(covered)', 'sum(total)')} AS percent FROM cf",
        "coverage_by_category": f"""WITH {_COV} SELECT category, count(DISTINCT path) AS files, count(*) AS total, count(*) FILTER (hits > 0) AS covered,
  {pct("count(*) FILTER (hits > 0)", "count(*)")} AS percent FROM cov GROUP BY category""",
        "coverage_lowest": f"WITH {_COV} SELECT path, total, covered, {pct('covered', 'total')} AS percent FROM cf WHERE covered < total ORDER BY percent, path LIMIT 10",
        "new_code_coverage": f"""WITH {_COV}, s AS (SELECT path, line, max(hits) AS hits FROM cov GROUP BY path, line),
n AS (SELECT DISTINCT path, line FROM cov WHERE commit IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))
SELECT count(*) AS total, count(*) FILTER (hits > 0) AS covered, {pct("count(*) FILTER (hits > 0)", "count(*)")} AS percent FROM s SEMI JOIN n USING (path, line)""",
        "snapshot_status": f"""WITH {_HALVES}, p AS (SELECT user_id, event_type FROM marked WHERE early QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
c AS (SELECT user_id, event_type FROM marked QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT 'u/' || CAST(coalesce(p.user_id, c.user_id) AS VARCHAR) AS path, CASE WHEN p.user_id IS NULL THEN 'added' WHEN c.user_id IS NULL THEN 'removed'
  WHEN p.event_type IS NOT DISTINCT FROM c.event_type THEN 'unchanged' ELSE 'changed' END AS status FROM p FULL JOIN c ON p.user_id = c.user_id""",
        "issue_lifecycle": f"WITH {_LIFE} SELECT * FROM life",
        "lifecycle_counts": f"WITH {_LIFE} SELECT status, count(*) AS issues FROM life GROUP BY status",
        "advisory_severity": f"""WITH {_ADV}, w AS (SELECT ecosystem, osv_id, min(rank) AS r FROM adv GROUP BY ALL)
SELECT ecosystem, {_NAMES}[r + 1] AS severity, count(*) AS advisories FROM w GROUP BY ALL""",
        "packages_at_risk": f"""WITH {_ADV} SELECT ecosystem, name, count(DISTINCT osv_id) AS advisories, count(DISTINCT version) AS versions, max(cvss) AS worst_cvss
FROM adv GROUP BY ecosystem, name ORDER BY advisories DESC, ecosystem, name LIMIT 20""",
        "package_vulnerabilities": f"""WITH {_ADV}, p AS (SELECT DISTINCT lower(ecosystem) AS ecosystem, name, version FROM advisories WHERE cvss >= 4)
SELECT ecosystem, name, version, osv_id, {_NAMES}[min(rank) + 1] AS severity FROM p JOIN adv USING (ecosystem, name, version) GROUP BY ALL""",
        "snippet_quality_gate": snippets.rstrip() + f", {_COV}, {_DUP_TOTALS}, v AS (" + f"""
  SELECT severity || '_issues' AS "check", n AS value, 0.0::DOUBLE AS threshold, n <= 0 AS passed FROM (SELECT s AS severity, (SELECT count(*) FROM issues WHERE severity = s)::DOUBLE AS n FROM (VALUES ('blocker'), ('critical')) x(s))
  UNION ALL SELECT 'coverage', p, 80.0, p >= 80 FROM (SELECT {pct("sum(covered)", "sum(total)")} AS p FROM cf)
  UNION ALL SELECT 'duplication', p, 3.0, p <= 3 FROM (SELECT {pct("duplicated", "tokens")} AS p FROM dup0)) SELECT * FROM v""",
        "file_complexity": f"""WITH {_ALL_TOKENS}, d AS (
  SELECT file_id, text, sum(CASE text WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY unit ROWS UNBOUNDED PRECEDING) AS depth FROM tok
) SELECT file_id, count(*) FILTER (text IN ('if', 'elif', 'for', 'while', 'do', 'case', 'catch', 'except', '&&', '||', '??', 'and', 'or', '?')) + 1 AS cyclomatic, coalesce(sum(1 + greatest(depth, 0)) FILTER (text IN ('if', 'elif', 'for', 'while', 'do', 'catch', 'except', 'switch', 'match')), 0) AS nested, greatest(max(depth), 0) AS depth
FROM d GROUP BY file_id""",
        "function_complexity": f"""WITH {_ALL_TOKENS}, f AS (SELECT DISTINCT function_id, file_id, start_line, end_line FROM functions WHERE function_id IS NOT NULL AND file_id IS NOT NULL)
SELECT function_id, count(t.text) AS tokens, count(*) FILTER (t.text IN ('if', 'elif', 'for', 'while', 'do', 'case', 'catch', 'except', '&&', '||', '??', 'and', 'or', '?')) + 1 AS cyclomatic
FROM f LEFT JOIN tok t ON t.file_id = f.file_id AND t.line BETWEEN f.start_line AND f.end_line GROUP BY function_id""",
        "read_lcov": _rows("report, path, line, hits", *(("unit/lcov.info", "src/core/a.ts", i, h) for i, h in ((1, 1), (2, 5), (3, 0), (4, 1), (5, 0))), ("unit/lcov.info", "src/b.spec.ts", 1, 2), ("unit/lcov.info", "src/b.spec.ts", 2, 2), ("unit/lcov.info", "src/open.ts", 7, 0)),
        "read_cobertura": _rows("report, path, line, hits", ("it/cobertura.xml", "src/core/a.ts", 1, 3), ("it/cobertura.xml", "src/core/a.ts", 9, 0), ("it/cobertura.xml", "src/c.ts", 2, 1)),
        "read_jacoco": _rows("report, path, total, covered", ("it/jacoco.xml", "A.java", 8, 6), ("it/jacoco.xml", "x/B", 1, 0)),
        "read_coverage": _rows("category, path, total, covered", ("unit", "src/core/a.ts", 5, 3), ("unit", "src/b.spec.ts", 2, 2), ("unit", "src/open.ts", 1, 0), ("integration", "src/core/a.ts", 2, 1), ("integration", "src/c.ts", 1, 1), ("integration", "A.java", 8, 6), ("integration", "x/B", 1, 0)),
        "read_coverage_kept": _rows("files, total, covered, percent", (2, 6, 3, 50.0)),
        "coverage_formats": _rows("path, format", ("unit/lcov.info", "lcov"), ("it/cobertura.xml", "cobertura"), ("it/jacoco.xml", "jacoco"), ("it/broken.xml", "cobertura"), *((p, None) for p in ("notes.txt", "p/package-lock.json", "q/package-lock.json", "Cargo.lock", "go.sum", "app/pubspec.lock", "out/jest.txt", "zap.json", "report.sarif"))),
        "read_locks": _rows("name, version, ecosystem, source_file", ("left", "1.2.0", "npm", "p/package-lock.json"), ("right", "3.0.1", "npm", "p/package-lock.json"), ("top", "2.0.0", "npm", "q/package-lock.json"), ("deep", "0.1.0", "npm", "q/package-lock.json"),
          ("quartz-core", "0.4.2", "crates.io", "Cargo.lock"), ("closed-by-section", "0.2.0", "crates.io", "Cargo.lock"), ("last-one", "0.5.0", "crates.io", "Cargo.lock"), ("mod.example/a", "1.2.3", "Go", "go.sum"), ("mod.example/b", "0.9.0+incompatible", "Go", "go.sum"),
          ("collect", "1.18.0", "Pub", "app/pubspec.lock"), ("paths", "1.8.3", "Pub", "app/pubspec.lock")),
        "read_lock_files": _rows("lock_files, packages", (5, 11)),
        "read_test_cases": _rows("report, file, name, status, duration_ms", ("out/jest.txt", "unit/a.spec.ts", "adds two numbers", "passed", 3), ("out/jest.txt", "unit/a.spec.ts", "fails slowly", "failed", 1500), ("out/jest.txt", "unit/a.spec.ts", "skipped for now", "skipped", None),
          ("out/jest.txt", "unit/b.spec.ts", "breaks", "failed", None), ("out/jest.txt", "unit/b.spec.ts", "still works", "passed", None)),
        "read_test_summary": _rows("path, passed, failed, skipped, total", ("out/jest.txt", 2, 2, 1, 5)),
        "read_alerts": _rows("alert, severity, risk, cweid, instances", ("Header missing", "major", 1, 693, 2), ("Script injection", "blocker", 3, 79, 1), ("Odd", "minor", 7, 0, 0), ("Note", "info", 0, 0, 0), ("Redirect", "critical", 2, 0, 0)),
        "alert_gate": _rows('"check", value, threshold, passed', ("alert_blocker_issues", 1.0, 0.0, False), ("alert_critical_issues", 1.0, 0.0, False), ("gate", 2.0, 0.0, False)),
        "read_sarif": _rows("path, line, rule_id, level, message", ("src/a.ts", 3, "no-eval", "error", "eval"), (None, None, "no-var", "warning", "var")),
        "significant_paths": _rows("path, significant", ("src/core/a.ts", True), ("src\\core\\b.ts", True), ("lib/x/gen/c.ts", False), ("src/core/a_test.ts", False), ("tests/d.ts", False), ("main.go", True), ("srcX/e.ts", False)),
        "language_names": _rows("name, language", ("TS", "typescript"), ("golang", "go"), ("C++", "cpp"), ("c#", "csharp"), ("Shell", "bash"), ("md", "markdown"), ("rust", "rust"), ("cobol", "other"), ("", "other")),
        "unified_diff": "SELECT 'a.txt' AS path, '--- a.txt' || chr(10) || '+++ a.txt' || chr(10) || '@@ 1 lines @@' || chr(10) || ' b' || chr(10) || ' c' || chr(10) || ' d' || chr(10) || '-e' || chr(10) || '+E' || chr(10) || ' f' || chr(10) || ' g' || chr(10) || ' h' AS diff",
        "rules_listing": _rows("rule_id, severity", ("go/avoid-print", "minor"), ("go/avoid-empty-block", "major"), ("go/error-check", "critical"), ("go/avoid-init", "minor"), ("go/avoid-global-var", "info"), ("go/exported-comment", "info")),
        "vulnerability_list": f"""WITH {_ADV}, p AS (SELECT DISTINCT lower(ecosystem) AS ecosystem, name, version FROM advisories WHERE cvss >= 4),
v AS (SELECT ecosystem, name, version, osv_id, min(rank) AS r FROM p JOIN adv USING (ecosystem, name, version) GROUP BY ALL)
SELECT ecosystem, name, version, osv_id, {_NAMES}[r + 1] AS severity, row_number() OVER (PARTITION BY ecosystem ORDER BY r DESC, name, version, osv_id) AS position FROM v QUALIFY position <= 20""",
        "vulnerability_counts": f"WITH {_ADV}, v AS (SELECT ecosystem, name, version, osv_id, min(rank) AS r FROM adv WHERE ecosystem IS NOT NULL AND version IS NOT NULL GROUP BY ALL) SELECT {_NAMES}[i + 1] AS severity, (SELECT count(*) FROM v WHERE r = i) AS issues FROM range(5) t(i)",
        "dependency_gate": f"""WITH {_ADV}, v AS (SELECT ecosystem, name, version, osv_id, min(rank) AS r FROM adv WHERE ecosystem IS NOT NULL AND version IS NOT NULL GROUP BY ALL),
c AS (SELECT 'dependency_' || {_NAMES}[i + 1] || '_issues' AS "check", (SELECT count(*) FROM v WHERE r = i)::DOUBLE AS value FROM range(2) t(i))
SELECT "check", value, 0.0::DOUBLE AS threshold, value <= 0 AS passed FROM c UNION ALL SELECT 'gate', (count(*) FILTER (value > 0))::DOUBLE, 0.0, bool_and(value <= 0) FROM c""",
        "full_gate": snippets.rstrip() + f""", worst AS (SELECT file_id, min({_RANK}) AS w FROM issues GROUP BY file_id),
ra AS (SELECT kind || '_rating' AS c, (SELECT count(*) FROM worst WHERE w <= k) * 100.0::DOUBLE / {len(SNIPPETS)} AS share FROM (VALUES ('reliability', 0), ('security', 1), ('maintainability', 2)) v(kind, k)), {_COV}, {_DUP_TOTALS},
sx AS (SELECT path, line, max(hits) AS hits FROM cov GROUP BY path, line), nx AS (SELECT DISTINCT path, line FROM cov WHERE commit IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)), checks AS (
  SELECT c AS "check", CASE WHEN share < 5 THEN 0 WHEN share < 10 THEN 1 WHEN share < 20 THEN 2 WHEN share < 50 THEN 3 ELSE 4 END::DOUBLE AS value, 2.0::DOUBLE AS threshold, share < 20 AS passed FROM ra
  UNION ALL SELECT 'duplication', p, 3.0, p <= 3 FROM (SELECT {pct("duplicated", "tokens")} AS p FROM dup0)
  UNION ALL SELECT 'coverage', p, 50.0, p >= 50 FROM (SELECT {pct("sum(covered)", "sum(total)")} AS p FROM cf)
  UNION ALL SELECT 'new_coverage', p, 80.0, p >= 80 FROM (SELECT {pct("count(*) FILTER (hits > 0)", "count(*)")} AS p FROM sx SEMI JOIN nx USING (path, line))
  UNION ALL SELECT s || '_issues', (SELECT count(*) FROM issues WHERE severity = s)::DOUBLE, 0.0, NOT EXISTS (SELECT 1 FROM issues WHERE severity = s) FROM (VALUES ('blocker'), ('critical')) x(s))
SELECT * FROM checks UNION ALL SELECT 'gate', (count(*) FILTER (NOT passed))::DOUBLE, 0.0, bool_and(passed) FROM checks""",
        "new_code_issues": f"""WITH {_LIFE} SELECT path, count(*) AS issues FROM life WHERE status <> 'fixed' AND (status IN ('new', 'regressed') OR path IN (SELECT 'u/' || CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'error' AND user_id IS NOT NULL)) GROUP BY path""",
        "significant_issues": _ISSUES + r"SELECT count(*) FILTER (s) AS significant, count(*) FILTER (NOT s) AS other FROM (SELECT replace(path, '\', '/') LIKE 'src/%' AND NOT contains(path, 'test') AS s FROM issues)",
        "new_coverage_by_file": f"WITH {_COV}, o AS (SELECT path, sum(line) AS h FROM cov WHERE line <= 3 GROUP BY path), n AS (SELECT path, sum(line) AS h FROM cov GROUP BY path) SELECT sum(total) AS total, sum(covered) AS covered, {pct('sum(covered)', 'sum(total)')} AS percent FROM cf JOIN n USING (path) LEFT JOIN o USING (path) WHERE o.h IS DISTINCT FROM n.h",
        "merged_snapshot": f"""WITH {_HALVES}, p AS (SELECT user_id, event_type AS h FROM marked WHERE early QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
c AS (SELECT user_id, event_type AS h FROM marked QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
m AS (SELECT * FROM c WHERE h <> 'error' UNION ALL SELECT * FROM p WHERE user_id NOT IN (SELECT user_id FROM c WHERE h <> 'error')), j AS (SELECT c.h IS NOT DISTINCT FROM p.h AND p.h IS NOT NULL AS same FROM c LEFT JOIN p USING (user_id))
SELECT (SELECT count(*) FROM m) AS paths, (SELECT count(DISTINCT h) FROM m) AS hashes, (SELECT count(*) FROM j WHERE NOT same) AS todo, (SELECT count(*) FROM j WHERE same) AS unchanged""",
        "event_bursts": bursts,
        "event_bursts_streamed": bursts,
        "test_cases": """SELECT strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d') AS file, count(*) FILTER (event_type IS DISTINCT FROM 'error') AS passed, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1""",
        "content_hashes": f"""SELECT DISTINCT file_id, sha256(text) AS hash, length(text) AS chars, CASE WHEN text = '' THEN 0 ELSE len({_LINES}) END AS lines,
  list_reduce(list_prepend(0::BIGINT, [unicode(c)::BIGINT for c in string_split(path, '')]), lambda a, c: (a * 31 + c) % 4294967296) AS u,
  CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS path_hash FROM files WHERE file_id IS NOT NULL""",
        "largest_functions": """SELECT * FROM (SELECT DISTINCT function_id, path, start_line, name, complexity FROM functions WHERE function_id IS NOT NULL)
ORDER BY complexity DESC NULLS LAST, path, start_line, function_id LIMIT 10""",
        "function_rank_by_file": """SELECT function_id, file_id, row_number() OVER w AS rank, lag(function_id) OVER w AS before
FROM (SELECT DISTINCT function_id, file_id, complexity FROM functions WHERE function_id IS NOT NULL) WINDOW w AS (PARTITION BY file_id ORDER BY complexity DESC NULLS LAST, function_id)""",
    }
    found["content_hashes"] = f"SELECT file_id, hash, chars, lines, path_hash FROM ({found['content_hashes']})"
    return found
