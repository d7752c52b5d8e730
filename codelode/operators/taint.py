"""User input that reaches dangerous calls, followed through declarations and assignments within each function.

All of it happens in one text: names taint names for a bounded number of passes over the assignments of a function. So one Arrow pass does it, without joins.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from codelode.operators.structure import WEB, Code, Function

#: How often the assignments of a function are gone through.
PASSES = 3


class Weakness(NamedTuple):
    severity: str
    sources: str
    sinks: str
    safe: str


# Fixed values, by rule: where input enters (object and property, * for any), the calls or properties it must not reach (with their
# object where only that one counts), and names that make a value safe.
WEB_CLASSES: dict[str, Weakness] = {
    "security/sql-injection": Weakness(
        "blocker",
        "req.body req.query req.params request.body request.query request.params ctx.request ctx.query event.body event.queryStringParameters input.*",
        "query db.query connection.query pool.query client.query knex.raw raw $queryRaw $queryRawUnsafe $executeRaw $executeRawUnsafe sql execute db.all db.run",
        "escape parameterize sanitize format mysql.escape pg.escapeLiteral escapeLiteral escapeIdentifier",
    ),
    "security/xss": Weakness(
        "critical",
        "req.body req.query req.params request.body request.query ctx.request ctx.query props.* this.props",
        "innerHTML outerHTML document.write document.writeln dangerouslySetInnerHTML insertAdjacentHTML $.html jQuery.append res.send res.end res.json",
        "escapeHtml encodeURI encodeURIComponent sanitize DOMPurify.sanitize xss he.encode escape",
    ),
    "security/ssrf": Weakness(
        "critical",
        "req.body req.query req.params request.body ctx.request event.body",
        "fetch axios.get axios.post axios.put axios.request http.get https.get http.request https.request request.get request.post rp.get got.get got.post needle.send superagent.get",
        "isValidUrl validateUrl isAllowedHost normalizeUrl",
    ),
    "security/command-injection": Weakness(
        "blocker",
        "req.body req.query req.params request.body ctx.request input.*",
        "exec child_process.exec execSync child_process.execSync spawn spawnSync execFile system shelljs.exec",
        "escape sanitize shellEscape quote",
    ),
    "security/path-traversal": Weakness(
        "critical",
        "req.body req.query req.params request.body ctx.request",
        "fs.readFile fs.readFileSync fs.writeFile fs.writeFileSync fs.appendFile fs.unlink fs.unlinkSync fs.mkdir fs.rmdir fs.createReadStream fs.createWriteStream fs.stat fs.lstat fs.readdir fs.access fs.open readFileSync writeFileSync",
        "normalize resolve basename dirname sanitize",
    ),
    "security/prototype-pollution": Weakness(
        "major",
        "req.body req.query JSON.parse request.body ctx.request",
        "merge defaultsDeep jQuery.extend Object.assign Object.defineProperty lodash.set lodash.setWith lodash.zipObjectDeep deepExtend deepMerge cloneDeep",
        "isSafeKey hasOwnProperty sanitizeKeys",
    ),
    "security/open-redirect": Weakness(
        "major",
        "req.query req.body req.params request.query ctx.query",
        "res.redirect response.redirect ctx.redirect res.writeHead location.set window.location.replace window.location.assign location.href",
        "isSafeUrl isAllowedOrigin normalizeUrl isValidRedirect",
    ),
    "security/log-injection": Weakness(
        "minor",
        "req.body req.query req.params ctx.request input.*",
        "logger.info logger.warn logger.error logger.debug console.log console.info console.warn console.error winston.info log4js.log pino.info",
        "replace trim normalize stripControlChars",
    ),
}
DART_CLASSES: dict[str, Weakness] = {
    "security/flutter-http-injection": Weakness(
        "major",
        "request.* queryParameters.* data.* params.* arguments.* snapshot.* settings.*",
        "http.get http.post http.put http.delete dio.get dio.post dio.put dio.delete dio.request fetch",
        "validateUrl sanitize encode",
    ),
    "security/flutter-path-traversal": Weakness(
        "critical",
        "request.* arguments.* params.*",
        "File.readAsString File.readAsStringSync File.writeAsString File.writeAsStringSync File.readAsBytes File.writeAsBytes File.open File.copy File.rename File.stat",
        "normalize basename sanitize",
    ),
    "security/flutter-sql-injection": Weakness(
        "blocker",
        "request.* arguments.* params.* data.*",
        "rawQuery rawInsert rawUpdate rawDelete database.execute database.query customSelect customInsert customUpdate customDelete customStatement",
        "escape parameterize sanitize",
    ),
}
SEVERITIES = {rule: w.severity for rule, w in {**WEB_CLASSES, **DART_CLASSES}.items()}


def _split(values: str) -> list[tuple[str, str]]:
    return [(v.rpartition(".")[0], v.rpartition(".")[2]) for v in values.split()]


_PARSED = {rule: (_split(w.sources), _split(w.sinks), frozenset(s.rpartition(".")[2] for s in w.safe.split())) for rule, w in {**WEB_CLASSES, **DART_CLASSES}.items()}
_SINK_NAMES = frozenset(name for _, sinks, _ in _PARSED.values() for _, name in sinks)
_SOURCE_OBJECTS = frozenset(o for sources, _, _ in _PARSED.values() for o, _ in sources)


_HOLES = re.compile(r"\$\{((?:[^{}]|\{[^{}]*\})*)\}|\$(\w+)")
_NAMES = re.compile(r"[A-Za-z_$][\w$]*")


def _receiver(c: Code, i: int) -> str:
    """The dotted names before a member, ``File`` for ``File(x).open``."""
    parts, j = [], i
    while c.is_(j - 1, ".", "?."):
        j -= 2
        if c.is_(j, ")") and c.mate[j] >= 0:
            j = c.mate[j] - 1
        if j < 0 or c.k[j] != "i":
            break
        parts.append(c.x[j])
    return ".".join(reversed(parts))


def _source_at(c: Code, i: int, sources: list[tuple[str, str]]) -> bool:
    if c.k[i] != "i" or c.x[i] not in _SOURCE_OBJECTS or not (c.is_(i + 1, ".", "?.", "[")):
        return False
    if c.is_(i - 1, ".", "?.") and not c.is_(i - 2, "this"):
        return False
    then = c.x[i + 2] if i + 2 < c.n else ""
    return any(o == c.x[i] and (p == "*" or p == then) for o, p in sources)


def _words(c: Code, a: int, b: int) -> set[str]:
    found = {c.x[i] for i in range(a, b) if c.k[i] == "i" and not c.is_(i - 1, ".", "?.")}
    for i in range(a, b):
        if c.k[i] == "t" or c.k[i] == "s" and c.language == "dart":
            found.update(_NAMES.findall(" ".join(x or y for x, y in _HOLES.findall(c.x[i]))))
    return found


def _has_source(c: Code, a: int, b: int, sources: list[tuple[str, str]]) -> bool:
    if any(_source_at(c, i, sources) for i in range(a, b)):
        return True
    for i in range(a, b):
        if c.k[i] == "t":
            for hole, _ in _HOLES.findall(c.x[i]):
                if any(re.search(rf"\b{re.escape(o)}\." + (r"\w" if p == "*" else rf"{re.escape(p)}\b"), hole) for o, p in sources):
                    return True
    return False


def _assignments(c: Code, a: int, b: int, declared: dict[int, tuple[int, int]]) -> list[tuple[list[str], int, int]]:
    """Names with the value they get, declared or assigned, between two places; of ``{ x, y } = value`` all the names."""
    out = []
    for i in range(a, b):
        if i in declared:
            out.append(([c.x[i]], *declared[i]))
        elif c.is_(i, "=") and c.k[i] == "p":
            if c.k[i - 1] == "i" and i - 1 not in declared and not c.is_(i - 2, ".", "?."):
                out.append(([c.x[i - 1]], i + 1, c.expression_end(i + 1)))
            elif c.is_(i - 1, "}") and c.mate[i - 1] >= 0:
                out.append(([c.x[j] for j in range(c.mate[i - 1], i - 1) if c.k[j] == "i" and not c.is_(j + 1, ":")], i + 1, c.expression_end(i + 1)))
    return out


def taint_hits(c: Code) -> list[tuple[int, str]]:
    """``(line, rule)`` of the calls that input reaches, each once."""
    sinks = [i for i in range(c.n) if c.k[i] == "i" and c.x[i] in _SINK_NAMES and (c.is_(i + 1, "(", "=") or c.k[min(i + 1, c.n - 1)] == "t" or c.is_(i + 1, "."))]
    if not sinks or not any(w in _SOURCE_OBJECTS for w in c.x):
        return []
    declared = {n: (a, b) for _, n, a, b in c.declarators() if a >= 0}
    found: dict[tuple[int, str], None] = {}
    for f in c.functions:
        a, b = f.body
        here = [i for i in sinks if a < i <= b]
        if here:
            _in_function(c, f, here, declared, found)
    return list(found)


def _in_function(c: Code, f: Function, sinks: list[int], declared: dict, found: dict) -> None:
    a, b = f.body[0], min(f.body[1] + 1, c.n)
    sets = [(names, x, y, _words(c, x, y), {c.x[i] for i in range(x, y) if c.k[i] == "i"}) for names, x, y in _assignments(c, a, b, declared)]
    for rule, (sources, dangerous, safe) in _PARSED.items():
        if (rule in WEB_CLASSES) != (c.language in WEB):
            continue
        objects = {o for o, _ in sources}
        tainted: set[str] = set()
        for names, x, y, _, every in sets:
            if not every & safe and (_has_source(c, x, y, sources) or len(names) > 0 and y == x + 1 and c.x[x] in objects and c.is_(x - 2, "}")):
                tainted.update(names)
        for _ in range(PASSES if tainted else 0):
            tainted.update(n for names, _, _, used, every in sets if used & tainted and not every & safe for n in names)
        for i in sinks:
            obj = _receiver(c, i)
            if not any(name == c.x[i] and (not o or obj == o or obj.endswith("." + o)) for o, name in dangerous):
                continue
            if c.is_(i + 1, "("):
                x, y = i + 2, max(c.mate[i + 1], i + 2)
            elif c.is_(i + 1, "="):
                x, y = i + 2, c.expression_end(i + 2)
            elif c.k[min(i + 1, c.n - 1)] == "t":
                x, y = i + 1, i + 2
            else:
                continue
            if any(c.k[j] == "i" and c.x[j] in safe for j in range(x, y)):
                continue
            if _words(c, x, y) & tainted or _has_source(c, x, y, sources):
                found[(c.l[i], rule)] = None
