"""Source files that do not parse, by table-driven parsers for six languages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm import early, grammars
from codelode.llm.lalr import Tables, build, first_error, starts_badly

BAD = "\x01"
#: Files are judged by the language their extension claims. JSX is beyond the grammars: ``.tsx`` and ``.jsx`` are not judged.
EXTENSIONS = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python", "go": "go", "rs": "rust", "dart": "dart",
}

_BLOCK = r"/\*(?:[^*]|\*(?!/))*\*/"
_NESTED = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/)*\*/"
_DQ, _SQ = r"\"(?:[^\"\\\n]|\\(?s:.))*\"", r"'(?:[^'\\\n]|\\(?s:.))*'"
_SUBST = rf"\$\{{(?:[^{{}}`'\"]|{_DQ}|{_SQ}|`(?:[^`\\]|\\(?s:.))*`|\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*\}}"
_TEMPLATE = rf"`(?:[^`\\$]|\\(?s:.)|\$(?!\{{)|{_SUBST})*`"
_BEFORE_REGEX = r"(?:(?<=[=(,:;!&|?{}\[\n+*%<>~^-])|(?<=[=(,:;!&|?{}\[\n+*%<>~^-] )|(?<=return )|(?<=typeof )|(?<=case )|(?<=^))"
_REGEX = rf"{_BEFORE_REGEX}/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*"
_NUM = r"(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.(?!\.)[\d_]*)?(?:[eE][+-]?[\d_]+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)\w*"
_ID = r"[^\W\d][\w$]*|\$[\w$]*"
_TRIPLE = r"\"\"\"(?:[^\"\\]|\\(?s:.)|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\(?s:.)|'(?!''))*'''"
_DART_SUBST = rf"\$\{{(?:[^{{}}'\"]|{_SQ}|{_DQ}|\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*\}}"
_DART_STR = "|".join(rf"{q}(?:[^{q}\\\n$]|\\(?s:.)|\$(?!\{{)|{_DART_SUBST})*{q}" for q in ("'", '"'))


def _ops(text: str) -> str:
    return "|".join(re.escape(o) for o in sorted(text.split(), key=len, reverse=True))


_JS_OPS = "=== !== == != <= >= && || ?? ?. ** / % ^ += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= << => ... ++ -- { } ( ) [ ] ; , < > + - * & | ! ~ ? : = . @"
_GO_OPS = "== != <= >= && || / % << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= := ... ++ -- <- { } ( ) [ ] ; , < > + - * & | ^ ! ~ : = ."
_RS_OPS = "== != <= >= && || / % << += -= *= /= %= ^= &= |= <<= ..= ... .. :: -> => { } ( ) [ ] ; , < > + - * & | ^ ! ? : = . @ # $ ~"
_DART_OPS = "== != <= >= && || ?? / % ~/ ^ << += -= *= /= ~/= %= <<= &= ^= |= ??= => ... ...? .. ?.. ?. ++ -- { } ( ) [ ] ; , < > + - * & | ! ~ ? : = . @ #"
_PY_OPS = "== != <= >= << >> // ** += -= *= /= //= %= @= &= |= ^= >>= <<= **= -> := ... { } ( ) [ ] ; , < > + - * / & | ^ ~ % : = . @"
_ASSIGN = set("+= -= *= /= %= &= |= ^= <<= >>= &^= := ~/= ??=".split())
_AUG = set("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())


class Kinds(dict):
    """The terminal of a token by its text, found once for each text."""

    def __init__(self, language: str, tables: Tables) -> None:
        super().__init__()
        self.language, self.terminals = language, tables.terminals

    def __missing__(self, token: str) -> str:
        if len(self) > 500_000:
            self.clear()
        kind = self[token] = self._kind(token)
        return kind

    def _kind(self, token: str) -> str:
        t, language, c = self.terminals, self.language, token[0]
        get = lambda name: t.get(name, BAD)
        if c == "\n":
            return "\n"
        if token.startswith(("//", "/*")) and language != "python":
            return "\n" if "\n" in token else ""
        if language == "python" and c in "#\\":
            return ("" if token != "\\" else BAD) if c == "\\" else ""
        if token.startswith("#!"):
            return t.get("HASHBANG", "")
        if language == "go":
            if c in "\"`" and len(token) > 1:
                return get("STR")
            if c == "'" and len(token) > 1:
                return get("RUNE")
        elif language == "rust":
            if re.fullmatch(r"(?s)[bc]?r?#*\".*\"#*", token) and len(token) > 1:
                return get("STR")
            if re.match(r"b?'", token):
                return get("CHAR") if len(token) > 2 and token[-1] == "'" else get("LIFETIME") if len(token) > 1 else BAD
            if token == "#":
                return get("OUTER")
            if token == "..=":
                return get("..")
            if token.startswith("r#"):
                return get("ID")
        else:
            if c == "`" and len(token) > 1:
                return get("TPL") if self._template(token) else BAD
            if len(token) > 1 and token[-1] in "'\"" and re.match(r"[A-Za-z]{0,2}['\"]", token):
                return get("STR")
            if c == "/" and len(token) > 2 and token not in ("/=",):
                return get("REGEX")
            if c == "#" and language == "dart":
                return get("HASH")
            if c == "#" and len(token) > 1:
                return get("HASHID")
        if c.isdigit() or (c == "." and len(token) > 1 and token[1].isdigit()):
            return get("NUM") if language == "rust" or re.fullmatch(r"(?:0[xXbBoO])?[\d_.a-fA-F]+(?:[eEpP][+-]?\d+)?[nijJlL]?", token) else BAD
        if token in t and not token.isupper():
            return t[token]
        if c.isalpha() or c in "_$":
            return get("ID")
        if token in ("++", "--") and "INCDEC" in t:
            return t["INCDEC"]
        if language == "python":
            return get("AUG") if token in _AUG else get("BINOP") if token in _PY_OPS.split() else BAD
        if language in ("go", "dart") and token in _ASSIGN:
            return get("ASSIGN")
        ops = {"go": _GO_OPS, "rust": _RS_OPS, "dart": _DART_OPS}.get(language, _JS_OPS)
        return get("BINOP") if token in ops.split() and token not in "{}()[];,.:@#$" else BAD

    def _template(self, token: str) -> bool:
        """Whether the expressions within a template literal are valid."""
        if "${" not in token:
            return True
        at = 1
        while (at := token.find("${", at)) >= 0:
            if token[at - 1] == "\\":
                at += 2
                continue
            m = re.compile(_SUBST).match(token, at)
            if not m or parser(self.language).error_line("(" + m[0][2:-1] + ");", True):
                return False
            at = m.end()
        return True


class Parser:
    """The lexer and parser of one language."""

    def __init__(self, language: str) -> None:
        self.language = language
        grammar = {
            "javascript": lambda: grammars.javascript(False), "typescript": lambda: grammars.javascript(True), "python": lambda: grammars.PYTHON,
            "go": grammars.go, "rust": grammars.rust, "dart": lambda: grammars.DART,
        }[language]()
        self.tables = build(grammar)
        self.kinds = Kinds(language, self.tables)
        lexers = {
            "go": [r"//[^\n]*", _BLOCK, r"`[^`]*`", _DQ, r"'(?:[^'\\\n]|\\[^\n]+?)'", _NUM, _ID, _ops(_GO_OPS)],
            "rust": [r"//[^\n]*", _NESTED, r"[bc]?r\"[^\"]*\"|[bc]?r#\"(?:[^\"]|\"(?!#))*\"#|[bc]?r##\"(?:[^\"]|\"(?!##))*\"##",
                     r"[bc]?\"(?:[^\"\\]|\\(?s:.))*\"", r"b?'(?:\\[^\n']+|\\'|[^\\'\n])'", r"'[^\W\d]\w*", r"r#[^\W\d]\w*",
                     r"0[xXbBoO][\da-fA-F_]+\w*|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?[\d_]+)?\w*", r"[^\W\d]\w*", _ops(_RS_OPS)],
            "dart": [r"\A#![^\n]*", r"//[^\n]*", _NESTED, rf"r?(?:{_TRIPLE})", rf"r(?:{_SQ}|{_DQ})", _DART_STR, _NUM, _ID, _ops(_DART_OPS)],
            "python": [r"#[^\n]*", r"\\\r?\n", rf"[rRbBuUfFtT]{{0,2}}(?:{_TRIPLE}|{_DQ}|{_SQ})", _NUM, r"[^\W\d]\w*", _ops(_PY_OPS)],
        }
        js = [r"\A#![^\n]*", r"//[^\n]*", _BLOCK, _TEMPLATE, _DQ, _SQ, _REGEX, _NUM, _ID, r"#[^\W\d][\w$]*", _ops(_JS_OPS)]
        newline = r"\n[ \t]*" if language == "python" else r"\n"
        self.lexer = re.compile("|".join([*lexers.get(language, js), newline, r"\S"]))
        t = self.tables.terminals
        self.semi = t.get("SEMI", "") if language in ("javascript", "typescript") else ""
        if self.semi:
            self.kinds[";"] = self.semi
        self.closers = t["}"]
        self.postfix = t["INCDEC"] if "PREINC" in t else ""
        self.net = {t[c]: n for c, n in zip("([{)]}", (1, 1, 1, -1, -1, -1), strict=True)}
        if language == "go":
            ends = ["ID", "NUM", "STR", "RUNE", "INCDEC", "break", "continue", "fallthrough", "return", ")", "]", "}"]
            self.ends = {t[x] for x in ends}

    def error_line(self, text: str, inner: bool = False) -> int:
        """The line of the first error that no derivation gets past, or of what rules beside the grammar forbid; 0 if the text is valid. An inner text is one expression of another."""
        text = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
        tokens = self.lexer.findall(text)
        parts = "".join(map(self.kinds.__getitem__, tokens)).split("\n")
        if self.language == "python":
            lines, origin = self._indented(parts, [x for x in tokens if x[0] == "\n"], text)
        else:
            lines, origin = [], []
            for i, p in enumerate(parts):
                if p:
                    if p[0] == self.postfix:  # no line end may stand before a postfix operator
                        p = self.tables.terminals["PREINC"] + p[1:]
                    lines.append(p + self.tables.terminals[";"] if self.language == "go" and p[-1] in self.ends else p)
                    origin.append(i)
        bad = first_error(self.tables, lines, self.semi, self.closers)
        if bad < 0:
            return early.python(tokens) if self.language == "python" else early.javascript(tokens) if self.semi and not inner else 0
        part = origin[bad] if bad < len(origin) else len(parts) - 1
        breaks = [m.start() for m in self.lexer.finditer(text) if self.kinds[m[0]] == "\n"]
        return text.count("\n", 0, breaks[part - 1] + 1) + 1 if part else 1

    def dies_within(self, lines: list[str]) -> bool:
        """Whether no valid text begins with these lines; brackets and literals may stay open."""
        text = "\n".join(lines)
        parts = "".join(map(self.kinds.__getitem__, self.lexer.findall(text))).split("\n")
        if any(BAD in p for p in parts):
            parts = [p.split(BAD)[0] for p in parts]
        if self.language == "python":
            parts = [parts[0] + (self.tables.terminals["NEWLINE"] if sum(self.net.get(c, 0) for c in parts[0]) == 0 and parts[0][-1:] != self.tables.terminals[":"] else "")]
        elif self.language == "go":
            parts = [p + self.tables.terminals[";"] if p and p[-1] in self.ends else p for p in parts]
        return starts_badly(self.tables, [p for p in parts if p], self.semi, self.closers)

    def _indented(self, parts: list[str], breaks: list[str], text: str) -> tuple[list[str], list[int]]:
        """Logical lines with indents and dedents."""
        t, net = self.tables.terminals, self.net
        lines: list[str] = []
        origin: list[int] = []
        levels, depth, now, begun = [0], 0, "", 0
        first = len(text) - len(text.lstrip(" \t"))
        for i, p in enumerate(parts):
            if not p:
                continue
            if depth <= 0:
                if now:
                    lines.append(now + t["NEWLINE"])
                    origin.append(begun)
                white = breaks[i - 1][1:] if i else text[:first]
                width, now, begun = len(white.expandtabs(8)), "", i
                if width > levels[-1]:
                    levels.append(width)
                    now = t["INDENT"]
                while width < levels[-1]:
                    levels.pop()
                    now += t["DEDENT"]
                if width != levels[-1]:
                    now += BAD
                depth = 0
            now += p
            depth += sum(net.get(c, 0) for c in p)
        if now:
            lines.append(now + (t["NEWLINE"] if depth <= 0 else ""))
            origin.append(begun)
        lines.append(t["DEDENT"] * (len(levels) - 1))
        origin.append(len(parts) - 1)
        return [x for x in lines if x], origin


@lru_cache(maxsize=None)
def parser(language: str) -> Parser:
    return Parser(language)


def language_of(path: str | None) -> str | None:
    """The language a path's extension claims."""
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()) if path and "." in path else None


def _parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kinds, lines = [], []
        for path, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            language = language_of(path)
            kinds.append(language)
            lines.append(parser(language).error_line(text) if language and text is not None else None)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(kinds, pa.string()), pa.array(lines, pa.int32())], names=["file_id", "claimed", "error_line"]
        )


def parse_files(files: DataFrame) -> DataFrame:
    """``(file_id, claimed, error_line)``: the language a file claims and the line of its first error, 0 if it is valid.

    A null text is not judged (null line), nor is a file whose extension claims none of
    the six languages. An empty text is valid, but for Go, which asks for a package clause.
    Texts are parsed where they are read; a file delivered twice gives its row twice.
    """
    rows = files.where("file_id is not null").select("file_id", "path", "text")
    return rows.mapInArrow(_parse_rows, "file_id long, claimed string, error_line int")


def invalid_rates(files: DataFrame) -> DataFrame:
    """``(repo, language, files, invalid, rate)`` over judged files, each file once."""
    judged = parse_files(files).where("error_line is not null").distinct()
    repos = files.groupBy("file_id").agg(F.min("repo").alias("repo"))
    return (
        judged.join(repos, "file_id")
        .groupBy("repo", F.col("claimed").alias("language"))
        .agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("error_line") > 0).alias("invalid"))
        .withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
    )
