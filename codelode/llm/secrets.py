"""Credentials in source and configuration text: found through encoded layers, and blanked in place."""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LAYERS = 6


class Hit(NamedTuple):
    start: int
    end: int
    kind: str


# Public token formats.
FORMATS = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,}"
    r"|[sr]k_live_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35}"
    r"|npm_[A-Za-z0-9]{36}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,})"
)
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)(PRIVATE KEY|PUBLIC KEY|CERTIFICATE)( BLOCK)?-----")
_PEM_END = re.compile(r"-----END [A-Z0-9 ]+-----")
_PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|[sr]k_live_|xox[abprs]-|AIza|npm_|SG\.|eyJ")
_URL = re.compile(r"://[^\s:/@\"'`<>]*:([^\s/@\"'`<>]+)@")
_CURL = re.compile(r"\bcurl\b[^\n]*?\s(?:-u|--user)\s*[=\s]\s*[\"']?[^\s:\"']+:([^\s\"']+)")
_HEADER = re.compile(r"\b([bB](?:earer|EARER|asic|ASIC))\s+([A-Za-z0-9+/_.~-]{12,}={0,2})")
_PROSE = re.compile(r"\b(?:[pP]ass(?:word|wd|phrase)|[sS]ecret|[tT]oken|[kK]ey)\s+(?:is|was)\s+[\"'`]?([^\s\"'`]{6,}?)[\"'`.,;]?(?=\s|$)")
_LOGIN = re.compile(r"\b(?:[lL]ogin|[cC]red(?:ential)?s?|[aA]ccount)\s*[:=]\s*\S+\s+/\s+([^\s\"'`]{6,})")
_PLACED = re.compile(r"\b(?:connect|login|log_in|authenticate|sign_?[iI]n|signIn|auth)\(\s*[\"'`][^\"'`\n]+[\"'`]\s*,\s*[\"'`]([^\"'`\n]{6,})[\"'`]")
_LITERAL = r"(?:[bBrRuU]{0,2}(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`))"
_JOINED = rf"{_LITERAL}(?:\s*\+\s*{_LITERAL}|[ \t]*\\?\n?[ \t]+{_LITERAL})*"
_NAMED = re.compile(
    r"(?:pass_?word|passwd|passphrase|pass|pwd|secret|token|key|credentials?|creds)\d*([\"'`]?)\]?[ \t]*"
    r"(?::[ \t]*&?[ \t]*'?[a-z][\w<>\[\]?.]*(?:[ \t]+[a-z]\w*)?[ \t]*(?==[ \t]*[br&]?[\"'`c])|)(=>|:=|[=!]={1,2}|=(?![=>])|:(?![:=])|,)[ \t]*(?:concat!\()?"
)  # on lower-cased text
_NAME_START = re.compile(r"[\"'`]?[A-Za-z_]?[\w.\-]*$")
_VALUE = re.compile(rf"{_JOINED}|[^\s\"'`,][^\n]*")
_ENV_OLD = re.compile(r"(?m)^[ \t]*ENV[ \t]+([A-Za-z_]\w*)[ \t]+(\S+)[ \t]*$")
_PLUS = re.compile(r"[\"'`]\s*\+\s*[bBrRuU]{0,2}[\"'`]")
_CONCAT = re.compile(rf"{_LITERAL}(?:\s*\+\s*{_LITERAL})+")
_PIECE = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`")
#: A run of base64 or hex, and such runs that go on over line breaks, written or escaped, or over joined literals.
_BREAK = r"(?:\\r)?\\n(?:[\"'`]\s*\+?\s*[\"'`])?|[\"'`][ \t]*\\?\+?\s*[\"'`]|[ \t]*\\?\r?\n[ \t]*(?:[*#]|//)?[ \t]*"
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{{20,}}(?:(?:{_BREAK})[A-Za-z0-9+/_-]{{20,}})+(?:(?:{_BREAK})[A-Za-z0-9+/_-]+)?={{0,2}}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
#: A stretch between blanks and quotes; those that hold escapes are decoded as a whole.
_FIELD = re.compile(r"[^\s\"'`]+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_ESCAPED = re.compile(
    r"%([0-9a-fA-F]{2})|\\x([0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})|\\u\{([0-9a-fA-F]{1,6})\}|\\U([0-9a-fA-F]{8})|\\(?P<o>[0-3][0-7]{2})|&#x([0-9a-fA-F]{2,6});|&#(?P<d>\d{2,7});"
)
_ALL_ESCAPED = re.compile(r"(?:%[0-9a-fA-F]{2}|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]{1,6}\}|\\U[0-9a-fA-F]{8}|\\[0-3][0-7]{2}|&#x?[0-9a-fA-F]{2,7};){6,}")
_SOURCE = re.compile(r"\.(?:ts|tsx|mts|cts|js|jsx|mjs|cjs|py|pyi|go|rs|dart|java|kt|c|cc|cpp|h|rb|php|swift|cs)$", re.I)

_STRONG = re.compile(
    r"(?:password|passwd|passphrase|pwd|(?:^|smtp|db|user|root|admin|mail|sql|ftp)pass"
    r"|(?:^|client|webhook|app|api|shared|session|jwt|consumer|oauth|hmac|signing|db)secret"
    r"|(?:^|auth|access|private|refresh|bearer|api|session|bot|deploy|oauth|secret|npm|ci)token"
    r"|(?:api|access|secret|private|signing|encryption|master|service|account|deploy|storage)key"
    r"|credentials?|creds)\d*$"
)
_NOTHING = re.compile(
    r"(?i)^(?:(.)\1*|.*\b(?:change[-_ ]?me|todo|tbd|fixme|placeholder|redacted|example|dummy|your|insert|replace|sample|none|null|nil|undefined)\b.*|.*(?-i:EXAMPLE)(?:KEY)?"
    r"|(?:my|the|a|test|set)?[-_ ]?(?:pass(?:word|wd|phrase)?|secret|token|api[-_]?key|key|credentials?)[-_ ]?(?:here)?)$"
)
_ELSEWHERE = re.compile(
    r"(?i)^(?:\$|%\w+%$|\{\{|<|file:|vault:|env[:.(]|env!|ref\+|arn:|ssm:|secretsmanager|sm://|keychain:|op://|!|&|@|(?-i:(?:~|\.{0,2})/[a-z0-9_.-]+(?:/[a-z0-9_.-]+)*/?$))|\$\{|\{\{|process\.env|getenv|environ"
)
_DIGEST = re.compile(r"(?i)^(?:sha\d+|md5|blake\w*)[-:$=]|^\$(?:2[aby]|argon2\w*|pbkdf2\S*|[156])\$|^\{S?SHA|^pbkdf2|^scrypt:|^data:")


def usable(value: str) -> bool:
    """Whether a value given to a secret's name can be one: no placeholder, reference, digest, plain word or sentence."""
    v = value.strip()
    if len(v) < 6 or re.search(r"\s", v) or _NOTHING.match(v) or _ELSEWHERE.search(v) or _DIGEST.match(v) or "://" in v:
        return False
    if re.fullmatch(r"[\d.,:_-]+", v) or re.fullmatch(r"[A-Za-z]*(?:[-_./ ][A-Za-z]+)*[()\[\]{}]*", v) and len(v) < 20:
        return False
    if re.search(r"\d", v):
        return bool(re.search(r"[A-Za-z]", v) or re.search(r"[^\w.,:-]", v))
    if re.fullmatch(r"[a-z]+(?:[-_./ ][a-z]+)*", v) or re.fullmatch(r"[A-Z]+(?:[-_./ ][A-Z]+)*", v):
        return False
    turns = len(re.findall(r"[a-z][A-Z]|[A-Z][a-z]", v))
    return bool(re.search(r"[^\w\s.,:/()\[\]{}-]", v)) or (len(v) >= 20 and turns * 3 >= len(v))


def secret_name(name: str) -> bool:
    words = re.sub(r"[^A-Za-z0-9]", "", name.rsplit(".", 1)[-1]).lower()
    return bool(_STRONG.search(words)) and not re.search(r"(?:public|hash(?:ed)?|digest|checksum)", words)


def der_kind(data: bytes) -> str | None:
    """What a DER structure or SSH container is by its grammar: ``private``, ``public`` or None."""
    if data.startswith(b"openssh-key-v1\0"):
        return "private"
    top = _der(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return None
    parts = _der(data, *top[0][1:])
    tags = [p[0] for p in parts or ()]
    if not tags:
        return None
    number = tags[0] == 0x02 and parts[0][2] - parts[0][1] == 1 and data[parts[0][1]] in (0, 1)
    if number and (tags[1:3] == [0x30, 0x04] or tags[1:2] == [0x04] or (len(tags) >= 6 and set(tags[:6]) == {0x02})):
        return "private"
    if tags in ([0x30, 0x03], [0x30, 0x30, 0x03], [0x02, 0x02]):
        return "public"
    return None


def _der(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of the values of consecutive DER elements; None if they don't fill the range."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return None
            size, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def _layers(run: str) -> Iterator[bytes]:
    """What ``run`` is when taken as hex or base64."""
    if len(run) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", run):
        yield binascii.unhexlify(run)
    plain = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 != 1:
        try:
            yield base64.b64decode(plain + "=" * (-len(plain) % 4))
        except binascii.Error:
            pass


def unescape(run: str) -> tuple[str, list[int]]:
    """``run`` with one layer of percent, backslash and character-reference escapes decoded, and where each character of it begins in ``run``.

    Escapes below 256 are bytes: as characters of that number, as what is looked for is ASCII.
    """
    out, at, last = [], [], 0
    for m in _ESCAPED.finditer(run):
        out.append(run[last : m.start()])
        at += range(last, m.start())
        digits = next(g for g in m.groups() if g)
        n = int(digits, 8 if digits == m["o"] else 10 if digits == m["d"] else 16)
        out.append(chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else "\ufffd")
        at.append(m.start())
        last = m.end()
    out.append(run[last:])
    at += range(last, len(run) + 1)
    return "".join(out), at


def _encoded(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and plain form of what may be base64 or hex within ``text``."""
    for m in _WRAPPED.finditer(text):
        yield m.start(), m.end(), re.sub(r"\\[nr]|[^A-Za-z0-9+/_=-]", "", re.sub(r"[\"'`][ \t]*\\?\+?\s*[bBrR]?[\"'`]", "", m[0]))
    for m in _RUN.finditer(text):
        yield m.start(), m.end(), m[0]
        # A slash or dash may belong to a path around the run and shift it.
        if "/" in m[0] or "-" in m[0]:
            for part in re.finditer(r"[A-Za-z0-9+_]{24,}(?:/[A-Za-z0-9+_]+)*={0,2}", m[0]):
                if part[0] != m[0]:
                    yield m.start() + part.start(), m.start() + part.end(), part[0]


def _readable(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and all(c.isprintable() or c in "\t\r\n" for c in text) else None


def _pieces(literal: str) -> str:
    return "".join(a or b or c for a, b, c in _PIECE.findall(literal))


def _secret_value(value: str) -> bool:
    """:func:`usable`, seen through encoded layers that hold readable text."""
    for _ in range(MAX_LAYERS):
        inner = None
        if re.fullmatch(r"[A-Za-z0-9+/_-]{8,}={0,2}", value) or _ESCAPED.search(value):
            if not re.fullmatch(r"[A-Za-z0-9+/_-]+", value) or len(value) % 4 == 0:
                found = [unescape(value)[0].encode("latin-1", "replace")] if _ESCAPED.search(value) else _layers(value)
                inner = next((t for d in found if (t := _readable(d)) and len(t) >= 4), None)
        if inner is None or inner == value:
            return usable(value)
        value = inner
    return usable(value)


def scan(text: str, source: bool = True, depth: int = 0) -> list[Hit]:
    """Spans of the secrets in ``text``, in order, none inside another.

    ``source`` says that only quoted values are constants. Texts inside base64, hex, percent
    or backslash escapes are decoded and scanned in turn, up to ``MAX_LAYERS`` deep; a secret
    found there gives the enclosing encoded run. Key blocks are PEM, or binary containers
    known by their grammar.
    """
    hits: list[Hit] = []
    for m in _PEM.finditer(text):
        stop = _PEM_END.search(text, m.end())
        end = stop.end() if stop else len(text)
        again = text.find("-----BEGIN", m.end())
        if -1 < again < end:
            end = again
        body = re.sub(r"(?m)^[A-Za-z-]+:.*$|\\[nr]|-----END.*|[^A-Za-z0-9+/=]", "", text[m.end() : end])
        kind = None
        if len(body) >= 40:
            try:
                raw = base64.b64decode(body.rstrip("=") + "=" * (-len(body.rstrip("=")) % 4))
                kind = der_kind(raw)
            except binascii.Error:
                pass
            if kind == "private" or (m[2] == "PRIVATE KEY" and kind != "public"):
                hits.append(Hit(m.start(), end, "private_key"))
    for p in _PREFIX.finditer(text):
        m = FORMATS.match(text, p.start())
        if m and not re.search(r"EXAMPLE(?:KEY)?$", m[0]):
            hits.append(Hit(m.start(), m.end(), "token"))
    hits += (Hit(*m.span(1), "url_password") for m in _URL.finditer(text) if _secret_value(m[1]))
    if "curl" in text:
        hits += (Hit(*m.span(1), "user_password") for m in _CURL.finditer(text) if _secret_value(m[1]))
    for m in _HEADER.finditer(text):
        value = m[2]
        if m[1].lower() == "basic":
            try:
                value = base64.b64decode(value).decode().partition(":")[2]
            except ValueError:
                continue
        if usable(value):
            hits.append(Hit(*m.span(2), "authorization"))
    hits += (Hit(*m.span(1), "user_password") for m in _PLACED.finditer(text) if _secret_value(m[1]))
    hits += (Hit(*m.span(1), "user_password") for m in _LOGIN.finditer(text) if _secret_value(m[1]))
    hits += (Hit(*m.span(1), "prose") for m in _PROSE.finditer(text) if re.search(r"\d", m[1]) and _secret_value(m[1]))
    lower = text.lower() if text.isascii() else text.translate(_ASCII_LOWER)
    for m in _NAMED.finditer(lower):
        line = text[max(0, text.rfind("\n", 0, m.start()) + 1, m.start() - 120) : m.start()]
        before = _NAME_START.search(line)[0]
        name = before.lstrip("\"'`") + text[m.start() : m.start(1)]
        if not secret_name(name):
            continue
        v = _VALUE.match(text, m.end())
        quoted = v and re.match(_LITERAL, v[0])
        header = m[2] == ":" and "-" in name and not quoted
        if not v or (source and not quoted and not header) or (m[2] == "," and not (m[1] and quoted)):
            continue
        at, end = v.span()
        if quoted:
            value = _pieces(v[0])
            at, end = at + re.match(r"[bBrRuU]{0,2}", v[0]).end() + 1, end - 1
        else:
            value = re.split(r"[\s\"'`]", v[0], maxsplit=1)[0].rstrip(",;")
            end = at + len(value)
        if "-----BEGIN" not in value and _secret_value(value):
            hits.append(Hit(at, end, "assignment"))
    if not source:
        hits += (Hit(*m.span(2), "assignment") for m in _ENV_OLD.finditer(text) if secret_name(m[1]) and _secret_value(m[2]))
    if _PLUS.search(text):
        hits += (Hit(m.start() + 1, m.end() - 1, "token") for m in _CONCAT.finditer(text) if FORMATS.search(_pieces(m[0])))
    if depth < MAX_LAYERS:
        for at, end, run in _encoded(text):
            for data in _layers(run):
                if der_kind(data) == "private" or ((t := _readable(data)) and t != run and scan(t, False, depth + 1)):
                    hits.append(Hit(at, end, "encoded"))
                    break
        if _ESCAPED.search(text):
            for m in _FIELD.finditer(text):
                if len(m[0]) < 8 or not ("\\" in m[0] or "%" in m[0] or "&#" in m[0]):
                    continue
                plain, where = unescape(m[0])
                if len(plain) == len(m[0]):
                    continue
                if der_kind(plain.encode("latin-1", "replace")) == "private":
                    hits.append(Hit(m.start(), m.end(), "encoded"))
                # A value in a text with some escapes is blanked alone; where all is escaped, the run it lies in is.
                runs = [r.span() for r in _ALL_ESCAPED.finditer(m[0])]
                for h in scan(plain, False, depth + 1):
                    a, z = where[h.start], where[h.end]
                    around = [r for r in runs if r[0] < z and a < r[1]]
                    hits.append(Hit(m.start() + min([a, *(r[0] for r in around)]), m.start() + max([z, *(r[1] for r in around)]), "encoded"))
    kept: list[Hit] = []
    for h in sorted(hits, key=lambda h: (h.start, -h.end)):
        if kept and h.start < kept[-1].end:
            if h.end > kept[-1].end:
                kept[-1] = kept[-1]._replace(end=h.end)
        else:
            kept.append(h)
    return kept


def redact(text: str, hits: list[Hit]) -> str:
    """``text`` with every hit blanked character by character; quotes and ``+`` between literals, line ends, written or escaped, and all else stay."""
    out, at = [], 0
    for h in hits:
        inner = text[h.start : h.end]
        glue = re.compile(r"([\"'`]\s*\+\s*[bBrR]?[\"'`]|-----(?:BEGIN|END)[A-Z0-9 ]+-----|\\[nr]|\s)")
        blank = "".join(p if i % 2 else "*" * len(p) for i, p in enumerate(glue.split(inner)))
        out += (text[at : h.start], blank)
        at = h.end
    return "".join((*out, text[at:]))


def _scan_rows(redacted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lines, kinds, texts = [], [], [], []
            for i, path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not text:
                    continue
                hits = scan(text, bool(_SOURCE.search(path or "")))
                if not hits:
                    continue
                if redacted:
                    ids.append(i)
                    texts.append(redact(text, hits))
                    continue
                ends = [m.start() for m in re.finditer("\n", text)]
                for h in hits:
                    ids.append(i)
                    lines.append(bisect_right(ends, h.start - 1) + 1)
                    kinds.append(h.kind)
            if redacted:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["file_id", "redacted"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(lines, pa.int32()), pa.array(kinds, pa.string())],
                    names=["file_id", "line", "kind"],
                )

    return run


def find_secrets(files: DataFrame) -> DataFrame:
    """``(file_id, line, kind)`` of each secret in ``files(file_id, path, text)``.

    One pass without a shuffle of texts; only the findings are deduplicated. Null or empty
    texts, and null ids, have none; a null path counts as configuration.
    """
    rows = files.where("file_id is not null and text is not null").select("file_id", "path", "text")
    return rows.mapInArrow(_scan_rows(False), "file_id long, line int, kind string").distinct()


def redact_files(files: DataFrame) -> DataFrame:
    """``(file_id, redacted)``: the blanked text of every file that holds a secret, one row per file and text."""
    rows = files.where("file_id is not null and text is not null").select("file_id", "path", "text")
    return rows.mapInArrow(_scan_rows(True), "file_id long, redacted string").distinct()
