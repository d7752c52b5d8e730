"""Tokens of source texts: one regular expression a language, comments and the contents of literals left out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

_BLOCK = r"/\*(?:[^*]|\*(?!/))*(?:\*/)?"
_DQ, _SQ = r"\"(?:[^\"\\]|\\(?s:.))*\"?", r"'(?:[^'\\]|\\(?s:.))*'?"
_TEMPLATE = r"`(?:[^`\\]|\\(?s:.))*`?"
_TRIPLE = r"\"\"\"(?:[^\\]|\\(?s:.))*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\(?s:.))*?(?:'''|\Z)"
_NESTED = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*(?:\*/)?"
_NAME, _NUMBER = r"[A-Za-z_$][A-Za-z0-9_$]*", r"[0-9][A-Za-z0-9.]*"
# Operators of two and three characters. Shifts, path separators and floor division are single characters, as in the stored streams.
_OPERATORS = r"===|!==|<<=|\*\*=|>>=|\.\.\.|==|!=|<=|>=|&&|\|\||\?\?|=>|\*\*|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^="
#: What is skipped, by language; everything else is generic.
SKIPPED = {
    "python": rf"\#[^\n]*|[rRbBuUfF]{{0,2}}(?:{_TRIPLE})|[rRbBuUfF]{{0,2}}(?:{_DQ}|{_SQ})",
    "go": rf"//[^\n]*|{_BLOCK}|`[^`]*`?|{_DQ}|'(?:[^'\\\n]|\\[^\n])*'",
    "rust": rf"//[^\n]*|{_NESTED}|b?r\#+\"(?:[^\"]|\"(?!\#))*\"\#+|b?r?{_DQ}|b?'(?:\\[^\n']+|[^\\'\n])'",
    "dart": rf"//[^\n]*|{_NESTED}|r?(?:{_TRIPLE})|r?(?:{_DQ}|{_SQ})",
    "generic": rf"//[^\n]*|{_BLOCK}|{_DQ}|{_SQ}|{_TEMPLATE}",
}


@lru_cache(maxsize=None)
def pattern(language: str) -> re.Pattern:
    skipped = SKIPPED.get(language, SKIPPED["generic"])
    extra = {"go": r":=|<-|&\^=|&\^|", "rust": r"->|\.\.=|\.\.|'[A-Za-z_]\w*|", "dart": r"\?\.|\.\.|~/=|~/|\?\?=|", "python": r"->|"}.get(language, "")
    return re.compile(rf"(?P<s>{skipped})|(?P<t>{_NAME}|{_NUMBER}|{extra}{_OPERATORS}|\S)|\n")


def tokens_of(text: str, language: str) -> list[tuple[int, str]]:
    """``(line, token)`` in order."""
    out, line = [], 1
    for m in pattern(language).finditer(text):
        token = m["t"]
        if token is not None:
            out.append((line, token))
        else:
            line += m[0].count("\n")
    return out


def tokenize(files: DataFrame) -> DataFrame:
    """``(file_id, unit, line, text)`` of ``files(file_id, language, text)``; a null text has no tokens, an unknown language is read as generic."""
    return files.where("file_id is not null and text is not null").select("file_id", "language", "text").mapInArrow(
        _rows, "file_id long, unit int, line int, text string"
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, units, lines, texts = [], [], [], []
        for i, language, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found = tokens_of(text, language or "generic")
            ids += [i] * len(found)
            units += range(len(found))
            lines += [x for x, _ in found]
            texts += [x for _, x in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(units, pa.int32()), pa.array(lines, pa.int32()), pa.array(texts, pa.string())],
            names=["file_id", "unit", "line", "text"],
        )
