"""Scalar expressions shared by the operators; each has one definition here."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The characters with the property White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def lines(text: Column) -> Column:
    """The lines of a text: split at line feeds, a carriage return before one dropped, no empty last line."""
    plain = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(plain, "\n", -1))


def trim(text: Column) -> Column:
    """Without white space at the ends, of any kind that Unicode knows."""
    return F.btrim(text, F.lit(SPACES))


def extension(path: Column) -> Column:
    """The lower-cased text after the last dot of the file name; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def percent(part: Column, whole: Column) -> Column:
    """Percent of a whole, 0 for none."""
    return F.when(whole > 0, part * F.lit(100.0) / whole).otherwise(F.lit(0.0))


def normalize_path(path: Column, root: str = "") -> Column:
    """Forward slashes, and without the root it lies under (in any case of letters)."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.regexp_replace(plain, f"(?i)^{re.escape(root.rstrip('/'))}/", "") if root else plain


def java_hash(text: Column) -> Column:
    """The wrapping 32-bit hash ``31 * h + c``, folded with a modulus since plain arithmetic would overflow."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    unsigned = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + c, F.lit(1 << 32)))
    return F.when(unsigned >= 1 << 31, unsigned - (1 << 32)).otherwise(unsigned)


def cvss_severity(score: Column) -> Column:
    """The severity of a score: 9, 7, 4 and above 0; nulls and NaN are ``info``."""
    known = F.when(F.isnan(score), None).otherwise(score)
    return (
        F.when(known >= 9, "blocker").when(known >= 7, "critical").when(known >= 4, "major").when(known > 0, "minor").otherwise("info")
    )


def severity_rank(severity: Column) -> Column:
    """0 for ``blocker`` to 4 for ``info``."""
    ranks = F.create_map(*[x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i))])
    return ranks[severity]


SEVERITIES = ("blocker", "critical", "major", "minor", "info")


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ``**`` crosses folders, ``*`` and ``?`` do not; a bare name matches anywhere in the path."""
    if not re.search(r"[*?\[]", pattern):
        return f"(?:^|.*/){re.escape(pattern)}.*"
    out, i = ["^"], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            out.append("[" + pattern[i + 1 : end].replace("!", "^", 1) + "]")
            i = end + 1
        elif c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out.append("(?:" + "|".join(re.escape(x) for x in pattern[i + 1 : end].split(",")) + ")")
            i = end + 1
        else:
            out.append(re.escape(c))
            i += 1
    return "".join(out) + "$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of the globs; no patterns match nothing."""
    return path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def loose_glob_regex(pattern: str) -> str:
    """A glob for significant code: a star stands for anything, folders too, and all else for itself."""
    return "^" + ".*".join(re.escape(x) for x in re.split(r"\*\*/|\*", pattern.replace("\\", "/"))) + "$"


def significant(path: Column, patterns: tuple[str, ...] = (), tests: tuple[str, ...] = (), generated: tuple[str, ...] = ()) -> Column:
    """Whether a path is no test, is not generated, and matches a pattern if there are any."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    some = lambda globs: plain.rlike("|".join(f"(?:{loose_glob_regex(g)})" for g in globs)) if globs else F.lit(False)
    return ~some((*tests, *generated)) & (some(patterns) if patterns else F.lit(True))


def is_identifier(text: Column) -> Column:
    return text.rlike("^[A-Za-z_][A-Za-z0-9_]*$")


def first_code_block(text: Column) -> Column:
    """The inside of the first fenced block of a markdown text, null without one."""
    found = F.regexp_extract(text, r"(?s)```[^\n]*\n(.*?)```", 1)
    return F.when(text.contains("```") & text.rlike(r"(?s)```[^\n]*\n.*?```"), found)


def file_sections(text: Column) -> Column:
    """``array<struct<path, text>>`` of a text cut by lines ``=== FILE: path ===``."""
    parts = F.slice(F.split(text, r"(?m)^=== FILE:[ \t]*"), 2, 1 << 30)
    return F.transform(parts, lambda p: F.struct(trim(F.regexp_extract(p, r"^([^\n=]*)", 1)).alias("path"), F.regexp_replace(p, r"^[^\n]*\n?", "").alias("text")))


def humanize_ms(ms: Column) -> Column:
    """A duration: ``42ms``, ``1.5s`` or ``2m 3s``."""
    seconds = F.floor(ms / 1000)
    return (
        F.when(ms < 1000, F.format_string("%dms", ms.cast("long")))
        .when(ms < 60000, F.format_string("%.1fs", ms / 1000.0))
        .otherwise(F.format_string("%dm %ds", F.floor(seconds / 60).cast("long"), F.pmod(seconds, F.lit(60)).cast("long")))
    )
