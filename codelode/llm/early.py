"""Errors that grammars leave to rules beside them: what may be assigned to, the order of arguments, where words may stand, names declared twice.

Each check is one pass over the tokens the parser has read. Where a brace or a name may be something else, nothing is reported.
"""

from __future__ import annotations

import re

_CONTROL = frozenset(("if", "for", "while", "switch", "catch", "with", "await"))
_BLOCK_AFTER = frozenset((";", "{", "}", "else", "do", "try", "finally", ""))
_WORD = re.compile(r"[^\W\d]|\$")
_PY_HEADS = frozenset("if elif else while for try except finally with def class match case async".split())
_PY_OPEN, _PY_CLOSE = frozenset("([{"), frozenset(")]}")
_PY_BINARY = frozenset("+ - * / // % @ ** << >> & | ^ ~ < > <= >= == != and or not in is if else lambda await".split())
_PY_AUG = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_ZEROS = re.compile(r"0[\d_]*[1-9][\d_]*$")


def javascript(tokens: list[str]) -> int:
    """The number of the first line end token before an error, plus 1; 0 for none."""
    line, before, typed = 1, "", None
    braces: list[str] = []  # b: a block or control statement, f: a function's, ?: anything else
    names: list[set[str]] = [set()]
    parens: list[str] = []
    head, waits, fresh = "", "", False
    sure = 0  # how many of the innermost braces are certainly blocks, if all of them are
    for t in tokens:
        c = t[0]
        if c == "\n":
            line += 1
            fresh = True
            continue
        if c == "/" and t[:2] in ("//", "/*"):
            line += t.count("\n")
            continue
        if waits:
            # waits: the word let or const; its name comes now, or what follows the name.
            if waits in ("let", "const"):
                if _WORD.match(t) and t not in ("in", "of", "enum", "let", "instanceof"):
                    if t in names[-1] and not parens_in(parens, braces):
                        return line
                    if not parens_in(parens, braces):
                        names[-1].add(t)
                    waits = "name" if waits == "const" else ""
                else:
                    waits = ""
            else:
                if t in (";", ",") and not parens_in(parens, braces):
                    if typed is None:
                        typed = "declare" in tokens
                    if not typed:
                        return line
                waits = ""
        if t == "(":
            parens.append(before if not (before == "await" and head == "for") else "for")
        elif t == ")":
            head = parens.pop() if parens and parens[-1] != "{" else ""
        elif t == "{":
            if before == ")":
                kind = "b" if head in _CONTROL else "f"
            elif before in _BLOCK_AFTER or fresh and before not in ("=>", "=", ",", "(", "[", ":", "?", "return", "&&", "||") and not _WORD.match(before or "x") and before[:1] not in "'\"`":
                kind = "b"
            else:
                kind = "f" if before == "=>" else "?"
            braces.append(kind)
            parens.append("{")
            names.append(set())
        elif t == "}":
            while parens and parens.pop() != "{":
                pass
            if braces:
                braces.pop()
                names.pop()
        elif t == "return":
            if before not in (".", "?.") and all(b == "b" for b in braces) and not parens_in(parens, braces):
                return line
        elif t == "=":
            if before in ("++", "--"):
                return line
        elif t in ("let", "const"):
            if before in (";", "{", "}", "", "export", ")") or fresh and before not in (".", "?.", ",", "="):
                waits = t
        elif t == "for":
            head = "for"
        if c in "`'\"" and "\n" in t:
            line += t.count("\n")
        before, fresh = t, False
    return 0


def parens_in(parens: list[str], braces: list[str]) -> bool:
    """Whether the innermost bracket is a parenthesis."""
    return bool(parens) and parens[-1] != "{"


def python(tokens: list[str]) -> int:
    """As :func:`javascript`."""
    line, start = 1, 1
    depth = 0
    logical: list[str] = []
    white = ""
    blocks: list[tuple[int, str]] = []  # width, and def, class or loop
    widths: list[tuple[int, int]] = [(0, 0)]
    for t in [*tokens, "\n"]:
        c = t[0]
        if c == "\n":
            if depth <= 0 and logical:
                if bad := _python_line(logical, white, blocks, widths):
                    return start
                logical = []
            line += 1
            if depth <= 0:
                white, start = t[1:], line
                depth = 0
            continue
        if c == "#":
            continue
        if c == "\\":
            line += t.count("\n")
            continue
        if not logical:
            start = line
        logical.append(t)
        if t in _PY_OPEN:
            depth += 1
        elif t in _PY_CLOSE:
            depth -= 1
        elif c in "'\"rRbBuUfF" and "\n" in t:
            line += t.count("\n")
    return 0


def _python_line(x: list[str], white: str, blocks: list[tuple[int, str]], widths: list[tuple[int, int]]) -> bool:
    # Indents must compare alike whatever a tab is worth.
    wide, narrow = len(white.expandtabs(8)), len(white.expandtabs(1))
    while len(widths) > 1 and widths[-1][0] > wide:
        widths.pop()
    if (wide > widths[-1][0]) != (narrow > widths[-1][1]) or (wide == widths[-1][0]) != (narrow == widths[-1][1]):
        return True
    if wide > widths[-1][0]:
        widths.append((wide, narrow))
    while blocks and blocks[-1][0] >= wide:
        blocks.pop()
    first = x[1] if x[0] == "async" and len(x) > 1 else x[0]
    body = x
    if first in _PY_HEADS and not (first in ("match", "case") and ":" not in x):
        end = _colon(x)
        if first in ("def", "class"):
            blocks.append((wide, first))
        elif first in ("for", "while"):
            blocks.append((wide, "loop"))
        if first == "def" and _bad_parameters(x):
            return True
        body = x[end + 1 :] if end >= 0 else []
    if _bad_tokens(x):
        return True
    at = 0
    for i in range(len(body) + 1):
        if i == len(body) or body[i] == ";":
            if i > at and _bad_statement(body[at:i], blocks):
                return True
            at = i + 1
    return False


def _colon(x: list[str]) -> int:
    depth = lambdas = 0
    for i, t in enumerate(x):
        if t in _PY_OPEN:
            depth += 1
        elif t in _PY_CLOSE:
            depth -= 1
        elif t == "lambda" and not depth:
            lambdas += 1
        elif t == ":" and not depth:
            if not lambdas:
                return i
            lambdas -= 1
    return -1


def _bad_tokens(x: list[str]) -> bool:
    """Numbers with leading zeros, and positional arguments after those with names."""
    calls: list[list] = []  # is a call, a name was seen, ** was seen, begin of the argument
    for i, t in enumerate(x):
        if t in _PY_OPEN:
            before = x[i - 1] if i else ""
            call = t == "(" and i > 0 and (before in (")", "]") or bool(_WORD.match(before)) and before[-1] not in "'\"" and before not in _KEYWORDS) and not (i > 1 and x[i - 2] in ("def", "class"))
            calls.append([call, False, False, i + 1])
        elif t in _PY_CLOSE or t == "," and calls:
            top = calls[-1] if calls else [False, False, False, 0]
            a = top[3]
            if top[0] and i > a:
                if x[a] == "**":
                    top[2] = True
                elif x[a] == "*":
                    if top[2]:
                        return True
                elif i > a + 1 and x[a + 1] == "=":
                    top[1] = True
                elif top[1] or top[2]:
                    return True
            top[3] = i + 1
            if t in _PY_CLOSE and calls:
                calls.pop()
        elif t[0] == "0" and _ZEROS.match(t):
            return True
    return False


_KEYWORDS = frozenset("and or not in is if else elif return yield lambda print_ del assert raise from import for while with as await except case match async global nonlocal pass break continue".split())


def _bad_parameters(x: list[str]) -> bool:
    """A parameter without a default after one with it, before any star."""
    i = x.index("(") if "(" in x else len(x)
    depth, start, seen = 0, i + 1, False
    for j in range(i, len(x)):
        t = x[j]
        if t in _PY_OPEN:
            depth += 1
        elif t in _PY_CLOSE:
            depth -= 1
        if depth == 1 and t == "," or depth == 0:
            part = x[start:j]
            if part:
                if part[0] in ("*", "**"):
                    return False
                if part[0] != "/":
                    level = 0
                    default = False
                    for w in part:
                        level += (w in _PY_OPEN) - (w in _PY_CLOSE)
                        default = default or w == "=" and not level
                    if seen and not default:
                        return True
                    seen = seen or default
            start = j + 1
            if depth == 0:
                return False
    return False


def _bad_statement(x: list[str], blocks: list[tuple[int, str]]) -> bool:
    kinds = [k for _, k in blocks]
    if x[0] == "return" and ("def" not in kinds or kinds[::-1].index("def") > (kinds[::-1].index("class") if "class" in kinds else len(kinds))):
        return True
    if x[0] in ("break", "continue") and len(x) == 1:
        inner = next((k for k in reversed(kinds)), "")
        if inner != "loop":
            return True
    depth, at = 0, 0
    for i, t in enumerate(x):
        if t in _PY_OPEN:
            depth += 1
        elif t in _PY_CLOSE:
            depth -= 1
        elif not depth and t == "lambda":
            return False
        elif not depth and (t == "=" or t in _PY_AUG):
            if not _assignable(x[at:i], t != "="):
                return True
            at = i + 1
    return False


def _assignable(x: list[str], alone: bool) -> bool:
    depth = 0
    for t in x:
        if t in _PY_OPEN:
            depth += 1
        elif t in _PY_CLOSE:
            depth -= 1
        elif not depth and t == ":":
            return True  # an annotation
        elif not depth and t in _PY_BINARY and not (t == "*" and not alone):
            return False
    if not x or x[0] in ("yield", "return", "type", "case", "print"):
        return True
    last = x[-1]
    if last in ("None", "True", "False", "...") or last[0].isdigit() or last[-1] in "'\"":
        return len(x) > 1 and last[-1] not in "'\"" and not last[0].isdigit()
    if last == ")":
        depth = 0
        for i in range(len(x) - 1, -1, -1):
            depth += (x[i] in _PY_CLOSE) - (x[i] in _PY_OPEN)
            if not depth:
                before = x[i - 1] if i else ","
                return before in (",", "*") and not alone
    return True
