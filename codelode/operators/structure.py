"""Structure of source texts from their tokens: brackets, the roles of braces, functions, declarations and statements.

One pass over Arrow batches gives what line patterns cannot: rules about blocks and names, structural
counts, parameters, cyclomatic and cognitive complexity. Python texts are read with the interpreter's own parser. A text is one
row however long it is; nothing is shuffled.
"""

from __future__ import annotations

import ast
import re
from functools import lru_cache
from typing import NamedTuple

_BLOCK = r"/\*(?:[^*]|\*(?!/))*(?:\*/)?"
_DQ, _SQ = r"\"(?:[^\"\\\n]|\\(?s:.))*\"", r"'(?:[^'\\\n]|\\(?s:.))*'"
_TRIPLE = r"\"\"\"(?:[^\\]|\\(?s:.))*?\"\"\"|'''(?:[^\\]|\\(?s:.))*?'''"
_BEFORE = r"(?:(?<=[=(,:;!&|?{}\[\n+*%<>~^-])|(?<=[=(,:;!&|?{}\[\n+*%<>~^-] )|(?<=return )|(?<=typeof )|(?<=case ))"
_REGEX = rf"{_BEFORE}/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*"
# Operators of three characters and two, longest first.
_OPERATORS = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|->|::|:=|<-|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\*\*|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\.\."
_SPECIAL = {
    "dart": rf"(?P<s>r?(?:{_TRIPLE})|r?{_DQ}|r?{_SQ})|(?P<t>\b\B)|(?P<r>\b\B)", "go": rf"(?P<s>`[^`]*`|{_DQ}|'(?:[^'\\\n]|\\[^\n])*')|(?P<t>\b\B)|(?P<r>\b\B)",
    "rust": rf"(?P<s>b?r\#+\"(?:[^\"]|\"(?!\#))*\"\#+|b?r?\"(?:[^\"\\]|\\(?s:.))*\"|b?'(?:\\[^\n']+|[^\\'\n])')|(?P<t>\b\B)|(?P<r>\b\B)",
    "web": rf"(?P<t>`(?:[^`\\]|\\(?s:.))*`)|(?P<s>{_DQ}|{_SQ})|(?P<r>{_REGEX})",
}

WEB = ("typescript", "tsx", "javascript", "jsx")


@lru_cache(maxsize=None)
def pattern(language: str) -> re.Pattern:
    kind = "web" if language in WEB else language
    return re.compile(
        rf"(?P<c>//[^\n]*|{_BLOCK})|{_SPECIAL[kind]}|(?P<i>[#@]?[^\W\d]\w*(?:\$\w*)*|\$[\w$]*)|(?P<n>\.?\d[\w.]*)|(?P<p>{_OPERATORS}|[^\s\w])|\n"
    )


_OPENS, _CLOSES = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")
_CONTROL = frozenset(("if", "for", "while", "switch", "catch", "with", "do", "try", "else", "finally"))
_LOOPS = frozenset(("for", "while", "do"))
_LEAVES = frozenset(("return", "throw", "break", "continue"))
_OBJECT_AFTER = frozenset("= ( , [ : ? return && || ?? ... throw new typeof in of default yield await + - * / % ! => == != === !== < >".split())
#: A line does not end a statement after one of these, nor before one of those.
_OPEN_END = frozenset("= + - * / % & | ^ ! ~ ? : , . && || ?? ?. => ( [ { < > <= >= == != === !== += -= *= /= else do try in of instanceof new typeof await extends implements ...".split())
_GOES_ON = frozenset(". ?. ) ] , ; = + - * / % & | ^ ? : && || ?? => < > <= >= == != === !== instanceof in of else catch finally ( [ += -= *= /=".split())


class Function(NamedTuple):
    name: str
    start: int
    parameters: list[tuple[str, int, bool]]
    count: int
    body: tuple[int, int]
    whole: bool
    is_async: bool
    kind: str


class Code:
    """Tokens of one text (kind, text, line), with the bracket each stands in and the partner of each bracket."""

    def __init__(self, text: str, language: str) -> None:
        self.language = language
        kinds, words, lines, comments, line = [], [], [], [], 1
        for m in pattern(language).finditer(text):
            kind = m.lastgroup
            if kind is None:
                line += 1
                continue
            if kind == "c":
                comments.append((line, m[0]))
            else:
                kinds.append(kind)
                words.append(m[0])
                lines.append(line)
            if kind in "cts" and "\n" in m[0]:
                line += m[0].count("\n")
        self.k, self.x, self.l, self.comments, self.n = kinds, words, lines, comments, len(words)
        self.mate, self.up = [-1] * self.n, [-1] * self.n
        stack: list[int] = []
        for i in range(self.n):
            w = words[i] if kinds[i] == "p" else ""
            if w in _CLOSES:
                while stack and _OPENS[words[stack[-1]]] != w and w == "}" and words[stack[-1]] != "{":
                    stack.pop()
                if stack and _OPENS[words[stack[-1]]] == w:
                    j = stack.pop()
                    self.mate[i], self.mate[j] = j, i
            self.up[i] = stack[-1] if stack else -1
            if w in _OPENS:
                stack.append(i)
        self.role: dict[int, str] = {}
        self.head: dict[int, str] = {}
        self.functions: list[Function] = []
        if language in WEB or language == "dart":
            self._roles()
        elif language in ("go", "rust"):
            self._keyword_functions()

    def is_(self, i: int, *words: str) -> bool:
        return 0 <= i < self.n and self.k[i] in "ip" and self.x[i] in words

    def first(self, i: int) -> bool:
        return i == 0 or self.l[i] > self.l[i - 1]

    def skip(self, i: int) -> int:
        """The place after token ``i``, or after its partner if it opens a bracket."""
        return self.mate[i] + 1 if self.k[i] == "p" and self.x[i] in _OPENS and self.mate[i] > i else i + 1

    def expression_end(self, i: int) -> int:
        """Where an expression that begins at ``i`` ends: at a comma, a semicolon, a closing bracket or a line that ends it."""
        j = i
        while j < self.n:
            w = self.x[j] if self.k[j] == "p" else ""
            if w in (",", ";") or w in _CLOSES:
                return j
            if j > i and self.first(j) and self.ends_line(j):
                return j
            j = self.skip(j)
        return self.n

    def ends_line(self, j: int) -> bool:
        """Whether a statement may end before token ``j``, the first of its line."""
        a, b = j - 1, j
        if self.k[a] in "ip" and self.x[a] in _OPEN_END or self.k[b] in "ip" and self.x[b] in _GOES_ON:
            return False
        return not (self.is_(a, ")") and self.mate[a] >= 0 and self.is_(self.mate[a] - 1, "if", "for", "while", "with", "await"))

    def parameters(self, opening: int) -> tuple[list[tuple[str, int, bool]], int]:
        """Plain names in a parameter list with their place and whether they have a type, and how many parameters there are (``this`` is none)."""
        out, count, i, end = [], 0, opening + 1, self.mate[opening]
        if end < 0:
            return [], 0
        while i < end:
            while self.k[i] == "i" and self.x[i] in ("public", "private", "protected", "readonly", "override", "final", "required", "covariant", "const") and i + 1 < end and self.k[i + 1] == "i":
                i += 1
            j, typed, names = i, False, []
            while j < end and not self.is_(j, ","):
                if self.is_(j, ":") and not self.is_(j - 1, "?") or self.is_(j, "?") and self.is_(j + 1, ":"):
                    typed = True
                if self.is_(j, "="):
                    j = self.expression_end(j + 1)
                    break
                if self.is_(j, "<"):
                    j = self._after_angle(j, end)
                    continue
                if self.k[j] == "i" and not typed:
                    names.append(j)
                j = self.skip(j)
            if self.language == "dart" and self.x[i] in ("{", "[") and self.mate[i] > i:
                inner, more = self.parameters(i)
                out, count = out + inner, count + more
            elif j > i and not self.is_(i, "this") or self.is_(i + 1, "."):
                count += 1
                name = names[-1] if self.language == "dart" else names[0] if names and names[0] in (i, i + 1) and not self.is_(i, "{", "[") else None
                if names and name is not None:
                    out.append((self.x[name], name, typed))
            i = max(j, i) + 1
        return out, count

    def _after_angle(self, i: int, end: int) -> int:
        depth = 0
        while i < end:
            w = self.x[i] if self.k[i] == "p" else ""
            depth += (w == "<") - (w == ">") - 2 * (w == ">>")
            i = i + 1 if w in "<>" or w == ">>" else self.skip(i)
            if depth <= 0:
                return i
        return end

    def _before_type(self, i: int) -> int:
        """If a return type ends at ``i``, the place of the ``)`` before it, else -1."""
        j, steps = i, 0
        while j > 0 and steps < 60:
            w = self.x[j]
            if self.k[j] == "p" and w in _CLOSES and self.mate[j] >= 0 and w != ")":
                j = self.mate[j]
            elif w == ":" and self.k[j] == "p":
                return j - 1 if self.is_(j - 1, ")") else -1
            elif not (self.k[j] in "is" or w in ("<", ">", ".", "|", "&", "?", ",", ">>", "=>")) or w in _CONTROL or w in ("return", "case", "default"):
                return -1
            j -= 1
            steps += 1
        return -1

    def _roles(self) -> None:
        pending: dict[int, str] = {}
        bodies: dict[int, tuple[int, int, str, bool, str]] = {}
        dart = self.language == "dart"
        for i in range(self.n):
            w, kind, up = self.x[i], self.k[i], self.up[i]
            if kind == "i":
                member = self.is_(i - 1, ".", "?.")
                if w in ("class", "interface", "enum", "namespace", "module", "mixin", "extension") and not member and i + 1 < self.n and (self.k[i + 1] == "i" or w == "class" and self.is_(i + 1, "{", "extends")):
                    pending[up] = "class" if w in ("mixin", "extension") else w
                elif w in ("import", "export") and not member:
                    pending[up] = "import" if self.is_(i + 1, "{", "type") or w == "import" else pending.get(up, "")
                elif w == "function" and not member and not dart:
                    j = i + 1 + self.is_(i + 1, "*")
                    name = self.x[j] if j < self.n and self.k[j] == "i" else ""
                    j += bool(name)
                    if self.is_(j, "<"):
                        j = self._after_angle(j, self.n)
                    if self.is_(j, "(") and self.mate[j] > j:
                        b = self._body_after(self.mate[j] + 1)
                        if b >= 0:
                            bodies[b] = (i, j, name or self._given_name(i - self.is_(i - 1, "async")), self.is_(i - 1, "async"), "declaration" if name and self._begins(i) else "function")
                continue
            if kind != "p":
                continue
            if w == ";":
                pending.pop(up, None)
            elif w == "=>":
                self._arrow(i, bodies)
            elif w == "{":
                self.role[i] = self._role_of(i, pending, bodies)
                if i in bodies:
                    start, opening, name, is_async, how = bodies[i]
                    params, count = self.parameters(opening) if opening >= 0 else ([], 0)
                    self.functions.append(Function(name, start, params, count, (i, self.mate[i] if self.mate[i] >= 0 else self.n - 1), True, is_async, how))

    def _begins(self, i: int) -> bool:
        return i == 0 or self.is_(i - 1, ";", "{", "}", "export", "default", "async", "declare") or self.first(i)

    def _body_after(self, j: int) -> int:
        """The brace that opens a body after a parameter list's end, over a return type; -1 for none."""
        if self.is_(j, "{"):
            return j
        if self.is_(j, ":"):
            j += 1
            if self.is_(j, "{"):
                j = self.mate[j] + 1 if self.mate[j] > 0 else self.n
            while j < self.n and not self.is_(j, "{", ";", "=", ",", ")"):
                j = self._after_angle(j, self.n) if self.is_(j, "<") else self.skip(j)
            return j if self.is_(j, "{") else -1
        return -1

    def _given_name(self, i: int) -> str:
        """The name of the variable, property or parameter that what begins at ``i`` is assigned to."""
        if self.is_(i - 1, "=", ":"):
            j = i - 2
            while j > 0 and self.k[j] != "i":
                j -= 1
            return self.x[j] if j >= 0 and self.k[j] == "i" and i - j < 12 else ""
        return ""

    def _arrow(self, i: int, bodies: dict) -> None:
        opening, start, names = -1, -1, []
        close = i - 1
        if not self.is_(close, ")"):
            back = self._before_type(i - 1) if self.language in WEB else -1
            if back >= 0:
                close = back
        if self.is_(close, ")") and self.mate[close] >= 0:
            opening = start = self.mate[close]
            if self.is_(start - 1, ">"):
                return
        elif self.k[i - 1] == "i":
            start = i - 1
            names = [(self.x[i - 1], i - 1, False)]
        if start < 0 or self.role.get(self.up[i]) in ("interface", "type", "switch"):
            return
        if self.is_(start - 1, ":", "|") and self.role.get(self.up[start]) != "object" and not self._ternary(start - 1):
            return  # a type
        is_async = self.is_(start - 1, "async")
        start -= is_async
        if self.is_(i + 1, "{") and self.language != "dart":
            bodies[i + 1] = (start, opening, self._given_name(start), is_async, "arrow")
            if opening < 0:
                self.functions.append(Function(self._given_name(start), start, names, 1, (i + 1, max(self.mate[i + 1], i + 1)), True, is_async, "arrow"))
                bodies[i + 1] = (start, -1, "", is_async, "known")
            return
        params, count = self.parameters(opening) if opening >= 0 else (names, 1)
        name = self._given_name(start)
        if self.language == "dart" and opening > 0 and self.k[opening - 1] == "i":
            name = self.x[opening - 1]
            is_async = False
        self.functions.append(Function(name, start, params, count, (i, self.expression_end(i + 1)), False, is_async, "arrow"))

    def _ternary(self, i: int) -> bool:
        j = i - 1
        for _ in range(40):
            if j < 0 or self.is_(j, ";", "{", "(", ","):
                return False
            if self.is_(j, "?"):
                return True
            j = self.mate[j] - 1 if self.k[j] == "p" and self.x[j] in _CLOSES and self.mate[j] >= 0 else j - 1
        return False

    def _role_of(self, i: int, pending: dict, bodies: dict) -> str:
        up = self.up[i]
        around = self.role.get(up, "")
        p = self.x[i - 1] if i else ""
        if i in bodies:
            if bodies[i][4] == "known":
                del bodies[i]
            return "function"
        waits = pending.pop(up, "")
        if waits:
            return {"namespace": "block", "module": "block", "": "block"}.get(waits, waits)
        if p in ("else", "do", "try", "finally", "catch") and self.k[i - 1] == "i":
            self.head[i] = p
            return "control"
        if p == ")" and self.mate[i - 1] >= 0:
            o = self.mate[i - 1]
            q = self.x[o - 1] if o else ""
            if q == "await" and self.is_(o - 2, "for"):
                q = "for"
            if q in _CONTROL:
                self.head[i] = q
                return "switch" if q == "switch" else "control"
            return self._method(i, o, bodies, around)
        if self.language == "dart" and p in ("async", "*") and self.is_(i - 1 - (p == "*"), "async", "sync"):
            j = i - 2 - (p == "*")
            if self.is_(j, ")") and self.mate[j] >= 0:
                return self._method(i, self.mate[j], bodies, around, True)
        if self.language in WEB and around in ("class", "object") and (close := self._before_type(i - 1)) >= 0 and self.mate[close] >= 0:
            return self._method(i, self.mate[close], bodies, around)
        if around == "switch" and p == ":":
            return "block"
        if around in ("interface", "type"):
            return "type"
        if p == "=" and self._type_alias(i):
            return "type"
        if self.language in WEB and p == ":" and around not in ("object",) and not self._ternary(i - 1):
            return "type"
        if p in _OBJECT_AFTER:
            return "object"
        return "block"

    def _type_alias(self, i: int) -> bool:
        j = i - 1
        while j > 0 and not self.first(j) and not self.is_(j, ";"):
            j -= 1
        return self.is_(j, "type") or self.is_(j, "export") and self.is_(j + 1, "type")

    def _method(self, i: int, o: int, bodies: dict, around: str, is_async: bool = False) -> str:
        j = o - 1
        if self.is_(j, ">") and self.language in WEB:
            while j > 0 and not self.is_(j, "<"):
                j -= 1
            j -= 1
        if j < 0 or self.k[j] not in "isn" and not self.is_(j, "]"):
            if self.language == "dart":
                bodies[i] = (o, o, "", is_async, "function")
                return "function"
            return "block"
        if around not in ("class", "object") and self.language in WEB:
            return "block"
        start = j
        while start > 0 and self.k[start - 1] == "i" and self.x[start - 1] in ("async", "static", "get", "set", "public", "private", "protected", "override", "readonly", "abstract"):
            start -= 1
        bodies[i] = (start, o, self.x[j], is_async or any(self.x[q] == "async" for q in range(start, j)), "method")
        return "function"

    def _keyword_functions(self) -> None:
        word = "func" if self.language == "go" else "fn"
        for i in range(self.n):
            if self.k[i] == "i" and self.x[i] == word:
                j, name = i + 1, "<anonymous>"
                if word == "func" and self.is_(j, "(") and self.mate[j] > 0 and self.k[min(self.mate[j] + 1, self.n - 1)] == "i" and self.is_(self.mate[j] + 2, "("):
                    j = self.mate[j] + 1  # a receiver
                if j < self.n and self.k[j] == "i":
                    name, j = self.x[j], j + 1
                if self.is_(j, "<", "["):
                    j = self._after_angle(j, self.n) if self.is_(j, "<") else self.skip(j)
                if not self.is_(j, "(") or self.mate[j] < 0:
                    continue
                count, b = self._count(j), self.mate[j] + 1
                while b < self.n and not self.is_(b, "{", ";") and not (word == "func" and self.first(b)):
                    b = b + 1 if self.is_(b, "<", ">") else self.skip(b)
                if self.is_(b, "{") and self.mate[b] > 0:
                    self.role[b] = "function"
                    self.functions.append(Function(name, i, [], count, (b, self.mate[b]), True, False, "declaration"))
            elif word == "fn" and self.k[i] == "p" and self.x[i] in ("|", "||") and self.is_(i - 1, "(", ",", "=", "move", "{", ";", "return"):
                j = i
                if self.x[i] == "|":
                    j = i + 1
                    while j < self.n and not self.is_(j, "|"):
                        j = self.skip(j)
                count = 0 if j == i else self._pieces(i + 1, j)
                end = self.mate[j + 1] if self.is_(j + 1, "{") and self.mate[j + 1] > 0 else self.expression_end(j + 1)
                self.functions.append(Function("<closure>", i, [], count, (j, end), False, False, "closure"))

    def _pieces(self, i: int, end: int) -> int:
        count, some = 0, False
        while i < end:
            if self.is_(i, ","):
                count, some = count + some, False
            else:
                some = True
            i = self._after_angle(i, end) if self.is_(i, "<") else self.skip(i)
        return count + some

    def _count(self, opening: int) -> int:
        """Parameters of a list: in Go names that share a type count each; in Rust ``self`` is none."""
        end = self.mate[opening]
        count = self._pieces(opening + 1, end)
        if self.language == "rust":
            i = opening + 1
            while i < end and (self.is_(i, "&", "mut") or self.x[i].startswith("'")):
                i += 1
            return count - (self.is_(i, "self") and self.is_(i + 1, ",", ")", ":"))
        return count

    def statements(self, a: int, b: int) -> list[tuple[int, int]]:
        """The statements between two places, as (first token, place after the last)."""
        out, i = [], a
        while i < b:
            start, head = i, i
            while head < b and (self.is_(head, "export", "default", "async", "abstract", "declare") or self.x[head].startswith("@")):
                head += 1
            declares = self.is_(head, "function", "class", "interface", "enum", "namespace")
            j = i
            while j < b:
                if self.is_(j, ";"):
                    j += 1
                    if self.is_(j, "else") and j < b:
                        j += 1
                        continue
                    break
                if j > start and self.first(j) and self.ends_line(j) and not (self.is_(j - 1, ")") and self.is_(self.mate[j - 1] - 1, "while") and self.is_(start, "while", "for", "if")):
                    break
                if self.is_(j, "{"):
                    role, done = self.role.get(j, "block"), self.skip(j)
                    at_head = role in ("control", "block", "switch", "interface", "enum") or declares and role in ("function", "class")
                    j = done
                    if at_head and not (j < b and self.is_(j, "else", "catch", "finally")) and not (j < b and self.is_(j, "while") and self.is_(start, "do")):
                        break
                    continue
                j = self.skip(j)
            j = max(min(j, b), i + 1)
            out.append((start, j))
            i = j
        return out

    def declarators(self) -> list[tuple[int, int, int, int]]:
        """For each plain name that ``const``, ``let`` or ``var`` (or Dart's ``final``) declares: keyword, name, and begin and end of its value (-1 without one)."""
        out = []
        words = ("const", "let", "var", "final") if self.language == "dart" else ("const", "let", "var")
        for i in range(self.n):
            if self.k[i] != "i" or self.x[i] not in words or self.is_(i - 1, ".", "?.") or self.is_(i + 1, "enum", ":", ","):
                continue
            j = i + 1
            while j < self.n:
                name = j if self.k[j] == "i" else -1
                if name < 0 and not self.is_(j, "{", "["):
                    break
                j = self.skip(j)
                if self.language == "dart":
                    while j < self.n and (self.k[j] == "i" or self.is_(j, "<", "?")) and not self.first(j) and not self.is_(j, "in"):
                        if self.is_(j, "<"):
                            j = self._after_angle(j, self.n)
                            continue
                        name = j if self.k[j] == "i" else name
                        j += 1
                    if self.is_(j, "("):
                        break
                if self.is_(j, "!"):
                    j += 1
                if self.is_(j, ":"):
                    j += 1
                    while j < self.n and not self.is_(j, "=", ",", ";", ")", "of", "in") and not (self.first(j) and self.ends_line(j)):
                        j = self._after_angle(j, self.n) if self.is_(j, "<") else self.skip(j)
                a = b = -1
                if self.is_(j, "="):
                    a, b = j + 1, self.expression_end(j + 1)
                    j = b
                if name >= 0:
                    out.append((i, name, a, b))
                if not self.is_(j, ","):
                    break
                j += 1
        return out

    def within(self) -> list[int]:
        """For each token the number of the innermost function it lies in, -1 outside; of a function both its parameters and its body."""
        spans = sorted((f.start, f.body[1], n) for n, f in enumerate(self.functions))
        out, stack, at = [-1] * self.n, [], 0
        for i in range(self.n):
            while at < len(spans) and spans[at][0] <= i:
                stack.append(spans[at])
                at += 1
            while stack and stack[-1][1] < i:
                stack.pop()
            if stack:
                out[i] = stack[-1][2]
        return out


# The tokens that open another path, and those that nest what they hold.
_PATHS = {"web": ("if", "case", "catch", "for", "while", "do"), "go": ("if", "case", "for"), "rust": ("if", "for", "while", "loop"), "dart": ("if", "case", "catch", "for", "while", "do")}
_BOOLEAN = ("&&", "||", "??", "??=")
_NESTS = ("if", "for", "while", "do", "switch", "catch", "match", "loop", "select")


def _paths(code: Code, a: int, b: int) -> int:
    words = _PATHS["web" if code.language in WEB else code.language]
    n = 0
    for i in range(a, b):
        w = code.x[i]
        if code.k[i] == "i":
            n += w in words and not code.is_(i - 1, ".", "?.") and not (w == "while" and code.is_(i - 1, "}") and code.head.get(code.mate[i - 1]) == "do")
        elif code.k[i] == "p":
            n += w in _BOOLEAN or w == "?" and is_ternary(code, i)
    return n


def is_ternary(code: Code, i: int) -> bool:
    """Whether a question mark opens a conditional, and not an optional name or a nullable type."""
    if code.language in ("go", "rust") or i + 1 >= code.n or code.is_(i + 1, ":", ",", ")", ";", "=", ">", "]") or code.is_(i - 1, "?"):
        return False
    j, depth = i + 1, 0
    while j < code.n:
        if code.is_(j, "?") and not code.is_(j + 1, ":", ",", ")", ";", "=", ">", "]"):
            depth += 1
        elif code.is_(j, ":"):
            if not depth:
                return True
            depth -= 1
        elif code.is_(j, ";", ",") or code.k[j] == "p" and code.x[j] in _CLOSES:
            return False
        j = code.skip(j)
    return False


def _cognitive(code: Code, f: Function) -> int:
    """One for each structure and one more for each it stands in; one for each boolean operator and each call of the function itself."""
    total, i, end = 0, f.body[0] + 1, f.body[1]
    nests: list[int] = []
    while i < end:
        while nests and nests[-1] <= i:
            nests.pop()
        w = code.x[i]
        if code.k[i] == "i" and w in _NESTS and not code.is_(i - 1, ".", "?.") and not (w == "while" and code.is_(i - 1, "}") and code.head.get(code.mate[i - 1]) == "do"):
            total += 1 + len(nests)
            nests.append(_extent(code, i, end))
            nests.sort(reverse=True)
        elif code.k[i] == "p":
            if w == "?" and is_ternary(code, i):
                total += 1 + len(nests)
                nests.append(code.expression_end(i))
                nests.sort(reverse=True)
            total += w in ("&&", "||", "??")
        elif code.k[i] == "i" and w == f.name and code.is_(i + 1, "(") and not code.is_(i - 1, "."):
            total += 1
        i += 1
    return total


def _extent(code: Code, i: int, end: int) -> int:
    """Where the statement of a control word ends: its branches belong to it."""
    j = i + 1
    while j < end:
        if code.is_(j, "{"):
            j = code.skip(j)
            if code.is_(j, "else", "catch", "finally") or code.x[i] == "do" and code.is_(j, "while"):
                j += 1
                continue
            return j
        if code.is_(j, ";"):
            if code.is_(j + 1, "else"):
                j += 2
                continue
            return j
        if code.k[j] == "p" and code.x[j] in _CLOSES:
            return j
        j = code.skip(j)
    return end


class Shape(NamedTuple):
    functions: list[tuple[str, int, int, int, int, int]]
    classes: int
    interfaces: int
    aliases: int
    enums: int
    complexity: int


def shape_of(text: str, language: str) -> Shape | None:
    """Functions as (name, first line, last line, cyclomatic, cognitive, parameters), the counts of other declarations and the sum of
    complexities, at least 1. None for Python that does not parse and for languages without structure here."""
    if language == "python":
        return _python_shape(text)
    if language not in (*WEB, "dart", "go", "rust"):
        return None
    code = Code(text, language)
    functions = []
    for f in code.functions:
        if f.kind in ("arrow", "function") and not f.name and language in WEB:
            continue  # callbacks without a name are not listed
        end = min(f.body[1], code.n - 1)
        functions.append((f.name or "<anonymous>", code.l[f.start], code.l[end], 1 + _paths(code, f.start, end), _cognitive(code, f), f.count))
    word = {"class": 0, "interface": 0, "type": 0, "enum": 0}
    for i in range(code.n - 1):
        if code.k[i] != "i" or code.is_(i - 1, ".", "?."):
            continue
        w, named = code.x[i], code.k[i + 1] == "i"
        if language == "rust":
            w = {"struct": "class", "trait": "interface"}.get(w, w)
        elif language == "go" and w == "type" and named:
            word["type"] += 1
            w = {"struct": "class", "interface": "interface"}.get(code.x[i + 2] if i + 2 < code.n else "", "")
            word[w or "type"] += bool(w)
            continue
        elif language == "dart":
            w = {"mixin": "class", "extension": "class", "typedef": "type"}.get(w, w)
        if w in word and named and not (w == "type" and language in WEB and not code.is_(i + 2, "=", "<")) and not (w == "class" and code.is_(i - 1, "mixin")):
            word[w] += 1
    return Shape(functions, word["class"], word["interface"], word["type"], word["enum"], max(1, sum(f[3] for f in functions)))


_PY_PATHS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.BoolOp)


def _python_shape(text: str) -> Shape | None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    functions, classes = [], 0
    for node in ast.walk(tree):
        classes += isinstance(node, ast.ClassDef)
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda):
            paths = sum((len(n.values) - 1 if isinstance(n, ast.BoolOp) else 1 + len(n.ifs) if isinstance(n, ast.comprehension) else 1) for n in ast.walk(node) if isinstance(n, _PY_PATHS))
            a = node.args
            names = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else []))]
            count = len(names) - (bool(names) and names[0] in ("self", "cls"))
            functions.append((getattr(node, "name", "<lambda>"), node.lineno, node.end_lineno, 1 + paths, _python_cognitive(node), count))
    return Shape(functions, classes, 0, 0, 0, max(1, sum(f[3] for f in functions)))


def _python_cognitive(function: ast.AST) -> int:
    total, todo = 0, [(n, 0) for n in ast.iter_child_nodes(function)]
    name = getattr(function, "name", None)
    while todo:
        node, deep = todo.pop()
        if isinstance(node, ast.If | ast.For | ast.AsyncFor | ast.While | ast.ExceptHandler | ast.IfExp | ast.Match):
            total += 1 + deep
            deep += 1
        elif isinstance(node, ast.BoolOp):
            total += len(node.values) - 1
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == name:
            total += 1
        todo += ((n, deep) for n in ast.iter_child_nodes(node))
    return total

