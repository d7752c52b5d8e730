"""Rules about the structure of TypeScript, JavaScript and Dart texts, over the tokens of :mod:`codelode.operators.structure`.

Each rule is a function of one text's :class:`Code` that yields lines; all of them run in one Arrow pass over the files, from one
tokenization a file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.operators import taint
from codelode.operators.sourcefiles import language_of
from codelode.operators.structure import _LEAVES, _LOOPS, WEB, Code, Function, is_ternary
from codelode.session import spread as spread_out

ALL, TS = (*WEB, "dart"), ("typescript", "tsx")
Check = Callable[[Code], Iterator[int]]
#: Rule id to severity, languages and check, in order of registration.
TREE_RULES: dict[str, tuple[str, tuple[str, ...], Check]] = {}
#: Values a number may have without a name, and from which size on it needs one.
PLAIN_NUMBERS, LEAST_NUMBER = frozenset((-1, 0, 1, 2, 10, 100, 1000)), 3
_ASSIGNS = frozenset("= += -= *= /= %= &= |= ^= **= <<= >>= >>>= &&= ||= ??=".split())
_TEST_PATH = re.compile(r"\.spec\.|\.test\.|__tests__")


def rule(name: str, severity: str, languages: tuple[str, ...] = ALL) -> Callable[[Check], Check]:
    def register(check: Check) -> Check:
        TREE_RULES[name] = (severity, languages, check)
        return check

    return register


def member(c: Code, i: int) -> bool:
    return c.is_(i - 1, ".", "?.")


def words(c: Code, *names: str) -> Iterator[int]:
    for i in range(c.n):
        if c.k[i] == "i" and c.x[i] in names and not member(c, i):
            yield i


def puncts(c: Code, *signs: str) -> Iterator[int]:
    for i in range(c.n):
        if c.k[i] == "p" and c.x[i] in signs:
            yield i


def inner(c: Code, f: Function) -> tuple[int, int]:
    return (f.body[0] + 1, f.body[1]) if f.whole else f.body


def blocks(c: Code) -> Iterator[tuple[int, int]]:
    """The insides of braces that hold statements."""
    for i, role in c.role.items():
        if role in ("function", "control", "block") and c.mate[i] > i:
            yield i + 1, c.mate[i]


def operand_before(c: Code, i: int) -> int:
    """Where the operand begins that ends before token ``i``: names, members, calls and subscripts."""
    j = i - 1
    while j >= 0:
        if c.k[j] == "p" and c.x[j] in (")", "]") and c.mate[j] >= 0:
            j = c.mate[j]
            if c.k[j - 1] == "i" or c.is_(j - 1, ")", "]"):
                j -= 1
                continue
        elif c.k[j] != "i" and c.k[j] not in "nstr":
            return j + 1
        if member(c, j):
            j -= 2
            continue
        return j
    return 0


def operand_after(c: Code, i: int) -> int:
    """Where the operand ends that begins at token ``i``."""
    j = c.skip(i) if i < c.n else i
    while j < c.n:
        if c.is_(j, ".", "?.") and j + 1 < c.n and (c.k[j + 1] == "i" or c.is_(j + 1, "(", "[")):
            j += 1 if c.is_(j + 1, "(", "[") else 2
        elif c.is_(j, "(", "[") and not c.first(j):
            j = c.skip(j)
        else:
            return j
    return c.n


def simple(c: Code, a: int, b: int) -> bool:
    """Whether tokens are one name, member, call or subscript."""
    return b > a and c.k[a] == "i" and c.x[a] not in ("true", "false", "null", "undefined", "await", "typeof", "new", "void", "return") and operand_after(c, a) == b


def text_of(c: Code, a: int, b: int) -> str:
    return " ".join(c.x[a:b])


def in_loop(c: Code, i: int, over_functions: bool = False) -> bool:
    """Whether token ``i`` lies in the body or the head of a loop, within its function unless ``over_functions``."""
    j = i
    while True:
        # A loop without braces holds what follows its head in the same statement.
        k = j - 1
        while k >= 0 and not c.is_(k, ";", "{", "}") and c.up[k] == c.up[j]:
            if c.is_(k, ")") and c.mate[k] >= 0:
                k = c.mate[k]
                if c.is_(k - 1, "for", "while", "await"):
                    return True
            if c.is_(k, "=>"):
                if not over_functions:
                    return False
            k -= 1
        j = c.up[j]
        if j < 0:
            return False
        if c.x[j] == "{":
            if c.role.get(j) == "function" and not over_functions:
                return False
            if c.head.get(j) in _LOOPS:
                return True
        elif c.x[j] == "(" and c.is_(j - 1, "for", "while"):
            return True


def assigned(c: Code) -> Iterator[tuple[int, str]]:
    """Plain names that are assigned or updated after their declaration, with their place."""
    for i in range(c.n):
        if c.k[i] != "p":
            continue
        if c.x[i] in _ASSIGNS and i and c.k[i - 1] == "i" and not member(c, i - 1) and not c.is_(i - 2, "const", "let", "var", "final", ":", "type", "enum") and (i < 2 or c.k[i - 2] != "i" or c.first(i - 1) or c.x[i - 2] in ("return", "else", "do", "case", "await", "yield")):
            yield i - 1, c.x[i - 1]
        elif c.x[i] in ("++", "--"):
            if i and c.k[i - 1] == "i" and not member(c, i - 1) and not c.first(i):
                yield i - 1, c.x[i - 1]
            elif i + 1 < c.n and c.k[i + 1] == "i" and not c.is_(i + 2, ".", "["):
                yield i + 1, c.x[i + 1]


def substitutions(c: Code) -> Iterator[tuple[int, str]]:
    """The code within templates, and in Dart within strings, with the place of its token."""
    for i in range(c.n):
        if c.k[i] == "t" or c.k[i] == "s" and c.language == "dart" and "$" in c.x[i]:
            for m in re.finditer(r"\$\{((?:[^{}]|\{[^{}]*\})*)\}|\$(\w+)", c.x[i]):
                yield i, m[1] or m[2] or ""


def imports(c: Code) -> Iterator[tuple[int, int, str, bool]]:
    """Names an import binds: keyword, place, name, and whether it is already a type import."""
    for i in words(c, "import"):
        if c.is_(i + 1, "(", ".") or not c._begins(i):
            continue
        j, typed = i + 1, c.is_(i + 1, "type") and not c.is_(i + 2, "from", ",")
        j += typed
        while j < c.n and c.k[j] != "s" and not c.is_(j, ";", "from"):
            if c.is_(j, "{"):
                k, end = j + 1, c.mate[j]
                while k < end:
                    stop = k
                    while stop < end and not c.is_(stop, ","):
                        stop += 1
                    if stop > k:
                        yield i, stop - 1, c.x[stop - 1], typed or c.is_(k, "type") and stop - k > 1
                    k = stop + 1
                j = max(end, j) + 1
                continue
            if c.k[j] == "i" and c.x[j] not in ("as", "type"):
                yield i, j, c.x[j], typed
            j += 1


def lines(c: Code, places: Iterator[int]) -> Iterator[int]:
    return (c.l[i] for i in places)


@rule("camelcase", "minor")
def camelcase(c):
    for _, name, _, _ in c.declarators():
        w = c.x[name]
        if not re.fullmatch(r"[A-Z0-9_]+|[a-z][^_]*|_[^_]*", w):
            yield c.l[name]


@rule("consistent-type-imports", "minor", TS)
def consistent_type_imports(c):
    bound = [(i, p, w) for i, p, w, typed in imports(c) if not typed]
    if not bound:
        return
    places = {p for _, p, _ in bound}
    values, types = set(), set()
    clause = {j for i in words(c, "import") for j in range(i, c.expression_end(i))}
    for i in range(c.n):
        if c.k[i] == "i" and i not in places and i not in clause and not member(c, i):
            as_type = c.is_(i - 1, ":", "<", "|", "&", "implements", "as", "extends", "keyof", "is", "satisfies") and not c.is_(i + 1, "(", ".") and not (c.is_(i - 1, ":") and c.role.get(c.up[i]) == "object")
            as_type = as_type or c.role.get(c.up[i]) in ("interface", "type") or c.is_(i + 1, ">", "[") and c.is_(i - 1, ",", "<", ":")
            if as_type and not (c.is_(i - 1, "extends") and _class_head(c, i)):
                types.add(c.x[i])
            else:
                values.add(c.x[i])
    values |= {w for _, s in substitutions(c) for w in re.findall(r"[\w$]+", s)}
    values |= {t[1:] for t in c.x if t.startswith("@")}
    for _, p, w in bound:
        if w in types and w not in values:
            yield c.l[p]


def _class_head(c: Code, i: int) -> bool:
    while i > 0 and not c.is_(i, "{", "}", ";"):
        if c.is_(i, "class"):
            return True
        i -= 1
    return False


@rule("dart/avoid-empty-catch", "major", ("dart",))
def dart_empty_catch(c):
    commented = [line for line, _ in c.comments]
    for i, role in c.role.items():
        if role == "control" and c.head.get(i) == "catch" and c.mate[i] == i + 1 and not any(c.l[i] <= x <= c.l[i + 1] for x in commented):
            yield c.l[i]


@rule("default-case", "major")
def default_case(c):
    for i, role in c.role.items():
        if role == "switch" and c.mate[i] > i and not any(c.is_(j, "default") and c.is_(j + 1, ":") for j in range(i, c.mate[i])):
            yield c.l[max(0, c.mate[i - 1] - 1 if c.is_(i - 1, ")") else i)]


@rule("no-async-promise-executor", "critical", WEB)
def async_executor(c):
    return (c.l[i] for i in words(c, "Promise") if c.is_(i - 1, "new") and c.is_(i + 1, "(") and c.is_(i + 2, "async"))


@rule("no-await-in-loop", "minor")
def await_in_loop(c):
    return (c.l[i] for i in words(c, "await") if not c.is_(i - 1, "for") and in_loop(c, i))


@rule("no-bitwise", "major")
def bitwise(c):
    for i in puncts(c, "&", "|", "^", "~", "<<", ">>", ">>>"):
        w, before = c.x[i], c.k[i - 1] if i else ""
        if w == "~":
            yield c.l[i]
        elif before in "inst" and before or c.is_(i - 1, ")", "]"):
            if w in ("&", "|", ">>", ">>>") and _typeish(c, i):
                continue
            yield c.l[i]


def _typeish(c: Code, i: int) -> bool:
    """Whether a sign stands in a type: after a colon, ``type``, ``as`` or an open angle in the same expression."""
    if c.language not in TS and c.language != "dart":
        return False
    j, angle = i - 1, 0
    if c.role.get(c.up[i]) in ("interface", "type"):
        return True
    while j >= 0 and i - j < 60:
        if c.k[j] == "p" and c.x[j] in (")", "]", "}") and c.mate[j] >= 0:
            j = c.mate[j] - 1
            continue
        if c.is_(j, "<"):
            angle += 1
            if c.x[i] in (">>", ">>>") or angle > 0:
                return True
        if c.is_(j, "as", "type", "implements", "extends", "satisfies", "keyof"):
            return True
        if c.is_(j, ":"):
            return c.role.get(c.up[i]) != "object" and not c._ternary(j) and not c.is_(j - 1, "default") and not _case(c, j)
        if c.is_(j, ";", "{", "(", "[", "=", "return", "&&", "||", "?"):
            if c.is_(j, "=") and c._type_alias(j + 1):
                return True
            return False
        if c.first(j + 1) and c.ends_line(j + 1):
            return False
        j -= 1
    return False


def _case(c: Code, j: int) -> bool:
    while j >= 0 and not c.first(j):
        j -= 1
    return c.is_(j, "case", "default")


@rule("no-console", "minor", WEB)
def console(c):
    return (c.l[i] for i in words(c, "console") if c.is_(i + 1, ".") and c.is_(i + 3, "("))


@rule("no-control-regex", "major", WEB)
def control_regex(c):
    for i in range(c.n):
        if c.k[i] == "r" and (re.search(r"[\x00-\x1f\x7f]", c.x[i]) or any(int(x, 16) < 0x20 or int(x, 16) == 0x7F for x in re.findall(r"\\x([0-9a-fA-F]{2})", c.x[i]))):
            yield c.l[i]


@rule("no-dupe-keys", "critical")
def dupe_keys(c):
    for i, role in c.role.items():
        if role != "object" or c.mate[i] < 0:
            continue
        seen, j, end = set(), i + 1, c.mate[i]
        while j < end:
            k = j
            while c.is_(k, "async", "get", "set", "*") and not c.is_(k + 1, ":", ",", "(", "}"):
                k += 1
            pair = c.is_(k - 1, "get", "set") and k > j
            key = c.x[k].strip("'\"`") if c.k[k] in "isn" else text_of(c, k, c.expression_end(k)) if c.is_(k, "...") else None
            if key is not None and c.k[k] in "isnp" and not pair:
                if key in seen:
                    yield c.l[k]
                seen.add(key)
            while j < end and not c.is_(j, ","):
                j = c.skip(j)
            j += 1


def _ends_in_leave(c: Code, a: int, b: int) -> bool:
    some = c.statements(a, b)
    return bool(some) and c.is_(some[-1][0], *_LEAVES)


@rule("no-duplicate-imports", "major")
def duplicate_imports(c):
    seen = set()
    for i in words(c, "import"):
        if not c._begins(i) or c.is_(i + 1, "(", "."):
            continue
        j = i + 1
        while j < c.n and c.k[j] != "s" and not c.is_(j, ";"):
            j = c.skip(j)
        if j < c.n and c.k[j] == "s":
            if c.x[j] in seen:
                yield c.l[i]
            seen.add(c.x[j])


@rule("no-else-return", "minor")
def else_return(c):
    for i in words(c, "else"):
        if c.is_(i - 1, "}") and c.head.get(c.mate[i - 1]) in ("if", "else"):
            if _ends_in_leave(c, c.mate[i - 1] + 1, i - 1):
                yield c.l[i]
        elif c.is_(i - 1, ";"):
            j = i - 2
            while j > 0 and not c.is_(j, ";", "{", "}") and not (c.is_(j, *_LEAVES) and c.is_(j - 1, ")")):
                j -= 1
            if c.is_(j, *_LEAVES):
                yield c.l[i]


@rule("no-empty-function", "minor")
def empty_function(c):
    return (c.l[f.start] for f in c.functions if f.whole and f.body[1] == f.body[0] + 1)


@rule("no-empty-interface", "major", TS)
def empty_interface(c):
    for i, role in c.role.items():
        if role == "interface" and c.mate[i] == i + 1 and c.is_(i - 2, "interface"):
            yield c.l[i]


@rule("no-eqeqeq", "major")
def eqeqeq(c):
    return lines(c, puncts(c, "==", "!="))


@rule("no-eval", "blocker", WEB)
def eval_call(c):
    return (c.l[i] for i in words(c, "eval") if c.is_(i + 1, "(") and not c.is_(i - 1, "function"))


@rule("no-explicit-any", "major", TS)
def explicit_any(c):
    return (c.l[i] for i in words(c, "any") if c.is_(i - 1, ":", "<", "|", "&", ",", "as", "=", "=>", "(", "extends") and not c.is_(i + 1, "(", ".", ":", "=>"))


@rule("no-extra-bind", "minor")
def extra_bind(c):
    for i in range(2, c.n - 2):
        if c.k[i] == "i" and c.x[i] == "bind" and member(c, i) and c.is_(i + 1, "(") and c.is_(i + 2, "this") and c.is_(i + 3, ")"):
            a = operand_before(c, i - 1)
            if c.is_(i - 2, "}") and c.mate[i - 2] >= 0:  # a function expression
                a = next((f.start for f in c.functions if f.body[1] == i - 2), a)
            if "this" not in c.x[a : i - 1]:
                yield c.l[a]


@rule("no-extra-boolean-cast", "minor")
def boolean_cast(c):
    for i in range(c.n):
        if c.is_(i, "!") and c.is_(i + 1, "!") and not c.is_(i - 1, "!"):
            yield c.l[i]
        elif c.is_(i, "Boolean") and c.is_(i + 1, "(") and not c.is_(i - 1, "new", ".") and c.mate[i + 1] > 0:
            inside = range(i + 2, c.mate[i + 1])
            if any(c.is_(j, "!", "===", "!==", "==", "!=", "<", ">", "<=", ">=", "true", "false", "&&", "||") for j in inside):
                yield c.l[i]


def _cases(c: Code, i: int) -> list[tuple[int, int, int]]:
    """The sections of a switch: keyword, begin and end of its statements."""
    marks, j, end = [], i + 1, c.mate[i]
    while j < end:
        if c.is_(j, "case", "default"):
            k = j + 1
            while k < end and not c.is_(k, ":") or c._ternary(k) and k < end:
                k = c.skip(k)
            marks.append((j, k + 1))
            j = k + 1
            continue
        j = c.skip(j)
    return [(a, b, marks[n + 1][0] if n + 1 < len(marks) else end) for n, (a, b) in enumerate(marks)]


@rule("no-fallthrough", "critical")
def fallthrough(c):
    for i, role in c.role.items():
        if role == "switch" and c.mate[i] > i:
            for keyword, a, b in _cases(c, i)[:-1]:
                some = c.statements(a, b)
                if len(some) == 1 and c.is_(some[0][0], "{"):
                    some = c.statements(some[0][0] + 1, c.mate[some[0][0]])
                if some and not any(c.is_(s, *_LEAVES) for s, _ in some):
                    yield c.l[keyword]


@rule("no-html-link", "critical", ("tsx", "jsx", "dart"))
def html_link(c):
    return lines(c, words(c, "dangerouslySetInnerHTML"))


@rule("no-implicit-any", "minor", TS)
def implicit_any(c):
    for f in c.functions:
        if f.kind == "arrow" and len(f.parameters) == 1 and not c.is_(f.parameters[0][1] - 1, "(", ","):
            continue  # a bare name has no place for a type
        for name, at, typed in f.parameters:
            if not typed and name != "this":
                yield c.l[at]


@rule("no-implied-eval", "critical", WEB)
def implied_eval(c):
    for i in range(c.n):
        if c.is_(i, "setTimeout", "setInterval") and c.k[i] == "i" and c.is_(i + 1, "(") and c.mate[i + 1] > 0:
            j = i + 2
            while j < c.mate[i + 1]:
                end = c.expression_end(j)
                if end == j + 1 and c.k[j] in "st":
                    yield c.l[i]
                    break
                j = end + 1


@rule("no-import-assign", "major")
def import_assign(c):
    names = {w for _, _, w, _ in imports(c)}
    return (c.l[i] for i, w in assigned(c) if w in names)


@rule("no-lonely-if", "minor")
def lonely_if(c):
    for i in words(c, "else"):
        if c.is_(i + 1, "if") or c.is_(i + 1, "{") and c.is_(i + 2, "if") and c.mate[i + 1] > 0 and len(c.statements(i + 2, c.mate[i + 1])) == 1:
            yield c.l[i]


@rule("no-magic-numbers", "info")
def magic_numbers(c):
    named = {a for _, _, a, b in c.declarators() if b == a + 1}
    for i in range(c.n):
        if c.k[i] != "n" or i in named or not re.fullmatch(r"[0-9][0-9_]*", c.x[i]):
            continue
        n = int(c.x[i].replace("_", ""))
        if n in PLAIN_NUMBERS or n < LEAST_NUMBER:
            continue
        j = c.up[i]
        while j >= 0 and c.role.get(j) != "enum":
            j = c.up[j]
        if j < 0:
            yield c.l[i]


@rule("no-misused-new", "major", TS)
def misused_new(c):
    names = {c.x[i + 1] for i in words(c, "interface") if i + 1 < c.n and c.k[i + 1] == "i"}
    return (c.l[i] for i in words(c, "new") if i + 1 < c.n and c.x[i + 1] in names)


@rule("no-negated-condition", "minor")
def negated_condition(c):
    for i in words(c, "if"):
        if not c.is_(i + 1, "(") or c.mate[i + 1] < 0:
            continue
        j = i + 2
        while c.is_(j, "("):
            j += 1
        if c.is_(j, "!"):
            k = c.mate[i + 1] + 1
            k = c.skip(k) if c.is_(k, "{") else _simple_end(c, k)
            if c.is_(k, "else"):
                yield c.l[i]


def _simple_end(c: Code, k: int) -> int:
    while k < c.n and not c.is_(k, ";", "}", "else"):
        k = c.skip(k)
    return k + 1 if c.is_(k, ";") else k


@rule("no-nested-ternary", "minor")
def nested_ternary(c):
    marks = [i for i in puncts(c, "?") if is_ternary(c, i)]
    for n, i in enumerate(marks):
        end = c.expression_end(i)
        if n + 1 < len(marks) and marks[n + 1] < end:
            yield c.l[i]


@rule("no-new-buffer", "major")
def new_buffer(c):
    return (c.l[i] for i in words(c, "Buffer") if c.is_(i - 1, "new"))


@rule("no-new-func", "blocker", WEB)
def new_func(c):
    return (c.l[i] for i in words(c, "Function") if c.is_(i - 1, "new"))


@rule("no-new-symbol", "major", WEB)
def new_symbol(c):
    return (c.l[i] for i in words(c, "Symbol") if c.is_(i - 1, "new"))


@rule("no-non-null-assertion", "minor", TS)
def non_null(c):
    for i in puncts(c, "!"):
        if i and (c.k[i - 1] == "i" and c.x[i - 1] not in ("return", "typeof", "case", "in", "of", "await", "throw", "else", "yield") or c.is_(i - 1, ")", "]")) and not c.first(i) and (c.is_(i + 1, ".", ";", ",", ")", "]", "[", "(", "}", "!", ":", "?.", "&&", "||", "+", "-", "*", "/", "===", "!==", "as") or i + 1 == c.n or c.first(i + 1)):
            if not c.is_(i + 1, ":") or c.role.get(c.up[i]) != "class":
                yield c.l[i]


@rule("no-param-reassign", "major")
def param_reassign(c):
    writes = list(assigned(c))
    for f in c.functions:
        names = {w for w, _, _ in f.parameters if w != "this"}
        if names:
            a, b = f.body
            yield from (c.l[i] for i, w in writes if w in names and a < i < b)


@rule("no-promise-all-in-loop", "minor")
def promise_all_in_loop(c):
    return (c.l[i] for i in words(c, "Promise") if c.is_(i + 1, ".") and c.is_(i + 2, "all") and c.is_(i + 3, "(") and in_loop(c, i, True))


@rule("no-proto", "major", WEB)
def proto(c):
    return (c.l[i] for i in range(c.n) if c.k[i] == "i" and c.x[i] == "__proto__" and member(c, i))


@rule("no-prototype-builtins", "critical", WEB)
def prototype_builtins(c):
    return (c.l[i] for i in range(c.n) if c.k[i] == "i" and c.x[i] in ("hasOwnProperty", "isPrototypeOf", "propertyIsEnumerable") and member(c, i) and c.is_(i + 1, "("))


@rule("no-redeclare", "critical")
def redeclare(c):
    seen = set()
    for k, n, _, _ in c.declarators():
        if c.up[k] < 0:
            if c.x[n] in seen:
                yield c.l[n]
            seen.add(c.x[n])


@rule("no-return-await", "minor")
def return_await(c):
    inside = c.within()
    for i in words(c, "return"):
        f = inside[i]
        if f < 0 or not c.functions[f].is_async:
            continue
        if any(c.is_(j, "await") and inside[j] == f for j in range(i + 1, c.expression_end(i + 1))):
            yield c.l[i]


@rule("no-script-url", "critical", WEB)
def script_url(c):
    return (c.l[i] for i in range(c.n) if c.k[i] in "st" and c.x[i][1:12].lower() == "javascript:")


@rule("no-self-compare", "major")
def self_compare(c):
    for i in puncts(c, "===", "!==", "==", "!=", "<", ">", "<=", ">="):
        a, b = operand_before(c, i), operand_after(c, i + 1)
        if a < i < b and c.k[a] == "i" and c.x[a:i] == c.x[i + 1 : b] and not c.is_(a - 1, "+", "-", "*", "/", "%"):
            yield c.l[i]


@rule("no-sparse-arrays", "major")
def sparse_arrays(c):
    for i in puncts(c, "["):
        if c.mate[i] < 0 or i and (c.k[i - 1] in "its" and c.x[i - 1] not in ("return", "of", "in", "case", "typeof", "await") or c.is_(i - 1, ")", "]")) or c.is_(i - 1, "const", "let", "var"):
            continue
        if c.is_(c.mate[i] + 1, "="):
            continue
        if any(c.is_(j, ",") and c.is_(j + 1, ",") and c.up[j] == i for j in range(i + 1, c.mate[i])):
            yield c.l[i]


@rule("no-throw-literal", "major")
def throw_literal(c):
    return (c.l[i] for i in words(c, "throw") if i + 1 < c.n and (c.k[i + 1] in "nstr" or c.is_(i + 1, "true", "false", "null", "undefined", "-", "!", "+", "~", "typeof", "void")))


@rule("no-underscore-dangle", "minor")
def underscore_dangle(c):
    places = {n for _, n, _, _ in c.declarators()} | {p for f in c.functions for _, p, _ in f.parameters}
    places |= {i + 1 for i in words(c, "function") if i + 1 < c.n and c.k[i + 1] == "i"}
    return (c.l[i] for i in sorted(places) if c.x[i].endswith("_") and c.x[i] != "_")


@rule("no-unneeded-ternary", "minor")
def unneeded_ternary(c):
    return (c.l[i] for i in puncts(c, "?") if c.is_(i + 2, ":") and (c.is_(i + 1, "true") and c.is_(i + 3, "false") or c.is_(i + 1, "false") and c.is_(i + 3, "true")))


@rule("no-unreachable", "critical")
def unreachable(c):
    for a, b in blocks(c):
        some = c.statements(a, b)
        for n, (s, _) in enumerate(some[:-1]):
            if c.is_(s, *_LEAVES):
                yield c.l[some[n + 1][0]]
                break


@rule("no-unsafe-finally", "critical", WEB)
def unsafe_finally(c):
    inside = c.within()
    for i in words(c, "finally"):
        if c.is_(i + 1, "{") and c.mate[i + 1] > 0:
            yield from (c.l[j] for j in words(c, *_LEAVES) if i < j < c.mate[i + 1] and inside[j] == inside[i])


@rule("no-unused-vars", "major")
def unused_vars(c):
    inside = c.within()
    declared = [(c.x[n], n) for _, n, _, _ in c.declarators() if inside[n] >= 0] + [(w, p) for f in c.functions if f.kind != "method" or f.body for w, p, _ in f.parameters]
    places = {p for _, p in declared}
    uses: dict[str, list[int]] = {}
    for i in range(c.n):
        if c.k[i] == "i" and i not in places:
            uses.setdefault(c.x[i], []).append(i)
    for i, s in substitutions(c):
        for w in re.findall(r"[A-Za-z_$][\w$]*", s):
            uses.setdefault(w, []).append(i)
    seen = set()
    for w, p in declared:
        if w.startswith("_") or p in seen:
            continue
        seen.add(p)
        f = c.functions[inside[p]] if inside[p] >= 0 else None
        if f is not None and not any(f.start <= i <= f.body[1] for i in uses.get(w, ())):
            yield c.l[p]


@rule("no-useless-concat", "minor")
def useless_concat(c):
    return (c.l[i] for i in puncts(c, "+") if i and i + 1 < c.n and c.k[i - 1] in "st" and c.k[i + 1] in "st")


@rule("no-useless-rename", "minor")
def useless_rename(c):
    for i in words(c, "as"):
        if c.role.get(c.up[i]) == "import" and i and i + 1 < c.n and c.x[i - 1] == c.x[i + 1]:
            yield c.l[i]


@rule("no-useless-return", "minor")
def useless_return(c):
    for a, b in blocks(c):
        some = c.statements(a, b)
        if some and c.is_(some[-1][0], "return") and (some[-1][1] - some[-1][0] == 1 or c.is_(some[-1][0] + 1, ";")):
            yield c.l[some[-1][0]]


@rule("no-var", "major", WEB)
def var(c):
    return (c.l[i] for i in words(c, "var") if i + 1 < c.n and (c.k[i + 1] == "i" or c.is_(i + 1, "{", "[")))


@rule("no-warning-comments", "info")
def warning_comments(c):
    for line, text in c.comments:
        m = re.search(r"\b(?:TODO|FIXME|XXX|HACK)\b", text)
        if m and text[m.end() : m.end() + 1] != "(":
            yield line + text.count("\n", 0, m.start())


@rule("no-with", "critical", WEB)
def with_statement(c):
    return (c.l[i] for i in words(c, "with") if c.is_(i + 1, "(") and c._begins(i))


@rule("prefer-arrow-callback", "minor")
def arrow_callback(c):
    return (c.l[i] for i in words(c, "function") if c.is_(i - 1, "(", ",") and c.up[i] >= 0 and c.x[c.up[i]] == "(" and (c.k[c.up[i] - 1] == "i" or c.is_(c.up[i] - 1, ")", "]")) and not c.is_(c.up[i] - 1, "if", "while", "for", "return", "switch"))


@rule("prefer-const", "minor")
def prefer_const(c):
    names = {w for _, w in assigned(c)}
    return (c.l[n] for k, n, a, _ in c.declarators() if c.x[k] == "let" and a >= 0 and c.x[n] not in names)


@rule("prefer-nullish-coalescing", "minor", TS)
def nullish(c):
    return (c.l[i] for i in puncts(c, "||") if simple(c, operand_before(c, i), i) and simple(c, i + 1, operand_after(c, i + 1)))


@rule("prefer-optional-chain", "minor", TS)
def optional_chain(c):
    for i in puncts(c, "&&"):
        a, b = operand_before(c, i), operand_after(c, i + 1)
        left = c.x[a:i]
        if a < i and c.k[a] == "i" and c.x[i + 1 : i + 1 + len(left)] == left and i + 1 + len(left) < b and c.is_(i + 1 + len(left), "."):
            yield c.l[i]


@rule("prefer-promise-reject-errors", "major", WEB)
def reject_errors(c):
    return (c.l[i] for i in words(c, "Promise") if c.is_(i + 2, "reject") and c.is_(i + 3, "(") and i + 4 < c.n and (c.k[i + 4] in "nst" or c.is_(i + 4, "true", "false", "null", "undefined")))


@rule("prefer-spread", "minor")
def spread(c):
    return (c.l[i] for i in range(3, c.n) if c.k[i] == "i" and c.x[i] == "concat" and c.is_(i - 1, ".") and c.is_(i - 2, "]") and c.is_(i - 3, "["))


@rule("prefer-template", "minor")
def template(c):
    for i in puncts(c, "+"):
        if i and c.k[i - 1] == "s" and i + 1 < c.n and (c.k[i + 1] == "s" or c.k[i + 1] == "i" and c.x[i + 1] not in ("typeof", "await", "new")):
            yield c.l[i]


@rule("quote-props", "minor")
def quote_props(c):
    for i, role in c.role.items():
        if role == "object" and c.mate[i] > i:
            for j in range(i + 1, c.mate[i] - 2):
                if c.up[j] == i and c.k[j] == "i" and c.is_(j + 1, "-") and c.k[j + 2] == "i" and c.is_(j + 3, ":") and c.is_(j - 1, "{", ","):
                    yield c.l[j]


@rule("require-await", "major")
def require_await(c):
    awaits = list(words(c, "await"))
    for f in c.functions:
        if f.is_async and not any(f.body[0] < i <= f.body[1] for i in awaits):
            yield c.l[f.start]


#: Rules that are a pattern over the whole text, whatever it stands in; severity, languages, pattern.
TEXT_RULES: dict[str, tuple[str, tuple[str, ...], re.Pattern]] = {
    # The patterns that these rules are.
    "no-array-constructor": ("minor", WEB, re.compile(r"\bnew\s+Array\s*\(")),
    "no-buffer-constructor": ("blocker", WEB, re.compile(r"\bnew\s+Buffer\s*\(")),
    "no-compare-neg-zero": ("major", WEB, re.compile(r"===\s*-0\b|==\s*-0\b")),
    "no-constant-condition": ("critical", ALL, re.compile(r"\b(if|while)\s*\(\s*(true|false|null|undefined)\s*\)")),
    "no-delete-var": ("critical", WEB, re.compile(r"\bdelete\s+[a-zA-Z_$]")),
    "no-empty-pattern": ("critical", ALL, re.compile(r"\{\s*\}\s*=")),
    "no-new-require": ("critical", WEB, re.compile(r"\bnew\s+require\s*\(")),
    "no-obj-calls": ("critical", ALL, re.compile(r"\b(Math|JSON|Reflect|Intl)\s*\(")),
    "no-octal": ("critical", WEB, re.compile(r"\b0[0-7]+\b")),
    "no-path-concat": ("minor", WEB, re.compile(r"(__dirname|__filename)\s*\+")),
    "no-unsafe-negation": ("critical", WEB, re.compile(r"!\s*\w+\s+in\b|!\s*\w+\s+instanceof\b")),
    "no-void": ("minor", WEB, re.compile(r"\bvoid\s+")),
}
SEVERITIES = {**{r: v[0] for r, v in TREE_RULES.items()}, **{r: v[0] for r, v in TEXT_RULES.items()}, **taint.SEVERITIES}
ISSUE_ROWS = "file_id long, path string, line int, rule_id string, severity string"


def tree_hits(text: str, language: str, path: str, disabled: frozenset[str] = frozenset(), taints: bool = True) -> list[tuple[int, str]]:
    """``(line, rule)`` of all rules that hold in a text, each once a line; a match of a pattern counts where it begins."""
    c = Code(text, language)
    found: dict[tuple[int, str], None] = {}
    for name, (_, languages, check) in TREE_RULES.items():
        if language in languages and name not in disabled and not (name == "no-console" and _TEST_PATH.search(path or "")):
            for line in check(c):
                found[(line, name)] = None
    for name, (_, languages, wanted) in TEXT_RULES.items():
        if language in languages and name not in disabled:
            line, at = 1, 0
            for m in wanted.finditer(text):
                line, at = line + text.count("\n", at, m.start()), m.start()
                found[(line, name)] = None
    if taints and "security/taint-analysis" not in disabled:
        for line, name in taint.taint_hits(c):
            found[(line, name)] = None
    return list(found)


def _hit_rows(hits: Callable[[str, str, str], list[tuple[int, str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, lines_, rules = [], [], []
            for n, (path, language, text) in enumerate(zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)):
                for line, name in hits(text, language, path):
                    at.append(n)
                    lines_.append(line)
                    rules.append(name)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(lines_, pa.int32()), pa.array(rules, pa.string()), pa.array([SEVERITIES[r] for r in rules], pa.string())],
                names=["file_id", "path", "line", "rule_id", "severity"],
            )

    return run


def _source_rows(files: DataFrame) -> DataFrame:
    rows = files.where("file_id is not null and text is not null").select("file_id", "path", language_of(F.col("path")).alias("language"), "text")
    return spread_out(rows.where(F.col("language").isin(*ALL)))


def tree_issues(files: DataFrame, disabled: tuple[str, ...] = (), taints: bool = True) -> DataFrame:
    """``(file_id, path, line, rule_id, severity)`` of all structural rules and patterns, and of tainted sinks, each once a line; null texts and other languages have none.

    Texts are read once and not shuffled; only the issues of files delivered twice are deduplicated.
    """
    off = frozenset(disabled)
    return _source_rows(files).mapInArrow(_hit_rows(lambda text, language, path: tree_hits(text, language, path, off, taints)), ISSUE_ROWS).distinct()


def tainted_sinks(files: DataFrame) -> DataFrame:
    """``(file_id, path, line, rule_id, severity)`` of the calls that user input reaches within one function."""
    return _source_rows(files).mapInArrow(_hit_rows(lambda text, language, path: taint.taint_hits(Code(text, language))), ISSUE_ROWS).distinct()
