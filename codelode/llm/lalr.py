"""Parse tables from grammars written as text, and table-driven recognition of token streams.

Tables are LALR(1) with the lookaheads of DeRemer and Pennello (1982). Where a
grammar leaves a choice all actions are followed side by side, each with its own stack; equal
stacks merge, and should there be more than ``LIMIT`` a graph-structured stack takes over. A text is
rejected only if no derivation of the grammar gives it.

Every terminal is one character in the token stream. A line's effect on the stack
depends only on its terminals and the states on top that it looks at, and is remembered by these.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

END = "\x00"
#: Ways to read a text kept side by side before the graph-structured stack takes over.
LIMIT = 64


@dataclass
class Tables:
    """``action[state][terminal]``: n > 0 shifts to state n - 1, n < 0 reduces by rule -n - 1, 0 accepts; ``others`` has the actions beside."""

    terminals: dict[str, str]
    action: list[dict[str, int]]
    goto: list[dict[int, int]]
    rules: list[tuple[int, int]]
    others: list[dict[str, tuple[int, ...]]]
    conflicts: int = 0
    memo: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "memo": {}}


def rules_of(grammar: str) -> tuple[list[tuple[str, tuple[str, ...]]], str]:
    """Plain rules of a grammar with groups and the marks ``? * +``; and its first name."""
    out: list[tuple[str, tuple[str, ...]]] = []
    made: dict[tuple, str] = {}
    tokens = re.findall(r"'[^']*'|[A-Za-z_]\w*|[:|()?*+;]", re.sub(r"(?m)#.*$", "", grammar))
    at = 0

    def name_for(kind: str, alts: tuple) -> str:
        key = (kind, alts)
        if key not in made:
            made[key] = name = f"_{len(made)}"
            if kind == "?":
                out.extend([(name, ()), *((name, a) for a in alts)])
            elif kind == "*":
                out.extend([(name, ()), *((name, (name, *a)) for a in alts)])
            elif kind == "+":
                out.extend([*((name, a) for a in alts), *((name, (name, *a)) for a in alts)])
            else:
                out.extend((name, a) for a in alts)
        return made[key]

    def alternatives() -> tuple[tuple[str, ...], ...]:
        nonlocal at
        alts: list[tuple[str, ...]] = []
        now: list[str] = []
        while True:
            t = tokens[at] if at < len(tokens) else ";"
            if t in (";", ")"):
                return (*alts, tuple(now))
            at += 1
            if t == "|":
                alts.append(tuple(now))
                now = []
                continue
            if t == "(":
                inner = alternatives()
                at += 1
            else:
                inner = ((t,),)
            mark = tokens[at] if at < len(tokens) and tokens[at] in "?*+" else ""
            if mark:
                at += 1
                now.append(name_for(mark, inner))
            elif t == "(":
                now.append(name_for("(", inner))
            else:
                now.append(t)

    start = tokens[0]
    while at < len(tokens):
        name = tokens[at]
        at += 2
        for alt in alternatives():
            out.append((name, alt))
        at += 1
    return out, start


def build(grammar: str) -> Tables:
    """LALR(1) tables. Terminals are quoted or in capitals; each gets a character of its own."""
    rules, start = rules_of(grammar)
    rules.insert(0, ("_start", (start,)))
    names = {n for n, _ in rules}
    used = sorted({s for _, r in rules for s in r} - names)
    unknown = [s for s in used if not (s[0] == "'" or s.isupper())]
    if unknown:
        raise ValueError(f"no rule for {unknown}")
    terminals = {s.strip("'"): chr(0x100 + i) for i, s in enumerate(used)}
    bit = {s: 1 << i for i, s in enumerate(used)}
    end_bit = 1 << len(used)
    by_name: dict[str, list[int]] = {}
    for i, (n, _) in enumerate(rules):
        by_name.setdefault(n, []).append(i)
    nullable: set[str] = set()
    while True:
        more = {n for n, r in rules if n not in nullable and all(s in nullable for s in r)}
        if not more:
            break
        nullable |= more

    def closure(kernel):
        items, todo = set(kernel), list(kernel)
        while todo:
            r, d = todo.pop()
            rhs = rules[r][1]
            if d < len(rhs) and rhs[d] in by_name:
                for q in by_name[rhs[d]]:
                    if (q, 0) not in items:
                        items.add((q, 0))
                        todo.append((q, 0))
        return items

    states, index, moves = [frozenset({(0, 0)})], {frozenset({(0, 0)}): 0}, []
    closed = []
    at = 0
    while at < len(states):
        items = closure(states[at])
        closed.append(items)
        step: dict[str, set] = {}
        for r, d in items:
            rhs = rules[r][1]
            if d < len(rhs):
                step.setdefault(rhs[d], set()).add((r, d + 1))
        here = {}
        for s in sorted(step):
            kernel = frozenset(step[s])
            if kernel not in index:
                index[kernel] = len(states)
                states.append(kernel)
            here[s] = index[kernel]
        moves.append(here)
        at += 1

    follow = {}
    reads: dict[tuple, list] = {}
    for p, here in enumerate(moves):
        for a, r in here.items():
            if a in names:
                follow[p, a] = sum(bit[t] for t in moves[r] if t in bit) | (end_bit if p == 0 and a == start else 0)
                reads[p, a] = [(r, c) for c in moves[r] if c in nullable]
    _spread(follow, reads)
    includes: dict[tuple, list] = {x: [] for x in follow}
    lookback: dict[tuple[int, int], list] = {}
    for p, a in follow:
        for r in by_name[a]:
            rhs, q = rules[r][1], p
            for i, s in enumerate(rhs):
                if s in names and all(x in nullable for x in rhs[i + 1 :]):
                    includes[q, s].append((p, a))
                q = moves[q][s]
            lookback.setdefault((q, r), []).append((p, a))
    _spread(follow, includes)

    numbers = {n: i for i, n in enumerate(by_name)}
    chars = {bit[s]: terminals[s.strip("'")] for s in used} | {end_bit: END}
    action, others, conflicts = [], [], 0
    for q, here in enumerate(moves):
        found: dict[str, list[int]] = {}
        for s, to in here.items():
            if s in bit:
                found.setdefault(chars[bit[s]], []).append(to + 1)
        for r, d in sorted(closed[q]):
            if d < len(rules[r][1]):
                continue
            if r == 0:
                found.setdefault(END, []).append(0)
                continue
            ahead = 0
            for x in lookback.get((q, r), ()):
                ahead |= follow[x]
            while ahead:
                low = ahead & -ahead
                ahead ^= low
                found.setdefault(chars[low], []).append(-r - 1)
        action.append({c: a[0] for c, a in found.items()})
        others.append({c: tuple(a[1:]) for c, a in found.items() if len(a) > 1})
        conflicts += len(others[-1])
    goto = [{numbers[s]: to for s, to in here.items() if s in names} for here in moves]
    return Tables(terminals, action, goto, [(numbers[n], len(r)) for n, r in rules], others, conflicts)


def _spread(sets: dict, edges: dict[tuple, list]) -> None:
    """Grow every set by those it has edges to, until nothing changes."""
    back: dict[tuple, list] = {}
    for x, ys in edges.items():
        for y in ys:
            back.setdefault(y, []).append(x)
    todo = list(sets)
    while todo:
        y = todo.pop()
        for x in back.get(y, ()):
            if sets[y] & ~sets[x]:
                sets[x] |= sets[y]
                todo.append(x)


class _TooMany(Exception):
    pass


def _stacks_after(t: Tables, lines: list[str], semi: str, closers: str) -> tuple[int, list[tuple[int, ...]]]:
    """The number of the line at which no stack is left, or -1 and the stacks."""
    stacks: list[tuple[int, ...]] = [(0,)]
    memo = t.memo
    for number, line in enumerate(lines):
        known = memo.get(line)
        if known is None:
            if len(memo) > 100_000:
                memo.clear()
            known = memo[line] = {}
        out: dict[tuple[int, ...], None] = {}
        for stack in stacks:
            for depth, seen in known.items():
                ends = seen.get(stack[-depth:])
                if ends is not None:
                    break
            else:
                depth, ends = _run_line(t, stack, line, semi, closers)
                known.setdefault(depth, {})[stack[-depth:]] = ends
            base = stack[:-depth]
            for end in ends:
                out[base + end] = None
        if not out:
            return number, []
        stacks = list(out)
        if len(stacks) > LIMIT:
            raise _TooMany
    return -1, stacks


def first_error(t: Tables, lines: list[str], semi: str = "", closers: str = "") -> int:
    """The number of the line (from 0) at which the token stream stops being a prefix of the language, or -1.

    ``lines`` are terminals line by line. ``semi`` is a terminal that is put in where a token
    does not fit and begins a line, is one of ``closers`` or the end.
    """
    try:
        number, stacks = _stacks_after(t, lines, semi, closers)
        if number >= 0:
            return number
        if any(_run_line(t, stack, END, semi, closers + END)[1] for stack in stacks):
            return -1
        return max(0, len(lines) - 1)
    except _TooMany:
        return _general(t, lines, semi, closers)


def starts_badly(t: Tables, lines: list[str], semi: str = "", closers: str = "") -> bool:
    """Whether no text of the language begins with these lines."""
    try:
        return _stacks_after(t, lines, semi, closers)[0] >= 0
    except _TooMany:
        return False


def _run_line(t: Tables, stack: tuple[int, ...], line: str, semi: str, closers: str) -> tuple[int, list[tuple[int, ...]]]:
    """How many states of the stack the line looks at, and what those become, for each way to read it."""
    low = [len(stack)]
    ways = [(len(stack), ())]
    fresh = True
    for c in line:
        nxt: dict[tuple, None] = {}
        for way in ways:
            got = _fits(t, stack, way, c, low)
            if not got and semi and (fresh or c in closers):
                got = {y: None for x in _fits(t, stack, way, semi, low) for y in _fits(t, stack, x, c, low)}
            nxt.update(got)
        ways = list(nxt)
        if len(ways) > LIMIT:
            raise _TooMany
        if not ways:
            break
        fresh = False
    keep = min(low[0], *(k for k, _ in ways)) if ways else low[0]
    depth = len(stack) - keep + 1
    return depth, [stack[keep - 1 : k] + pushed for k, pushed in ways]


def _fits(t: Tables, stack: tuple[int, ...], way: tuple, c: str, low: list[int]) -> dict[tuple, None]:
    """The ways on after all reductions before ``c`` and its shift; ``way`` is the states kept of ``stack`` and those pushed since."""
    action, goto, rules, others = t.action, t.goto, t.rules, t.others
    out: dict[tuple, None] = {}
    todo, seen = [way], {way}
    while todo:
        kept, pushed = todo.pop()
        state = pushed[-1] if pushed else stack[kept - 1]
        act = action[state].get(c)
        if act is None:
            continue
        more = others[state].get(c)
        for a in (act, *more) if more else (act,):
            if a > 0:
                out[kept, (*pushed, a - 1)] = None
                continue
            if a == 0:
                out[kept, pushed] = None
                continue
            head, size = rules[-a - 1]
            if size <= len(pushed):
                k, rest = kept, pushed[: len(pushed) - size]
            else:
                k, rest = kept - (size - len(pushed)), ()
                if k < low[0]:
                    low[0] = k
            to = goto[rest[-1] if rest else stack[k - 1]].get(head)
            if to is not None and (new := (k, (*rest, to))) not in seen:
                seen.add(new)
                if len(seen) > 4 * LIMIT:
                    raise _TooMany
                todo.append(new)
    return out


def _general(t: Tables, lines: list[str], semi: str, closers: str) -> int:
    """:func:`first_error` over all derivations, by a graph-structured stack."""
    top = {0: [0, []]}
    for number, line in enumerate([*lines, END]):
        fresh = True
        for c in line:
            nxt = _shift_all(t, top, c)
            if nxt is None and semi and (fresh or c in closers or c == END):
                put = _shift_all(t, top, semi)
                nxt = _shift_all(t, put, c) if put else None
            if nxt is None:
                return min(number, max(0, len(lines) - 1))
            if nxt is True:
                return -1
            top, fresh = nxt, False
    return -1


def _shift_all(t: Tables, top: dict[int, list], c: str):
    """The tops after all reductions before and the shift of ``c``; True when it accepts; None when nothing fits.

    A node is ``[state, previous nodes]``; ``top`` has them by state.
    """
    now = {s: [s, list(n[1])] for s, n in top.items()}
    todo = list(now.values())
    shifts: list[tuple[int, list]] = []
    accepted = False
    while todo:
        node = todo.pop()
        state = node[0]
        a = t.action[state].get(c)
        if a is None:
            continue
        for act in (a, *t.others[state].get(c, ())):
            if act > 0:
                if not any(s == act - 1 and n is node for s, n in shifts):
                    shifts.append((act - 1, node))
            elif act == 0:
                accepted = True
            else:
                head, size = t.rules[-act - 1]
                ends = [node]
                for _ in range(size):
                    ends = list({id(p): p for n in ends for p in n[1]}.values())
                for base in ends:
                    to = t.goto[base[0]].get(head)
                    if to is None:
                        continue
                    known = now.get(to)
                    if known is None:
                        now[to] = known = [to, [base]]
                        todo.append(known)
                    elif not any(p is base for p in known[1]):
                        known[1].append(base)
                        todo.extend(now.values())
    if accepted:
        return True
    if not shifts:
        return None
    out: dict[int, list] = {}
    for state, node in shifts:
        out.setdefault(state, [state, []])[1].append(node)
    return out
