"""What grammars leave to rules beside them: valid and invalid texts."""

import random

import pytest

from codelode.llm import syntax

INVALID = {"python": ["f(a=1, 2)\n","def f(a=1, b):\n    pass\n","x = 08\n","f() += 1\n","return 1\n","if x:\n        a\n\tb\n","f() = 1\n","a + b = c\n","1 = x\n","None = 3\n","break\n","class A:\n    return 1\n","f(**k, *a)\n","x = y + 1 = z\n"],
"javascript": ["const a;\n","let a; let a;\n","return 5;\n","a++ = 1;\n","if (x) { return 1 }\n"],"typescript": ["a++ = 1\n","const a\n= 1\nconst a = 2\n"]}
ACCEPTED = {"python": ["f(1, a=1, *b, **c)\n","def f(a, b=1, *, c, d=2): return 1\n","x = 0\ny = 00\nz = 0.08\n","a[1] += 1\n(a, b) = c\n[a, *b] = c\nx: int = 3\na.b.c = d = e\n","for x in y:\n    if z: break\nwhile 1:\n\tcontinue\n","def f():\n\treturn 1\n","class A:\n    def g(self): return 1\n","x = lambda a=1: a\n","a = b if c else d\n","f(x for x in y)\n","print(a, sep='')\n","with a as (b, c): pass\n","@d(a=1)\ndef f(): pass\n","f(a)(b=1)\n","x = f(a == 1, b=2)\n","match = 1\nmatch x:\n    case 1: y = 2\n","async def f():\n    async for x in y:\n        continue\n","def f(a: dict = {'x': 1}, b=2): pass\n"],
"javascript": ["const a = 1; { const a = 2; }\nfor (const a of b) {} for (const a of b) {}\n","function f() { return 1 }\nconst g = () => { return 1 }\nclass A { m() { return 1 } get x() { return 2 } static { let a; } }\nconst o = { a() { return 1 }, b: function () { return 2 }, [c]() { return 3 } };\n","module.exports = {\n  data() { return {} },\n};\nexport default { f() { return 1 } }\n","switch (a) { case 1: { let x = 1; break } case 2: { let x = 2 } }\n","for (let i = 0, j; i < n; i++) {}\nlet x\nvar y\n","x.then(function () { return 1 }, () => { return 2 })\n","if (a) { f(() => { return 1 }) }\nlabel: { f() }\n"],
"typescript": ["declare const a: string;\nexport declare const b: number;\n","const f = (a: number): { x: string } => { return { x: '' } };\nfunction g<T>(a: T): a is T { return true }\nclass A { private m(): Promise<void> { return x } }\n","abstract class B { abstract m(): void; n(): Map<string, A> { return new Map() } }\n"]}


@pytest.mark.parametrize("language", INVALID)
def test_rules_beside_the_grammar(language):
    p = syntax.parser(language)
    assert [t for t in INVALID[language] if p.error_line(t) == 0] == []
    assert [t for t in ACCEPTED[language] if p.error_line(t) > 0] == []


def test_python_agrees_with_the_compiler_on_edited_texts():
    rng = random.Random(9)
    p = syntax.parser("python")
    parts = ACCEPTED["python"] + INVALID["python"]
    wrong = []
    for _ in range(400):
        text = rng.choice(parts) + rng.choice(parts)
        if rng.random() < 0.3:
            text = text.replace(rng.choice(["=", "1", "a", ")", ","]), rng.choice(["=", "1", "a", "+"]), 1)
        try:
            compile(text, "x", "exec", dont_inherit=True)
            valid = True
        except (SyntaxError, ValueError):
            valid = False
        if (p.error_line(text) == 0) != valid:
            wrong.append(text)
    assert len(wrong) <= 12, wrong  # rules that are not among the checks, such as names bound twice


def test_the_line_of_such_an_error():
    assert syntax.parser("javascript").error_line("let a = 1;\n/* x\n y */\nconst b = `\n`;\nlet a = 2;\n") == 6
    assert syntax.parser("python").error_line("x = \"\"\"\n\n\"\"\"\n\ndef f(a=1,\n      b):\n    pass\n") == 5
