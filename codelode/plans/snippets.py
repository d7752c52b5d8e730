"""Short texts with the issues they have, by hand: every rule fires in one and stays silent in another.

``(path, text, [(line, rule), ...])``, all issues of a text in the list.
"""

SNIPPETS: list[tuple[str, str, list[tuple[int, str]]]] = [
    ("s/camel.ts", "const my_name = f();\nconst MY_NAME = f();\nconst good = f();\nconst _ok = f();\n", [(1, "camelcase")]),
    ("s/imports.ts", "import { Shape, draw } from './shapes';\nimport type { Size } from './sizes';\nexport function paint(s: Shape, z: Size): void {\n  draw(s, z);\n}\n", [(1, "consistent-type-imports"), (3, "no-void")]),
    ("s/switch.ts", "switch (kind) {\n  case 1:\n    go();\n    break;\n}\nswitch (kind) {\n  case 1:\n    go();\n    break;\n  default:\n    stop();\n}\n", [(1, "default-case")]),
    ("s/fall.js", "switch (kind) {\n  case 1:\n    go();\n  case 2:\n    stop();\n    break;\n  case 0:\n  default:\n    rest();\n}\n", [(2, "no-fallthrough")]),
    ("s/array.js", "const a = new Array(n);\nconst b = Array.from(n);\n", [(1, "no-array-constructor")]),
    ("s/executor.ts", "const p = new Promise(async (done) => { await done(); });\nconst q = new Promise((done) => done());\n", [(1, "no-async-promise-executor"), (1, "no-implicit-any"), (2, "no-implicit-any")]),
    ("s/loop.js", "async function run(list) {\n  for (const x of list) {\n    await step(x);\n  }\n  await Promise.all(list);\n}\n", [(3, "no-await-in-loop")]),
    ("s/loop2.js", "for (const x of list) {\n  use(Promise.all(x));\n}\nuse(Promise.all(list));\n", [(2, "no-promise-all-in-loop")]),
    ("s/bits.ts", "const a = b & c;\nconst d = b && c;\nlet t: A | B = d;\nt = ~d;\n", [(1, "no-bitwise"), (4, "no-bitwise")]),
    ("s/buffer.js", "const a = new Buffer(n);\nconst b = Buffer.from(n);\n", [(1, "no-buffer-constructor"), (1, "no-new-buffer")]),
    ("s/zero.js", "if (x === -0) stop();\nif (x === 0) stop();\n", [(1, "no-compare-neg-zero")]),
    ("s/console.ts", "console.log(a);\nlogger.log(a);\n", [(1, "no-console")]),
    ("s/console.spec.ts", "console.log(a);\n", []),
    ("s/constant.ts", "while (true) {\n  step();\n}\nif (ready) step();\n", [(1, "no-constant-condition")]),
    ("s/control.js", "const a = /\\x1f/;\nconst b = /\\x20/;\n", [(1, "no-control-regex")]),
    ("s/delete.js", "delete obj.a;\nremove(obj.a);\n", [(1, "no-delete-var")]),
    ("s/keys.ts", "const o = { a: x, b: y, a: z };\nconst p = { a: x, b: { a: y } };\n", [(1, "no-dupe-keys")]),
    ("s/twice.ts", "import { a } from './m';\nimport { b } from './m';\nimport { c } from './n';\nuse(a, b, c);\n", [(2, "no-duplicate-imports")]),
    ("s/else.js", "function f(a) {\n  if (a) {\n    return one(a);\n  } else {\n    two(a);\n  }\n  return a;\n}\n", [(4, "no-else-return")]),
    ("s/else2.js", "function f(a) {\n  if (a) {\n    one(a);\n  } else {\n    two(a);\n  }\n  return a;\n}\n", []),
    ("s/empty.js", "function f() {}\nconst g = () => {};\nfunction h() { go(); }\n", [(1, "no-empty-function"), (2, "no-empty-function")]),
    ("s/face.ts", "interface A {}\ninterface B { x: string }\ninterface C extends B {}\n", [(1, "no-empty-interface")]),
    ("s/pattern.js", "const {} = value;\nconst { a } = value;\nuse(a);\n", [(1, "no-empty-pattern")]),
    ("s/equal.ts", "if (a == b) go();\nif (a === b) go();\nif (a != b) go();\n", [(1, "no-eqeqeq"), (3, "no-eqeqeq")]),
    ("s/eval.js", "eval(code);\nobj.eval(code);\nconst s = 'eval(code)';\n", [(1, "no-eval")]),
    ("s/any.ts", "let a: any = b;\na = c;\nlet d: string = e;\nd = f;\n", [(1, "no-explicit-any")]),
    ("s/bind.js", "const f = go.bind(this);\nconst g = function () { return this.x; }.bind(this);\n", [(1, "no-extra-bind")]),
    ("s/cast.js", "if (!!ready) go();\nif (Boolean(a > b)) go();\nif (Boolean(a)) go();\n", [(1, "no-extra-boolean-cast"), (2, "no-extra-boolean-cast")]),
    ("s/link.tsx", "const a = <div dangerouslySetInnerHTML={x} />;\nconst b = <div title={x} />;\n", [(1, "no-html-link")]),
    ("s/implicit.ts", "function f(a, b: string) { use(a, b); }\nfunction g(a: number) { use(a); }\n", [(1, "no-implicit-any")]),
    ("s/timer.js", "setTimeout('go()', n);\nsetTimeout(go, n);\n", [(1, "no-implied-eval")]),
    ("s/assign.ts", "import { a, b } from './m';\na = f();\nlet c = b;\nc = a;\n", [(2, "no-import-assign")]),
    ("s/lonely.js", "if (a) {\n  one();\n} else if (b) {\n  two();\n}\nif (a) {\n  one();\n} else {\n  two();\n}\n", [(3, "no-lonely-if")]),
    ("s/magic.ts", "wait(42);\nconst limit = 42;\nwait(100);\nwait(4.5);\nenum E { A = 7 }\nwait(0x1f);\n", [(1, "no-magic-numbers")]),
    ("s/new.ts", "interface Shape { x: string }\nclass Real { x = make(); }\nuse(new Shape(), new Real());\n", [(3, "no-misused-new")]),
    ("s/negated.js", "if (!a) {\n  one();\n} else {\n  two();\n}\nif (!a) {\n  one();\n}\n", [(1, "no-negated-condition")]),
    ("s/ternary.js", "const a = b ? (c ? d : e) : f;\nconst g = b ? c : d;\n", [(1, "no-nested-ternary")]),
    ("s/func.js", "const f = new Function(code);\nconst g = Function.prototype;\n", [(1, "no-new-func")]),
    ("s/require.js", "const a = new require('a');\nconst b = require('b');\n", [(1, "no-new-require")]),
    ("s/symbol.js", "const a = new Symbol();\nconst b = Symbol();\n", [(1, "no-new-symbol")]),
    ("s/bang.ts", "use(a!.b);\nuse(!a);\nif (a !== b) use(a);\n", [(1, "no-non-null-assertion")]),
    ("s/calls.js", "const a = Math();\nconst b = Math.max(c);\n", [(1, "no-obj-calls")]),
    ("s/octal.js", "const a = 017;\nconst b = 0o17;\nconst c = 0;\n", [(1, "no-octal")]),
    ("s/params.js", "function f(a, b) {\n  a = b;\n  let c = a;\n  c = b;\n  return c;\n}\n", [(2, "no-param-reassign")]),
    ("s/path.js", "const a = __dirname + x;\nconst b = join(__dirname, x);\n", [(1, "no-path-concat")]),
    ("s/proto.js", "use(a.__proto__);\nuse(Object.getPrototypeOf(a));\n", [(1, "no-proto")]),
    ("s/builtin.js", "use(a.hasOwnProperty(k));\nuse(has(a, k));\n", [(1, "no-prototype-builtins")]),
    ("s/again.js", "var a = f();\nvar a = g();\nfunction h() { let b = f(); { let b = g(); use(b); } b = a; }\n", [(1, "no-var"), (2, "no-redeclare"), (2, "no-var")]),
    ("s/await.js", "async function f(a) {\n  return await g(a);\n}\nasync function h(a) {\n  const b = await g(a);\n  return b;\n}\n", [(2, "no-return-await")]),
    ("s/script.js", "go('javascript:void(n)');\ngo('https://a.example');\n", [(1, "no-script-url")]),
    ("s/self.js", "if (a.b === a.b) go();\nif (a.b === a.c) go();\n", [(1, "no-self-compare")]),
    ("s/sparse.js", "const a = [x, , y];\nconst b = [x, y];\n", [(1, "no-sparse-arrays")]),
    ("s/throw.js", "function f() { throw 'x'; }\nfunction g() { throw new Error('x'); }\n", [(1, "no-throw-literal")]),
    ("s/dangle.js", "const a_ = f();\nconst _a = f();\n", [(1, "camelcase"), (1, "no-underscore-dangle")]),
    ("s/unneeded.js", "const a = b ? true : false;\nconst c = b ? d : false;\n", [(1, "no-unneeded-ternary")]),
    ("s/dead.js", "function f(a) {\n  return a;\n  go(a);\n}\nfunction g(a) {\n  if (a) return a;\n  go(a);\n}\n", [(3, "no-unreachable")]),
    ("s/finally.js", "function f() {\n  try {\n    go();\n  } finally {\n    return one();\n  }\n}\nfunction g() {\n  try {\n    go();\n  } finally {\n    done();\n  }\n}\n", [(5, "no-unsafe-finally")]),
    ("s/negation.js", "if (!key in obj) go();\nif (!(key in obj)) go();\n", [(1, "no-unsafe-negation")]),
    ("s/unused.js", "function f(a, b, _c) {\n  const d = one();\n  const e = two();\n  return a + e;\n}\n", [(1, "no-unused-vars"), (2, "no-unused-vars")]),
    ("s/concat.js", "const a = 'x' + 'y';\nconst b = x + y;\n", [(1, "no-useless-concat"), (1, "prefer-template")]),
    ("s/rename.ts", "import { a as a, b as c } from './m';\nuse(a, c);\n", [(1, "no-useless-rename")]),
    ("s/return.js", "function f() {\n  go();\n  return;\n}\nfunction g(a) {\n  if (a) go();\n}\n", [(3, "no-useless-return")]),
    ("s/var.js", "var a = f();\nlet b = f();\nb = a;\n", [(1, "no-var")]),
    ("s/void.js", "const a = void f();\nconst b = f();\n", [(1, "no-void")]),
    ("s/todo.ts", "// TODO later\nconst a = f(); // TODO(me) later\n/* FIXME */\nconst b = 'TODO';\n", [(1, "no-warning-comments"), (3, "no-warning-comments")]),
    ("s/with.js", "with (obj) { go(); }\nobj.with(x);\n", [(1, "no-with")]),
    ("s/callback.js", "list.map(function (x) { return x; });\nlist.map((x) => x);\n", [(1, "prefer-arrow-callback")]),
    ("s/let.js", "let a = f();\nlet b = f();\nb = a;\nlet c = f();\nc++;\n", [(1, "prefer-const")]),
    ("s/nullish.ts", "const a = b || c;\nconst d = b ?? c;\nconst e = (x > y) || z;\n", [(1, "prefer-nullish-coalescing")]),
    ("s/chain.ts", "use(a && a.b);\nuse(a && b.c);\n", [(1, "prefer-optional-chain")]),
    ("s/reject.js", "Promise.reject('x');\nPromise.reject(new Error('x'));\n", [(1, "prefer-promise-reject-errors")]),
    ("s/spread.js", "const a = [].concat(b, c);\nconst d = b.concat(c);\n", [(1, "prefer-spread")]),
    ("s/template.js", "const a = 'x ' + b;\nconst c = `x ${b}`;\nconst d = b + c;\n", [(1, "prefer-template")]),
    ("s/quote.js", "const o = { a-b: c };\nconst p = { 'a-b': c };\n", [(1, "quote-props")]),
    ("s/require-await.js", "async function f(a) {\n  return a;\n}\nasync function g(a) {\n  await a;\n}\n", [(1, "require-await")]),
    ("s/sink.ts", "function f(req: Request) {\n  const name = req.query.name;\n  const part = `where ${name}`;\n  db.query(part);\n}\nfunction g(req: Request) {\n  const name = escape(req.query.name);\n  db.query(name);\n}\n", [(4, "security/sql-injection")]),
    ("s/sink2.js", "function f(req, res) {\n  const q = req.body;\n  exec(q.cmd);\n  fs.readFile(q.file);\n  fetch(q.url);\n  document.body.innerHTML = q.text;\n  res.redirect(q.to);\n  Object.assign(x, q);\n  logger.info(q);\n}\n",
     [(3, "security/command-injection"), (4, "security/path-traversal"), (5, "security/ssrf"), (6, "security/xss"), (7, "security/open-redirect"), (8, "security/prototype-pollution"), (9, "security/log-injection")]),
    ("s/sink.dart", "void f(request) {\n  final u = request.url;\n  http.get(u);\n  final p = request.path;\n  File(p).readAsString(p);\n  database.query(p);\n}\n",
     [(3, "security/flutter-http-injection"), (5, "security/flutter-path-traversal"), (6, "security/flutter-sql-injection")]),
    ("s/a.dart", "import 'dart:html';\nvoid f() {\n  print('x');\n  go().then((x) => x);\n  try {\n    go();\n  } catch (e) {}\n}\n",
     [(1, "dart/avoid-web-libraries-in-flutter"), (3, "dart/avoid-print"), (4, "dart/prefer-async-await"), (7, "dart/avoid-empty-catch")]),
    ("s/b.dart", "final a = Container(width: x, height: y);\n\n\n\n\nfinal b = Container(width: x,\n  child: y,\n);\nfinal c = EdgeInsets.all(x);\nfinal d = const TextStyle(size: x);\n// Color(x)\n", [(1, "dart/avoid-unnecessary-containers"), (9, "dart/prefer-const-constructors")]),
    ("s/a.py", "from m import *\nx = f()\nLIMIT=f()\ndef go(a=[]):\n    print(a)\n    try:\n        pass\n    except:\n        pass\n# todo later\ndef _own(a) -> int:\n    return a\n",
     [(1, "python/avoid-star-import"), (2, "python/avoid-global-var"), (4, "python/avoid-mutable-default"), (4, "python/docstring-required"), (4, "python/explicit-return-type"), (5, "python/avoid-print"), (8, "python/avoid-bare-except"), (10, "python/avoid-todo")]),
    ("s/m_test.py", "def go(a):\n    print(a)\n", []),
    ("s/doc.py", 'def go(a) -> int:\n    """Goes."""\n    return a\nclass A:\n\n    x: int\n', [(4, "python/docstring-required")]),
    ("s/a.rs", "pub fn go(x: T) {\n    println!(\"x\");\n    x.unwrap();\n    x.expect(\"y\");\n    todo!();\n    unimplemented!();\n}\npub fn get(x: T) -> T {\n    x\n}\n// x.unwrap()\n",
     [(1, "rust/explicit-return-type"), (2, "rust/avoid-println"), (3, "rust/avoid-unwrap"), (4, "rust/avoid-expect"), (5, "rust/avoid-todo"), (6, "rust/avoid-unimplemented")]),
    ("s/tests/a.rs", "fn go() {\n    x.unwrap();\n}\n", []),
    ("s/a.go", "package a\n\nvar total = 3\n\n// Go goes.\nfunc Go() {\n\tfmt.Println(x)\n\tv, err := f()\n\tuse(v)\n\tw, err := g()\n\tif err != nil {\n\t\treturn\n\t}\n\tuse(w)\n\tfor {}\n}\n\nfunc Bare() int {\n\treturn 0\n}\n\nfunc init() {\n}\n",
     [(3, "go/avoid-global-var"), (7, "go/avoid-print"), (15, "go/avoid-empty-block"), (18, "go/exported-comment"), (22, "go/avoid-init")]),
    ("s/b.go", "package a\n\nfunc f() {\n\tv, err := g()\n\tuse(v)\n\tuse(v)\n\tuse(v)\n}\n", [(4, "go/error-check")]),
    ("s/c.yaml", "a: 42\n", []),
]
