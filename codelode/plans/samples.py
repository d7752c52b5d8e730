"""Planted reports, lock files and outputs for the readers, one ``(path, text)`` row each."""

import json

LCOV = "TN:\nSF:src\\core\\a.ts\nDA:1,1\nDA:2,5\nDA:3,0\nDA:4,1\nDA:5,0\nend_of_record\nSF:src/b.spec.ts\nDA:1,2\nDA:2,2\nend_of_record\nSF:src/open.ts\nDA:7,0\n"
COBERTURA = (
    '<?xml version="1.0"?><coverage line-rate="0.5"><packages><package name="p"><classes><class name="A" filename="src/core/a.ts"><methods><method name="m"><lines><line number="1" hits="3"/></lines></method></methods>'
    '<lines><line number="1" hits="3"/><line hits="0" number="9"/></lines></class><class name="B" filename="src/c.ts"><lines><line number="2" hits="1"/></lines></class></classes></package></packages></coverage>'
)
JACOCO = (
    '<!DOCTYPE report PUBLIC "-//X//DTD Report//EN" "report.dtd"><report name="r"><package name="x"><class name="x/A" sourcefilename="A.java"><method name="m"><counter type="LINE" missed="1" covered="1"/></method>'
    '<counter type="BRANCH" missed="9" covered="9"/><counter type="LINE" missed="2" covered="6"/></class><class name="x/B"><counter type="LINE" missed="1" covered="0"/></class></package></report>'
)
NPM = json.dumps({"dependencies": {"left": {"version": "1.2.0"}, "right": {"version": "3.0.1"}}, "packages": {"": {"version": "0.0.0"}, "node_modules/unused": {"version": "9.9.9"}}})
NPM_PACKAGES = json.dumps({"packages": {"": {"version": "0.0.0"}, "node_modules/top": {"version": "2.0.0"}, "node_modules/top/node_modules/deep": {"version": "0.1.0"}, "node_modules/own": {"version": "file:../own"}}})
CARGO = (
    'version = 3\n\n[[package]]\nname = "quartz-core"\nversion = "0.4.2"\nsource = "registry+https://registry.example/crates.io-index"\n\n[[package]]\nname = "in-tree"\nversion = "0.1.0"\n\n'
    '[[package]]\nname = "closed-by-section"\nversion = "0.2.0"\n\n[metadata]\nname = "nothing"\n\n[[package]]\nname = "from-git"\nversion = "0.3.0"\nsource = "git+https://git.example/x"\n\n[[package]]\nname = "last-one"\nversion = "0.5.0"\n'
)
GO_SUM = "mod.example/a v1.2.3 h1:x=\nmod.example/a v1.2.3/go.mod h1:y=\nmod.example/a v1.2.3 h1:x=\nmod.example/b v0.9.0+incompatible h1:z=\n\n"
PUBSPEC = 'packages:\n  collect:\n    dependency: "direct main"\n    description:\n      name: collect\n    source: hosted\n    version: "1.18.0"\n  paths:\n    version: "1.8.3"\nsdks:\n  dart: ">=3.0.0"\n'
OUTPUT = "PASS unit/a.spec.ts (5.2 s)\n  A\n    ✓ adds two numbers (3 ms)\n    ✕ fails slowly (1.5 s)\n    ○ skipped for now\nFAIL unit/b.spec.ts\n    ● breaks\n    ✓ still works\n\nTests:       2 failed, 1 skipped, 2 passed, 5 total\n"
ALERTS = json.dumps({"alerts": [
    {"alert": "Header missing", "riskcode": "1", "cweid": "693", "instances": [{"uri": "https://a.example/", "method": "GET"}, {"uri": "https://a.example/b", "method": "GET"}]},
    {"alert": "Script injection", "riskcode": "3", "cweid": "79", "instances": [{"uri": "https://a.example/q", "method": "POST"}]},
    {"alert": "Header missing", "riskcode": "1", "cweid": "693"}, {"alert": "Odd", "riskcode": "7"}, {"alert": "Note", "riskcode": "0"}, {"alert": "Redirect", "riskcode": "2", "cweid": "x"}, {"other": 1},
]})
SARIF = json.dumps({"version": "2.1.0", "runs": [{"results": [
    {"ruleId": "no-eval", "level": "error", "message": {"text": "eval"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "src/a.ts"}, "region": {"startLine": 3}}}]},
    {"ruleId": "no-var", "level": "warning", "message": {"text": "var"}, "locations": []},
]}]})
TEXTS = [
    ("unit/lcov.info", LCOV), ("it/cobertura.xml", COBERTURA), ("it/jacoco.xml", JACOCO), ("it/broken.xml", "<coverage><class"), ("notes.txt", "nothing"), ("p/package-lock.json", NPM), ("q/package-lock.json", NPM_PACKAGES),
    ("Cargo.lock", CARGO), ("go.sum", GO_SUM), ("app/pubspec.lock", PUBSPEC), ("out/jest.txt", OUTPUT), ("zap.json", ALERTS), ("report.sarif", SARIF),
]
CATEGORIES = {"unit/lcov.info": "unit", "it/cobertura.xml": "integration", "it/jacoco.xml": "integration"}
PATHS = ["src/core/a.ts", "src\\core\\b.ts", "lib/x/gen/c.ts", "src/core/a_test.ts", "tests/d.ts", "main.go", "srcX/e.ts"]
NAMES = ["TS", "golang", "C++", "c#", "Shell", "md", "rust", "cobol", ""]
OLD, NEW = "a\nb\nc\nd\ne\nf\ng\nh\n", "a\nb\nc\nd\nE\nf\ng\nh\n"
