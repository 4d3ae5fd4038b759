"""One small file for each language, and what its parser finds in it."""

import pytest

from codeloom.sources import parsers as P

SAMPLES = {
    "a.rs": ("use std::io::{Read, Write};\nmod net;\npub struct Point { x: i32 }\ntrait Shape { fn area(&self) -> f64; }\nimpl Shape for Point {\n    fn area(&self) -> f64 { helper(1) }\n}\nfn helper(n: i32) -> f64 { 1.0 }\n", {("Point", "struct"), ("Shape", "trait"), ("area", "method"), ("helper", "function"), ("net", "module")}, {("imports", "Read"), ("imports", "Write"), ("implements", "Shape"), ("calls", "helper")}),
    "a.py": ("import os.path\nfrom a.b import c as d\nLIMIT = 3\nclass K(Base):\n    def run(self):\n        return helper(self.x())\ndef helper(v):\n    def inner(): pass\n    return v\n", {("K", "class"), ("run", "method"), ("helper", "function"), ("inner", "function"), ("LIMIT", "constant")}, {("imports", "path"), ("imports", "c"), ("extends", "Base"), ("calls", "helper"), ("calls", "x")}),
    "A.java": ("package p;\nimport java.util.List;\npublic class A extends B implements C, D {\n  private int n;\n  public A(int n) { this.n = n; }\n  public List<String> run(int a) throws E { return go(a); }\n}\ninterface C { void stop(); }\nenum Color { RED }\n", {("A", "class"), ("A", "method"), ("run", "method"), ("C", "interface"), ("stop", "method"), ("Color", "enum")}, {("imports", "List"), ("extends", "B"), ("implements", "C"), ("implements", "D"), ("calls", "go")}),
    "a.cs": ("using System.Text;\nnamespace N {\n  public class A : B, IC {\n    public void Run() { Go(); }\n  }\n  struct S { }\n}\n", {("N", "module"), ("A", "class"), ("Run", "method"), ("S", "struct")}, {("imports", "Text"), ("extends", "B"), ("extends", "IC"), ("calls", "Go")}),
    "a.ts": ("import { x } from './lib/util';\nconst y = require('fs');\nexport class A extends B {\n  run(a: number): void { go(a); this.stop(); }\n}\nfunction go(n) { return `t ${n}`; }\nconst arrow = (q) => { go(q); };\ninterface I { a: string }\n", {("A", "class"), ("run", "method"), ("go", "function"), ("arrow", "function"), ("I", "interface"), ("y", "constant")}, {("imports", "util"), ("imports", "fs"), ("extends", "B"), ("calls", "go"), ("calls", "stop")}),
    "a.cpp": ("#include <vector>\n#include \"net/io.h\"\nnamespace n {\nclass A : public B {\n public:\n  int run(int a) const { return go(a); }\n};\n}\nint A::stop(int b) { return 1; }\nstatic int go(int a) { return a; }\n", {("n", "module"), ("A", "class"), ("run", "method"), ("stop", "method"), ("go", "function")}, {("imports", "vector"), ("imports", "io"), ("extends", "B"), ("calls", "go")}),
    "a.go": ("package p\nimport \"net/http\"\ntype T struct { a int }\ntype I interface { Run() }\nfunc (t *T) Run() { go1(2) }\nfunc go1(n int) int { return n }\n", {("T", "struct"), ("I", "interface"), ("Run", "method"), ("go1", "function")}, {("imports", "http"), ("calls", "go1")}),
    "a.lua": ("local m = require('net.io')\nfunction M.run(a)\n  if a then go(a) end\n  for i = 1, 2 do go(i) end\nend\nlocal function go(x) return x end\n-- end\n", {("run", "method"), ("go", "function")}, {("imports", "io"), ("calls", "go")}),
    "a.kt": ("import a.b.C\nclass A(val n: Int) : B(), I {\n  fun run(): Int { return go(n) }\n}\nobject O { }\nfun go(n: Int): Int { return n }\n", {("A", "class"), ("run", "method"), ("go", "function"), ("O", "class")}, {("imports", "C"), ("extends", "B"), ("extends", "I"), ("calls", "go")}),
    "a.php": ("<?php\nuse App\\Models\\User;\nclass A extends B implements C {\n  public function run($a) { return go($a); }\n}\nfunction go($x) { return $x; } # end {\n", {("A", "class"), ("run", "method"), ("go", "function")}, {("imports", "User"), ("extends", "B"), ("implements", "C"), ("calls", "go")}),
    "a.ps1": ("Import-Module Net\nfunction Get-Thing { param($a)\n  Write-Thing($a)\n}\nclass A : B { [int] Run() { return 1 } }\n", {("Get-Thing", "function"), ("A", "class"), ("Run", "method")}, {("imports", "Net"), ("extends", "B"), ("calls", "Write-Thing")}),
    "a.sh": ("source ./lib.sh\nrun() {\n  echo hi\n}\nfunction stop {\n  run\n}\nrun\n", {("run", "function"), ("stop", "function")}, {("imports", "lib"), ("calls", "run")}),
    "a.html": ("<html><head><script src='js/app.js'></script></head><body><div id='top' class='big'><a href='b.html#x'>go there now</a></div><p onclick='run(1)'>x</p></body></html>", {("top", "element")}, {("imports", "app.js"), ("references", "b.html"), ("references", "big"), ("calls", "run")}),
    "a.css": ("@import 'base.css';\n/* .no { } */\n:root { --main: red; }\n.btn, #top > .x { color: var(--main); }\n", {("btn", "rule"), ("top", "rule"), ("x", "rule"), ("--main", "variable")}, {("imports", "base.css"), ("references", "--main")}),
    "a.xml": ("<?xml version='1.0'?>\n<root>\n <item id='k'><deep/></item><!-- <no/> -->\n</root>\n", {("root", "element"), ("k", "element")}, set()),
    "a.xaml": ("<Window x:Class='N.Main' xmlns:l='clr-namespace:N.Views;assembly=x'><Button x:Name='ok' Click='Ok_Click' Style='{StaticResource Big}'/></Window>", {("Main", "class"), ("ok", "element")}, {("imports", "Views"), ("references", "Ok_Click"), ("references", "Big")}),
    "a.md": ("# Top\ntext [a](b/c.md) and [d](x.py#l1)\n```\n# no\n```\n## Sub\n", {("Top", "element"), ("Sub", "element")}, {("imports", "c.md"), ("references", "x.py")}),
}


@pytest.mark.parametrize("path", sorted(SAMPLES))
def test_language(path):
    text, symbols, relations = SAMPLES[path]
    language, got = P.parse(path, text)
    assert language and got.issue is None
    assert {(s["name"], s["kind"]) for s in got.symbols[(path != "a.xaml") :] if s["kind"] != "module" or s["line"] > 1} >= symbols
    assert {(r["kind"], r["to_name"]) for r in got.relations} >= relations
    assert {(s["name"], s["kind"]) for s in got.symbols if s["kind"] in ("function", "method", "class", "struct", "interface", "enum", "trait")} <= symbols


def test_spans_and_parents():
    _, got = P.parse("a.ts", SAMPLES["a.ts"][0])
    at = {s["name"]: (s["parent"], s["line"], s["end_line"]) for s in got.symbols}
    assert at["run"] == ("A", 4, 4) and at["A"] == (None, 3, 5) and at["arrow"] == (None, 7, 7)
    calls = {(got.symbols[r["from_index"]]["name"], r["to_name"], r["member"]) for r in got.relations if r["kind"] == "calls"}
    assert {("run", "go", False), ("run", "stop", True), ("arrow", "go", False)} <= calls
    _, lua = P.parse("a.lua", SAMPLES["a.lua"][0])
    assert {s["name"]: s["end_line"] for s in lua.symbols[1:]} == {"run": 5, "go": 6}


@pytest.mark.parametrize("text", ["", "{", "}", "class", "function (", "((((", "\0\xff", "'", '"', "`", "<", "/*", "--[[", "fn f(", "impl", "type", "const x", "#" * 50, "{" * 400])
def test_never_fails(text):
    for path in SAMPLES:
        P.parse(path, text)
    assert P.parse("a.swift", text)[1].issue == "unsupported_language" and P.parse("a.txt", text) == (None, P.Parsed())


def test_literals_and_secrets():
    assert P.is_prose("all went well") and not P.is_prose("x") and not P.is_prose("A9f3kLq0ZpW7sXv2BnM4")
    assert P.entropy("aaaa") == 0 and P.entropy("ab") == 1
    _, got = P.parse("a.py", "x = 'all went well'\ny = 'A9f3kLq0ZpW7sXv2BnM4'\n")
    assert [x["text"] for x in got.literals] == ["all went well"]


def test_tables(spark):
    from codeloom.operators import resolve

    files = spark.createDataFrame([("src/a.py", "from b import go\ndef f():\n    go()\n"), ("src/b.py", "def go():\n    return 'all went well'\n"), ("x.swift", "y"), ("bad.py", "def ("), ("n.bin", None)], "relative_path string, text string")
    t = P.graph_tables(P.parse_files(files))
    hits = resolve.relation_hits(t.relations, t.symbols, t.files).collect()
    assert {(r.kind, r.to_name, r.resolution) for r in hits} == {("imports", "go", "resolved"), ("calls", "go", "resolved")}
    assert sorted((r.relative_path, r.issue_kind) for r in t.issues.collect()) == [("bad.py", "syntax_error"), ("x.swift", "unsupported_language")]
    assert [r.text for r in t.literals.collect()] == ["all went well"]
    full = t.files.join(files, "relative_path")
    rows = P.callable_tokens(full, t.symbols).collect()
    assert sorted((r.name, len(r.tokens)) for r in rows) == [("f", 8), ("go", 7)]
