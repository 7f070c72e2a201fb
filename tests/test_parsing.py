import pytest

from loomdex.functions.parsing import parse, parse_files

FILES = [
    ("a.ts", "import z from '../far/away';\nexport { q } from './near';\nlet p = require('path');\n"),
    ("f.vue", "<template>\n  <p/>\n</template>\n<script lang=\"ts\">\nfunction shown() {}\n</script>\n"),
    ("g.txt", "function hidden() {}"),
]


def kinds(grammar, text):
    return [(s["name"], s["kind"], s["line"]) for s in parse(grammar, text)["symbols"]]


@pytest.mark.parametrize("text,want", [
    ("// c\nexport function greet() {}", [("greet", "function", 2)]), ("export default class A extends B {}", [("A", "class", 1)]), ("abstract class A {}", []),
    ("const f = async (x) => x;\nlet g = y => y;\nconst n = 5;", [("f", "function", 1), ("g", "function", 2)]), ("const h = function inner() {}", [("h", "function", 1), ("inner", "function", 1)]),
    ("type A<T> = T;\nenum E { X }\nconst enum F { Y }", [("A", "type", 1), ("E", "enum", 2), ("F", "enum", 3)]), ("class A {\n  get x(): number { return 1 }\n  static async m<T>(a: T) {\n    if (a) { while (b) {} }\n  }\n}", [("A", "class", 1), ("x", "method", 2), ("m", "method", 3)]),
    ("'function no() {}'; /* class No {} */ // enum No {}", []), ("function ok() {}\nfunction {{{ broken", [("ok", "function", 1)]), ("", []), ("const a = (b", []),
])
def test_typescript(text, want):
    assert kinds("typescript", text) == want


def test_javascript_has_no_types():
    assert kinds("javascript", "interface A {}\nfunction b() {}") == [("b", "function", 2)]


@pytest.mark.parametrize("text,want", [
    ("import { a } from './a';\nimport './side';\nimport type { T } from \"../t\";\nexport { x } from './a';\nconst r = require(`./r`);\nfoo('./no');", ["./a", "./side", "../t", "./r"]),
    ("import {\n  a,\n  b,\n} from '@/x';\nconst s = 'from';", ["@/x"]), ("// import './no'\n", []), ("import d, * as n from 'm'", ["m"]),
])
def test_script_imports(text, want):
    assert parse("typescript", text)["specs"] == want


def test_python():
    text = "import os, sys as s\nfrom . import x\nfrom ..a.b import c\n@d\n@e(1)\nclass A:\n  @p\n  def m(self):\n    async def n(): pass\ndef f(): pass\n"
    r = parse("python", text)
    assert [(s["name"], s["kind"], s["line"]) for s in r["symbols"]] == [("A", "class", 4), ("m", "method", 7), ("n", "method", 9), ("f", "function", 10)]
    assert r["specs"] == ["os", ".", "..a.b"] and r["symbols"][0]["signature"] == "@d"
    broken = parse("python", "from .u import v\nclass A:\n    @p\n    def m(self):\n        x = (\ndef f(:\n")
    assert [(s["name"], s["kind"], s["line"]) for s in broken["symbols"]] == [("A", "class", 2), ("m", "method", 3), ("f", "function", 6)] and broken["specs"] == [".u"]


def test_go():
    text = 'package a\n\nimport f "fmt"\nimport (\n  "os"\n  _ "x/y"\n)\nvar s = "z"\ntype (\n  A struct { b int }\n  C interface { D() }\n)\ntype G[T any] struct {}\ntype H int\nfunc F[T any](x T) {}\nfunc (a *A) M() {}\n'
    assert kinds("go", text) == [("A", "struct", 9), ("C", "struct", 9), ("G", "struct", 13), ("H", "type", 14), ("F", "function", 15), ("M", "method", 16)]
    assert parse("go", text)["specs"] == ["fmt", "os", "x/y"]


def test_rust():
    text = "use std::io;\npub use crate::a::{b, c};\n#[derive(Debug)]\npub(crate) struct S<T>(T);\nimpl<T> S<T> {}\nimpl fmt::Display for P { fn fmt(&self) -> R { x } }\npub async fn go<'a>(x: &'a str) -> u8 { 1 }\ntrait T { fn sig(&self); fn body(&self) {} }\n// fn no() {}\n"
    assert kinds("rust", text) == [("S", "struct", 4), ("P", "impl", 6), ("fmt", "function", 6), ("go", "function", 7), ("T", "trait", 8), ("body", "function", 8)]
    assert parse("rust", text)["specs"] == ["std::io", "crate::a::{b, c}"]


def test_java():
    text = "import static a.b.C;\nimport x.y.*;\n/** class No {} */\n@Entity\npublic final class A<T> {\n  @Override\n  public <U> List<U> get(int x) throws E { if (x > 0) { call(x); } return new B(x); }\n  A() {}\n  abstract void f();\n}\n@interface M {}\n"
    assert kinds("java", text) == [("A", "class", 4), ("get", "method", 6), ("A", "constructor", 8), ("f", "method", 9), ("M", "annotation", 11)]
    assert parse("java", text)["specs"] == ["a.b.C", "x.y.*"]


def test_signature_is_short():
    assert len(parse("typescript", f"function {'x' * 200}() {{}}")["symbols"][0]["signature"]) == 120


def test_files(spark):
    rows = {r.path: r.parsed for r in parse_files(spark.createDataFrame([*FILES, ("n.ts", None), ("v.vue", "<p/>")], "path string, content string")).collect()}
    assert [(s.name, s.line) for s in rows["f.vue"].symbols] == [("shown", 5)] and rows["g.txt"].symbols == [] and rows["n.ts"].symbols == [] and rows["v.vue"].symbols == []
    assert rows["a.ts"].specs == ["../far/away", "./near", "path"]
