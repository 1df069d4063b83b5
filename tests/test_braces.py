import random
import time

from lodestar.sources.braces import pair, parse_braces, tokens

TS = """import { helperB } from './b'
import fs from "fs"; // import x from './no'
export function parseConfig(s: string): Config {
  const inner = (a: number) => { return helperB(a) }
  if (s) { return helperB(s + "call(") }
  return new Config(s)
}
export class ConfigLoader extends Base implements A, B {
  constructor(readonly x: string) { super(x) }
  async load<T>(p: string): Promise<T> {
    return parseConfig(this.read(p))
  }
}
interface Opt { a: string; run(x: number): void }
const arrow = async (x) => fs.readFile(x)
"""
GO = """package m
import (
\t"fmt"
)
type Sink struct { n int }
func (s *Sink) Emit(name string) error {
\tgo func() { helper() }()
\treturn fmt.Errorf(name)
}
func helper() { s := Sink{}; s.Emit("x") }
"""


def found(path, text, row, *cols):
    return [tuple(r.get(c) for c in cols) for r in parse_braces(path, text) if r["row"] == row]


def test_typescript():
    assert found("a.ts", TS, "symbol", "kind", "qualified_name", "line", "end_line", "closure") == [
        ("function", "parseConfig", 3, 7, False), ("function", "parseConfig.inner", 4, 4, True), ("class", "ConfigLoader", 8, 13, False),
        ("method", "ConfigLoader.constructor", 9, 9, False), ("method", "ConfigLoader.load", 10, 12, False), ("interface", "Opt", 14, 14, False), ("function", "arrow", 15, 15, False),
    ]
    assert found("a.ts", TS, "import", "name", "kind", "line") == [("./b", "relative", 1), ("fs", "package", 2)]
    assert found("a.ts", TS, "call", "name", "qualified_name") == [("helperB", "parseConfig.inner"), ("helperB", "parseConfig"), ("Config", "parseConfig"), ("parseConfig", "ConfigLoader.load"), ("this.read", "ConfigLoader.load"), ("fs.readFile", "arrow")]
    assert found("a.ts", TS, "type_ref", "name") == [("Config",), ("Base",), ("A",), ("B",), ("Promise",)]


def test_go():
    assert found("a.go", GO, "symbol", "kind", "qualified_name", "line", "end_line") == [("struct", "Sink", 5, 5), ("method", "Sink.Emit", 6, 9), ("function", "helper", 10, 10)]
    assert found("a.go", GO, "import", "name") == [("fmt",)]
    assert found("a.go", GO, "call", "name", "qualified_name") == [("helper", "Sink.Emit"), ("fmt.Errorf", "Sink.Emit"), ("s.Emit", "helper")]


def test_java_and_rust():
    java = "import java.util.List;\npublic class A extends B {\n public A(int n) { this.n = n; }\n @Override public List<String> names(int k) throws E { return make(k); }\n static class In { void go() { run(); } }\n}\n"
    assert found("A.java", java, "symbol", "kind", "qualified_name") == [("class", "A"), ("method", "A.A"), ("method", "A.names"), ("class", "A.In"), ("method", "A.In.go")]
    assert found("A.java", java, "import", "name") == [("java.util.List",)]
    rust = "use crate::x::y;\nstruct S { a: u8 }\nimpl S { pub fn new(a: u8) -> S { helper(a); S { a } } }\nfn helper(a: u8) -> u8 { a }\n"
    assert found("a.rs", rust, "symbol", "kind", "qualified_name") == [("struct", "S"), ("method", "S.new"), ("function", "helper")]
    assert found("a.rs", rust, "call", "name", "qualified_name") == [("helper", "S.new")]


def texts(language, code):
    return [t for k, t, _ in tokens(code, language) if k == "text"]


def test_tokens_keep_places_and_modes():
    code = "a // x {\n'}' /* { \n */ `\n{${b(`in ${c}}`)}` \"}\" d"
    found = tokens(code, "js")
    assert all(code.startswith(t, at) for k, t, at in found if t not in "()") and [t for k, t, _ in found if k == "name"] == ["a", "b", "c", "d"]
    assert len(pair(found)) == 3 and texts("js", "`a${1}b${2}c`") == ["a${", "b${", "c`"]
    assert texts("js", "a / b / c; x = /['\"{]/g; if (y) /}/.test(z); (n) / 2; f[0] / 3; return /r/") == ["/['\"{]/g", "/}/", "/r/"]
    assert texts("rs", "fn f<'a>(x: &'a str) { 'x'; '\\''; r#\"}\"{\"#; b'{' } /* a /* } */ b */ \"q\"") == ["'x'", "'\\''", "r#\"}\"{\"#", "b'{'", '"q"']
    assert texts("go", "x := `{\n` + \"}\"") == ["`{\n`", '"}"'] and texts("java", "s = \"\"\"\n } \"x\" {\n\"\"\";") == ['"""\n } "x" {\n"""']
    assert len(pair(tokens("f(a[1], {b: (c)})", "js"))) == 4


def test_regular_expressions_templates_and_objects():
    code = r"""
function a(s) { const re = /['"{]/g; if (s) /}/.test(s); return first(s) / second(s) / 2 }
function b() { return `x ${call1(`in ${call2({a: 1})} }`)} y {` }
const api = { run() { go1() }, get v() { return go2() }, arrow: () => go3() }
switch (q) { case 1: { one() } default: { two() } }
"""
    assert found("a.ts", code, "symbol", "kind", "qualified_name", "line", "end_line") == [("function", "a", 2, 2), ("function", "b", 3, 3), ("method", "api.run", 4, 4), ("method", "api.v", 4, 4)]
    assert found("a.ts", code, "call", "name", "qualified_name") == [
        ("().test", "a"), ("first", "a"), ("second", "a"), ("call1", "b"), ("call2", "b"), ("go1", "api.run"), ("go2", "api.v"), ("go3", ""), ("one", ""), ("two", ""),
    ]


def test_class_fields_defaults_and_chains():
    code = """
class K { field = (x) => { this.s.go(x) }; #p = async y => deep.er.call(y)
  static { init() } handler: Fn = function () { h1() }
  m<T>(a: { b: string }): { c: number } { return this.a?.b.c(a) }
  abstract sig(x: number): void;
}
export default class extends Base { run() { z() } }
export default (x) => thing(x)
a().b()
"""
    assert found("a.ts", code, "symbol", "kind", "qualified_name") == [
        ("class", "K"), ("method", "K.field"), ("method", "K.#p"), ("method", "K.handler"), ("method", "K.m"), ("class", "default"), ("method", "default.run"), ("function", "default"),
    ]
    assert found("a.ts", code, "call", "name", "qualified_name") == [
        ("this.s.go", "K.field"), ("deep.er.call", "K.#p"), ("init", "K"), ("h1", "K.handler"), ("this.a.b.c", "K.m"), ("z", "default.run"), ("thing", "default"), ("a", ""), ("().b", ""),
    ]
    assert found("a.ts", "export * from './x'; import('./lazy'); import type { T } from \"./t\"; const x = require('y'); // import z from 'no'\nconst s = \"import q from 'no'\"", "import", "name") == [("./x",), ("./lazy",), ("./t",), ("y",)]


def test_rust_lifetimes_raw_strings_and_paths():
    code = """use std::{fmt::{self, Display}, io}; use crate::a as b;
/* outer /* inner { */ still */
impl<'a, T: Clone> Display for Foo<'a, T> where T: Copy { fn bar(&self) -> Vec<u8> { baz::qux(); let c = '{'; let s = r#"}"{"#; self.x.go::<u8>(1); vec![mk()] } }
trait Q { fn sig(&self); fn dflt(&self) { helper() } }
fn free<'b>(x: &'b str) -> &'b str { Foo::new(x) }
struct Unit; struct Tup(u8, String); enum E { A(u8), B { x: u8 } }
"""
    assert found("c.rs", code, "symbol", "kind", "qualified_name") == [
        ("method", "Foo.bar"), ("trait", "Q"), ("method", "Q.sig"), ("method", "Q.dflt"), ("function", "free"), ("struct", "Unit"), ("struct", "Tup"), ("type", "E"),
    ]
    assert found("c.rs", code, "call", "name", "qualified_name") == [("baz.qux", "Foo.bar"), ("self.x.go", "Foo.bar"), ("vec", "Foo.bar"), ("mk", "Foo.bar"), ("helper", "Q.dflt"), ("Foo.new", "free")]
    assert found("c.rs", code, "import", "name", "kind") == [("std::fmt::self", "package"), ("std::fmt::Display", "package"), ("std::io", "package"), ("crate::a", "relative")]


def test_go_generics_receivers_and_groups():
    code = """package m
import f "fmt"
type ( A struct { x int }; B interface { Run(x int) error } ; C = int )
type St[T any] struct { mu sync.Mutex }
func (s *St[T]) Push(v T) (int, error) { s.mu.Lock(); h[T](v); return len(s.items), nil }
func Map[K comparable, V any](m map[K]V) func(int) error { return func(i int) error { return inner(i) } }
var raw = `{ func no() { x() }`
"""
    assert found("d.go", code, "symbol", "kind", "qualified_name", "line", "end_line") == [
        ("struct", "A", 3, 3), ("interface", "B", 3, 3), ("type", "C", 3, 3), ("struct", "St", 4, 4), ("method", "St.Push", 5, 5), ("function", "Map", 6, 6),
    ]
    assert found("d.go", code, "call", "name", "qualified_name") == [("s.mu.Lock", "St.Push"), ("h", "St.Push"), ("len", "St.Push"), ("inner", "Map")]


def test_java_constructors_anonymous_classes_and_text_blocks():
    code = """package p; import static a.b.C.*;
@Ann(x) public class A<T extends B> extends Base<T> implements I, J<K> {
  private final List<String> xs = new ArrayList<>(mk());
  A() { this(1); super.init(); }
  abstract void sig(int x);
  public <R> R gen(Class<R> c) throws E { return new Thread(() -> work()) { @Override public void run() { deep(); } }.start(c); }
  String t = \"\"\"
   { "x" }
  \"\"\";
  interface In { default void d() { e(); } void q(); }
}
record P(int x) { int y() { return x(); } }
"""
    assert found("E.java", code, "symbol", "kind", "qualified_name") == [
        ("class", "A"), ("method", "A.A"), ("method", "A.gen"), ("method", "A.gen.run"), ("interface", "A.In"), ("method", "A.In.d"), ("class", "P"), ("method", "P.y"),
    ]
    assert found("E.java", code, "call", "name", "qualified_name") == [
        ("ArrayList", "A"), ("mk", "A"), ("super.init", "A.A"), ("Thread", "A.gen"), ("work", "A.gen"), ("deep", "A.gen.run"), ("().start", "A.gen"), ("e", "A.In.d"), ("x", "P.y"),
    ]
    assert found("E.java", code, "type_ref", "name") == [("Base",), ("I",), ("J",)]


def test_long_files_are_read_in_linear_time():
    unit = "export function f%d(x: number) { const t = `a ${g(x)}`; if (x < 3) { return h%d(x / 2) } }\n"
    small, large = ("".join(unit % (k, k) for k in range(n)) for n in (500, 4000))
    spent = []
    for text in (small, large):
        began = time.perf_counter()
        rows = parse_braces("a.ts", text)
        spent.append(time.perf_counter() - began)
        assert sum(r["row"] == "call" for r in rows) == 2 * sum(r["row"] == "symbol" for r in rows)
    assert spent[1] < 24 * spent[0] + 0.2


def test_any_text_is_read():
    rng = random.Random(3)
    parts = ["${", "/", "'a ", "r#\"", "#", "default ", "fn ", "use ", "as ", "trait T ", "?.", "function ", "class ", "f", "(", ")", "{", "}", "[", "]", "=>", "const x = ", "import ", "'a'", "\"", "`", "/*", "*/", "//", "\n", ";", "type T = ", "func (s *S) ", "impl ", "interface I ", "<", ">", " ", ":", "é", "extends B "]
    for k in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        for r in parse_braces(f"a.{('ts', 'go', 'java', 'rs')[k % 4]}", text):
            assert 1 <= r["line"] <= text.count("\n") + 1 and r["name"]
