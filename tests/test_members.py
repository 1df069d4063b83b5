"""Fields of objects and the tree of features."""

import random

from lodestar.operators import members as M
from lodestar.operators import monolith as O

CODE = """interface Opt { name: string; size?: number
  run(x: Opt): void
  readonly tags: string[] }
type Pair = { left: Opt, right: Opt }
class Box { #count = 0; name: string = 'b'; get() { return this.count + this.name } }
const a: Opt = { name: 'x', size: 2, run() {}, tags }
const { name, size: s } = a
function f({ name }: Opt, b = a?.size) { if (b) { name(b) } return { name, other: 1 } }
switch (a.name) { case 1: { size() } }
const g = ({ tags }) => tags.size
log({ left: a, right: { name: 1, size: 3 } })
"""


def rows(kind):
    return [(line, name, owner if kind == "decl" else None) for line, k, name, owner in M.member_rows(CODE) if k == kind]


def test_fields_by_kind():
    assert [r for r in rows("decl") if r[2] == "Opt"] == [(1, "name", "Opt"), (1, "size", "Opt"), (2, "run", "Opt"), (3, "tags", "Opt")]
    assert [r[1] for r in rows("decl") if r[2] == "Pair"] == ["left", "right"] and {"count", "name", "get"} == {r[1] for r in rows("decl") if r[2] == "Box"}
    assert [(a, b) for a, b, _ in rows("key")] == [(6, "name"), (6, "size"), (6, "run"), (6, "tags"), (8, "name"), (8, "other"), (11, "left"), (11, "right"), (11, "name"), (11, "size")]
    assert [(a, b) for a, b, _ in rows("destructure")] == [(7, "name"), (7, "size"), (8, "name"), (10, "tags")]
    assert [(a, b) for a, b, _ in rows("read")] == [(5, "count"), (5, "name"), (8, "size"), (9, "name"), (10, "size")]


def test_references_and_constructions(spark):
    files = spark.createDataFrame([("a.ts", CODE), ("b.ts", "x = { name: 1, size: 2, no: 3 }\ny = { name: 2 }"), ("c.go", "a.name"), ("d.ts", None)], "path string, content string")
    fields = M.members(files)
    got = {tuple(r) for r in M.field_references(fields, "size").collect()}
    assert got == {("a.ts", 1, "decl"), ("a.ts", 6, "key"), ("a.ts", 7, "destructure"), ("a.ts", 8, "read"), ("a.ts", 10, "read"), ("a.ts", 11, "key"), ("b.ts", 1, "key")}
    only = spark.createDataFrame([("b.ts",)], "path string")
    assert [tuple(r) for r in M.field_references(fields, "size", only).collect()] == [("b.ts", 1, "key")]
    assert [tuple(r) for r in M.constructions(fields, "a.ts", "Opt").collect()] == [("a.ts", 6, 4, "name,run,size,tags"), ("a.ts", 11, 2, "name,size"), ("b.ts", 1, 2, "name,size")]
    assert M.constructions(fields, "a.ts", "None").count() == 0


def test_any_text_has_fields():
    rng = random.Random(4)
    parts = ["{", "}", "(", ")", "a", ":", ",", ".", "?.", "=", "=>", "const ", "interface I ", "type T = ", "class C ", "\n", "`${", "'x", "/", "case ", "return "]
    for _ in range(4000):
        for line, kind, name, _owner in M.member_rows("".join(rng.choice(parts) for _ in range(rng.randrange(40)))):
            assert line >= 1 and kind in ("read", "key", "destructure", "decl") and name


def plain_tree(paths, least):
    folders = {p.rpartition("/")[0] for p in paths}
    every = {"/".join(f.split("/")[:k]) for f in folders for k in range(len(f.split("/")) + 1)} | {""}
    under = lambda d: [p for p in paths if not d or p.startswith(d + "/")]
    kept = set()
    for d in every:
        rest = [p[len(d) + 1 if d else 0 :] for p in under(d)]
        kids, direct = {r.split("/")[0] for r in rest if "/" in r}, [r for r in rest if "/" not in r]
        if not d or (len(rest) >= least and not (not direct and len(kids) == 1)):
            kept.add(d)
    near = lambda p: max((d for d in kept if not d or p.startswith(d + "/")), key=len)
    return {(d, near(d) if d else None, len(under(d)), sum(near(p) == d for p in paths)) for d in kept}


def test_feature_tree(spark):
    rng = random.Random(6)
    paths = sorted({"/".join(rng.choice("abc") for _ in range(rng.randrange(0, 5))) + f"/f{k}.ts" for k in range(80)} | {"top.ts", "z/z/z/one.ts", "z/z/z/two.ts", "z/z/z/three.ts"})
    paths = [p.lstrip("/") for p in paths]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for least in (1, 3, 10, 1000):
        assert {tuple(r) for r in M.feature_tree(df, least).collect()} == plain_tree(paths, least)


def test_anchors_and_sub_splits(spark):
    n = spark.createDataFrame(
        [("a", "userService", "function", "a.ts"), ("b", "getStore", "function", "a.ts"), ("c", "helper", "method", "a.ts"), ("d", "Open", "function", "m.go"), ("e", "x.Client", "function", "m.py"), ("f", "_p", "function", "m.py"), ("g", "F", "file", "m.go")],
        "id string, name string, kind string, file_path string",
    )
    calls = spark.createDataFrame([("a", "c")] * 2 + [("b", "c"), ("c", "c"), ("g", "c"), ("c", "a"), ("b", "zz")], "source string, target string")
    got = {r.node: (r.in_degree, r.score, r.anchor) for r in O.anchor_scores(n, calls).collect()}
    assert got == {"a": (1, round(1 / 3 + 1.3, 9), True), "b": (0, 1.3, False), "c": (3, 1.3, False), "d": (0, 1.0, True), "e": (0, 1.5, False), "f": (0, 0.0, False)}
    members = spark.createDataFrame([(f"{o}{k}", "one") for o in "xy" for k in range(3)] + [("z0", "one"), ("q0", "two")], "node string, community string")
    owners = spark.createDataFrame([(f"{o}{k}", o.upper()) for o in "xy" for k in range(3)] + [("z0", "Z"), ("q0", None)], "node string, owner string")
    inner = [("x0", "x1"), ("y0", "y1"), ("x0", "z0"), ("z0", "q0"), ("x2", "gone")]
    for more, ratio, can in (([("x0", "y0")], 0.25, True), ([("x0", "y0")] * 3, 0.5, False)):
        got = {r.community: tuple(r)[1:] for r in O.sub_splits(members, owners, spark.createDataFrame(inner + more, "source string, target string")).collect()}
        assert got == {"one": (2, 3 + len(more), len(more), ratio, can), "two": (0, 0, 0, 0.0, False)}
