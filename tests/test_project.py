import json

import pytest

from lodestar.project import Designs, Observations, Project, import_targets

FILES = {
    "a.py": "from .b import helper\nfrom .sub.c import deep\n\ndef parse_config(x):\n    return helper(x)\n\nclass Loader:\n    def load(self):\n        return parse_config(1)\n",
    "b.py": "from .sub.c import deep\n\ndef helper(x):\n    return deep(x)\n",
    "sub/c.py": "def deep(x):\n    return print(x)\n\ndef deep2(x):\n    return missing(x)\n",
    "alone.py": "x = 1\n",
    "web.ts": "import {y} from './side'\nexport function main() {}\n",
    "side.ts": "import z from 'package'\nexport function count() {}\nexport function count2() {}\n",
}


def write(folder, files):
    for name, body in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(body)
    return str(folder)


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    return Project(spark, write(tmp_path_factory.mktemp("src"), FILES))


def test_store(project, rows):
    assert rows(project.file_edges, "source", "target") == [("a.py", "b.py"), ("a.py", "sub/c.py"), ("b.py", "sub/c.py"), ("web.ts", "side.ts")]
    assert rows(project.calls, "source", "target") == [("a.py#Loader.load", "a.py#parse_config"), ("a.py#parse_config", "b.py#helper"), ("b.py#helper", "sub/c.py#deep")]
    assert rows(project.refs, "name", "status") == [("deep", "resolved"), ("helper", "resolved"), ("missing", "failed"), ("parse_config", "resolved"), ("print", "external")]


def test_questions(project, rows):
    assert rows(project.impact(["sub/c.py"]), "node", "depth", "risk") == [("a.py", 1, "medium"), ("b.py", 1, "medium"), ("sub/c.py", 0, "medium")]
    assert [r.node for r in project.impact(["sub/c.py#deep"], symbols=True).orderBy("depth").collect()] == ["sub/c.py#deep", "b.py#helper", "a.py#parse_config", "a.py#Loader.load"]
    assert project.hubs(1).first().node == "sub/c.py"
    assert rows(project.closure(["a.py"], 1), "node") == [("a.py",), ("b.py",), ("sub/c.py",)]
    assert rows(project.search("parse_config"), "id", "provider") == [("a.py#parse_config", "exact")]
    assert rows(project.references("helper"), "path", "line", "confirmed") == [("a.py", 1, True), ("a.py", 5, True), ("b.py", 3, True)]
    assert rows(project.similar_names(), "scope", "names") == [("side.ts", ["count", "count2"]), ("sub/c.py", ["deep", "deep2"])]
    h = project.health().first()
    assert (h.files, h.orphan, h.cycle) == (6, 1, 0)
    assert rows(project.communities(), "members") == [(2,), (3,)]
    best = project.diagnose("ValueError in helper(x) at b.py:4").first()
    assert (best.id, best.cause) == ("b.py#helper", "error_direct")
    assert project.observe_points(["sub/c.py"]).first().id == "sub/c.py#deep"
    assert project.layers([("low", "sub")], {}).count() == 0
    disk = project.files.select("path", "content_hash").toDF("path", "hash").where("path <> 'a.py'")
    assert ("ghost", 1) in rows(project.integrity(disk))


def test_questions_about_fields_rules_and_features(spark, tmp_path, rows):
    files = {"t.ts": "export interface Opt { name: string; size: number }\n", "u.ts": "import { Opt } from './t'\nexport const o = { name: 'x', size: 1 }\nexport const n = o.size\n", "far/v.ts": "const p = { size: 1, name: 2 }\n", "far/deep/only/w.ts": "log(1, {\n a: 2 })\n"}
    p = Project(spark, write(tmp_path, files))
    assert rows(p.field_references("size"), "path", "line", "kind") == [("far/v.ts", 1, "key"), ("t.ts", 1, "decl"), ("u.ts", 2, "key"), ("u.ts", 3, "read")]
    assert rows(p.field_references("size", ["t.ts"]), "path") == [("t.ts",), ("u.ts",), ("u.ts",)]
    assert rows(p.constructions("t.ts", "Opt"), "path", "hits") == [("far/v.ts", 2), ("u.ts", 2)] and rows(p.constructions("t.ts", "Opt", within=["t.ts"]), "path") == [("u.ts",)]
    assert [(r.path, r.line, r.holes["x"]) for r in p.rules({"l": "log($x)"}).collect()] == [("far/deep/only/w.ts", 1, "1, {\n a: 2 }")]
    assert rows(p.feature_tree(2), "feature", "files", "own") == [("", 4, 2), ("far", 2, 2)]
    points = p.observe_points(now_ms=0).collect()  # all files are newer than that
    assert {e.signal for r in points for e in r.evidence} <= {"hot_file", "called"}


def test_two_states(spark, project, tmp_path, rows):
    other = Project(spark, write(tmp_path, FILES | {"b.py": "def helper(x):\n    return 2\n\ndef new():\n    pass\n"}))
    assert rows(other.changes(project)) == [("b.py", "helper", "changed"), ("b.py", "new", "added")]
    assert ("new", "b_only") in rows(project.compare(other)) and ("helper", "conflict") in rows(project.compare(other))


def test_targets():
    assert import_targets("p/a.py", "..q.r")[0] == "q/r.py"
    assert import_targets("p/a.ts", "../q")[2] == "q.ts"
    assert import_targets("p/a.py", "os") == []


def test_observations(spark, tmp_path, rows):
    lines = [{"probe": "a.Run.enter", "time": "2026-08-14T10:00:00Z", "trace_id": "t", "frame_id": 1, "parent_id": 0, "fields": {"file": "src/a.ts"}}, {"probe": "b.Step.enter", "time": "2026-08-14T10:00:01Z", "trace_id": "t", "frame_id": 2, "parent_id": 1, "fields": {"err": "x", "op": "writefile", "file": "src/b.ts"}}]
    (tmp_path / "events.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nbad")
    o = Observations(spark, [str(tmp_path / "events.jsonl")])
    assert (o.skipped.first().skipped, o.log()[1].first().anomalies, o.log(["a.ts"])[0].count()) == (1, 1, 1)
    assert rows(o.traces(), "sequence") == [(["a.Run", "b.Step"],)]
    assert rows(o.tree(), "frame_id", "role") == [(1, "root"), (2, "child")]
    assert rows(o.judge().where("rule is not null"), "probe", "rule") == [("b.Step.enter", "silent-error-discard")]
    assert o.chains(["a.Run", "b.Step"]).first().complete


def test_designs(spark, rows):
    nodes = lambda *x: spark.createDataFrame(list(x), "id string, label string, type string, layer string")
    edges = spark.createDataFrame([("a", "b", None, None, None)], "source string, target string, type string, arrow string, layer string")
    base, now = Designs(nodes(("a", "A", "box", None), ("b", "B", "box", "x")), edges), Designs(nodes(("a", "A2", "box", None), ("c", "C", "box", None)), edges)
    assert rows(base.list_nodes("main"), "id") == [("a",)]
    assert rows(base.list_edges(), "type", "arrow", "layer") == [("straight", "forward", "main")]
    assert rows(base.diff(now), "id", "change") == [("a", "modified"), ("b", "removed"), ("c", "added")]
    assert rows(base.states(now, base)) == [("a", "design_only"), ("b", "removed"), ("c", "added")]
    assert rows(base.ranks()) == [("a", 0), ("b", 1)]
