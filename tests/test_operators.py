"""Operators on hand-seeded tables."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.functions import scalars as S
from lodestar.operators import aggregates as A
from lodestar.operators import diffs as D
from lodestar.operators import filters as P
from lodestar.operators import graph as G
from lodestar.operators import joins as J
from lodestar.operators import observe as O
from lodestar.operators import search as R
from lodestar.operators import windows as W
from lodestar.operators.components import connected_components
from lodestar.sources import events as EV
from lodestar.sources import store
from lodestar.sources import tree as T
from lodestar.streaming import events as V

PROBE = "probe string, time string, seq long, file string, op string, err string, benign boolean"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_log_pool(spark):
    e = frame(spark, [("a.enter", "10:00", 1, "src/a.ts", None, None, None), ("b.enter", "10:01", 2, "src/b.ts", None, None, None), ("aSink.writefile", "10:02", 3, "src/a.ts", "writefile", "E", False), ("c", "10:03", 4, None, None, None, None)], PROBE)
    shown, counts = P.log_pool(e, O.silent_error(), ["src/a.ts"])
    assert (shown.count(), tuple(counts.first())) == (2, (2, 1))
    assert P.log_pool(e, O.silent_error(), ["b.ts"])[1].first().total == 1
    shown, counts = P.log_pool(e, O.silent_error())
    assert (shown.count(), counts.first().total) == (1, 4)
    assert P.log_pool(e, O.silent_error(), show_all=True)[0].count() == 4


def test_three_file_impact(spark, rows):
    e = frame(spark, [("a", "b"), ("c", "a"), ("x", "y")], "source string, target string")
    found = G.bfs(e, frame(spark, [("b",)], "node string"), 5, "in")
    assert rows(found, "node", "depth", "parent") == [("a", 1, "b"), ("b", 0, None), ("c", 2, "a")]
    assert G.bfs(e, frame(spark, [], "node string"), 5).count() == 0


def test_symbol_impact_seeds(spark, rows):
    calls = frame(spark, [("a#x", "b#b1"), ("e#y", "b#b2")], "source string, target string")
    imports = frame(spark, [("a", "b"), ("e", "b")], "source string, target string")
    nodes = frame(spark, [("b#b1", "b"), ("b#b2", "b")], "id string, file_path string")
    of = lambda state, sym: rows(G.symbol_impact(calls, imports, frame(spark, [("b", sym, state)], "file string, symbol string, state string"), nodes), "node", "depth")
    assert of("changed", "b1") == [("a#x", 1), ("b#b1", 0)]
    assert of("removed", "b1") == [("a#x", 1), ("b#b1", 0), ("b#b2", 0), ("e#y", 1)]
    assert of("added", "b1") == []
    assert of("norm", "") == [("a", 1), ("b", 0), ("e", 1)]


TRACE = "probe string, time int, seq long, err string, trace_id string, frame_id long"


def test_traces(spark, rows):
    e = frame(spark, [("a.Run.enter", 0, 1, None, "t1", 1), ("b.Step.enter", 1, 2, "x", "t1", 2), ("b.Step.exit", 2, 3, None, "t1", 2), ("a.Run.exit", 5, 4, "y", "t1", 1), ("z", 3, 5, None, "t2", None), ("q", 3, 6, None, None, None)], TRACE)
    got = {r.trace_id: r for r in W.trace_sequences(e).collect()}
    assert got["t1"].sequence == ["a.Run", "b.Step"] and (got["t1"].events, got["t1"].errs) == (4, 2)
    assert got["t2"].sequence == ["z"] and len(got) == 2


def test_chain_budget(spark):
    chains = spark.range(520).select(F.format_string("t%04d", "id").alias("trace_id"), F.col("id").alias("first"), F.array(F.lit("a")).alias("sequence"), F.lit(1).alias("n"))
    assert W.chain_budget(chains, F.col("n")).count() == 512
    assert W.chain_budget(chains, F.lit(1000)).count() == 5


@pytest.mark.parametrize("want,seq,n", [(["a", "c"], ["a", "x", "b", "c"], 2), (["c", "a"], ["a", "x", "b", "c"], 1), ([], [], 0), (["a", "b", "c"], ["a", "x", "b", "y"], 2), (["a", "b"], ["b", "a"], 1)])
def test_prefix_length(spark, want, seq, n):
    df = spark.createDataFrame([(seq,)], "s array<string>")
    assert df.select(O.prefix_length(F.col("s"), want)).first()[0] == n


def test_call_tree(spark, rows):
    e = frame(spark, [("order.Place.enter", 0, "t", 1, 0), ("order.Place.exit", 9, "t", 1, 0), ("pay.Charge.enter", 1, "t", 2, 1), ("x.enter", 2, "t", 5, 4), ("x.exit", 3, "t", 5, 4)], "probe string, time int, trace_id string, frame_id long, parent_id long")
    assert rows(G.call_tree(e), "frame_id", "role", "missing_out") == [(1, "root", False), (2, "child", True), (5, "orphan", False)]


def test_counters_and_histogram(spark):
    e = spark.createDataFrame([("svc.a.enter",)] * 100 + [("svc.a.exit",)] * 100 + [("svc.a.catch",)] * 7, "probe string")
    assert {r.probe: (r.hits, r.errs) for r in A.probe_counters(e).collect()} == {"svc.a.enter": (100, 0), "svc.a.exit": (100, 0), "svc.a.catch": (7, 7)}
    d = spark.range(1, 101).select(F.lit("p").alias("probe"), F.col("id").alias("dur_us"))
    h = A.latency_histogram(d)
    assert 30 <= A.histogram_percentile(h, 0.5).first().value_us <= 90
    assert 90 <= A.histogram_percentile(h, 0.99).first().value_us <= 200
    assert A.latency_histogram(spark.createDataFrame([("p", 10**10), ("p", 0), ("p", 1 << 10)], "probe string, dur_us long")).select(F.sort_array(F.collect_list("bucket"))).agg(F.first("sort_array(collect_list(bucket), true)")).first()[0] == [0, 10, 19]


def test_ledger(spark, rows):
    schema = "id string, status string, consumed_at string, declared_files array<string>, unexpected_files array<string>"
    e = frame(spark, [("1", "ok", "t", ["a"], []), ("2", "violated", "t", ["a", "a"], ["x"]), ("3", "resolved", "t", ["a"], ["y", "x"]), ("4", "pending", "", ["a"], []), ("5", "expired", None, ["b"], [])], schema)
    r = A.ledger_summary(e).first()
    assert (r.consumed, r.violated, round(r.rate, 6)) == (3, 2, 0.666667)
    assert rows(A.ledger_repeats(e)) == [("a", 2, ["x", "y"])]
    assert A.ledger_summary(e.limit(0)).first().rate == 0


@pytest.mark.parametrize("samples,verdict", [
    ([(100, 20, 0), (102, 22, 0)], "ok"), ([(100, 20, 5), (1500, 40, 8)], "grow"),
    ([(300, 100, 0), (300, 150, 0), (300, 200, 0), (300, 260, 0)], "leak"), ([(500, 80, 10)], "ok"),
])
def test_leak(spark, samples, verdict):
    df = spark.createDataFrame([("s", i, float(r), float(h), float(x), 0.0) for i, (r, h, x) in enumerate(samples)], "series string, t int, rss double, heap double, external double, buffers double")
    assert W.leak_verdict(df).first().verdict == verdict


def test_native_leak(spark):
    df = spark.createDataFrame([("s", 0, 500.0, 80.0, 10.0, 0.0), ("s", 1, 1600.0, 90.0, 500.0, 0.0)], "series string, t int, rss double, heap double, external double, buffers double")
    assert W.leak_verdict(df, 2048.0).first().verdict == "suspicious-native"


CONFUSED = [("count", "count2", True), ("userData", "userdata", True), ("node", "nodes", False), ("node", "mode", False), ("ab", "ac", False), ("recieve", "receive", True), ("city", "cities", False), ("value", "valve", True)]


@pytest.mark.parametrize("a,b,yes", CONFUSED)
def test_confusable(spark, a, b, yes):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(R.confusable(F.col("a"), F.col("b"))).first()[0] is yes
    assert R.py_confusable(a, b) is yes


def test_similar_names(spark, rows):
    n = frame(spark, [("f", "count", 1, 1), ("f", "count2", 2, 1), ("g", "count", 1, 1), ("f", "other", 3, 1)], "scope string, name string, ordinal int, refs int")
    assert rows(R.similar_names(n)) == [("f", "count", ["count", "count2"])]


@pytest.mark.parametrize("a,b,c", [([1, 2, 3], [1, 2, 3], 1.0), ([1, 0], [0, 1], 0.0), ([0, 0], [1, 1], 0.0), ([1, 0, 9], [1, 0], 1.0)])
def test_cosine(spark, a, b, c):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<float>, b array<float>")
    assert abs(df.select(R.cosine(F.col("a"), F.col("b"))).first()[0] - c) < 1e-12


def test_suggestions_match_brute_force(spark, rows):
    names = ["a", "ab", "abc", "parseConfig", "parseConfg", "praseConfig", "load", "laod", "loader", "x1"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.wanted, r.known) for r in R.suggest_names(df, df, most=99).collect()}
    assert got == {(a, b) for a in names for b in names if R.edit_distance(a, b) <= 2}


def test_search_needs_three_letters(spark):
    n = frame(spark, [("f#parse", "function", "parse", "parse", None, None), ("f", "file", "parse", "parse", None, None)], "id string, kind string, name string, qualified_name string, docstring string, signature string")
    assert R.search_symbols(n, "pa").count() == 0
    assert [r.id for r in R.search_symbols(n, "PARSE").collect()] == ["f#parse"]
    assert R.semantic_search(n, "no such thing").count() == 0


def test_fuzzy_levels():
    text = "def f():\n    a = 1\n    return  a\nend"
    assert R.locate_block(text, "    a = 1") == ("exact", [(2, 2)])
    assert R.locate_block(text, "return a") == ("blanks", [(3, 3)])
    assert R.locate_block(text, "a=1") == ("indent", [(2, 2)])
    assert R.locate_block(text, "def f():\n...\nend") == ("ellipsis", [(1, 4)])
    assert R.locate_block(text, "nothing") == (None, [])


def test_rule_patterns(spark, rows):
    s = frame(spark, [("a", "x = foo(1)\nif a == a:\nif a == b:")], "path string, content string")
    got = R.match_rules(s, {"call": "foo($x)", "same": "$a == $a:"})
    assert ("call", "a", 1, "foo(1)") in rows(got)
    assert [r for r in rows(got) if r[0] == "same"] == [("same", "a", 2, "a == a:")]


def test_highlight():
    assert R.highlight("The cat sat", ["cat", "cats"]) == [("The ", None), ("cat", "cat"), (" sat", None)]
    assert R.highlight("", ["x"]) == [("", None)]


def test_three_way_without_a_side(spark, rows):
    t = lambda *x: frame(spark, list(x), "id int, value string")
    assert rows(D.three_way(t((1, "a"), (2, "b")), None, t((1, "a"), (3, "c")))) == [(1, "unchanged"), (2, "deleted_from_live"), (3, "live_only")]
    assert rows(D.three_way(t((1, "a"), (2, "b")), t((1, "x"), (3, "c")), None)) == [(1, "design_only"), (2, "removed"), (3, "added")]


CHAINS = [("added", "removed", None), ("added", "changed", "added"), ("removed", "added", "changed"), ("changed", "removed", "removed"), (None, "added", "added"), ("changed", None, "changed")]


@pytest.mark.parametrize("s0,s1,out", CHAINS)
def test_chain_states(spark, s0, s1, out):
    row = lambda s: frame(spark, [("f", "q", s)] if s else [], "file_path string, qualified_name string, state string")
    got = [r.state for r in D.chain_diffs(row(s0), row(s1)).collect()]
    assert got == ([out] if out else [])
    lists = lambda s, a, b: frame(spark, [("f", a, b, *[["q"] if s == x else [] for x in ("added", "removed", "changed")])] if s else [], "file_path string, from_hash string, to_hash string, added array<string>, removed array<string>, changed array<string>")
    r = D.merge_symbol_diffs(lists(s0, "1", "2"), lists(s1, "2", "3")).first()
    assert [x for x in ("added", "removed", "changed") if r[x]] == ([out] if out else [])


def test_scc_and_components(spark, rows):
    e = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("z", "z"), ("g", "h")], "source string, target string")
    assert rows(G.scc(e)) == [("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("d", "d", 2), ("e", "d", 2), ("z", "z", 1)]
    keep = lambda df, n: store.checkpoint(df)
    parts = connected_components(e.select(F.col("source").alias("a"), F.col("target").alias("b")), keep)
    assert {r.node: r.component for r in parts.collect()} == dict.fromkeys("abcdef", "a") | {"g": "g", "h": "g"}


def test_components_of_a_long_path(spark):
    e = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    parts = connected_components(e, lambda df, n: store.checkpoint(df))
    assert (parts.count(), parts.agg(F.max("component")).first()[0]) == (301, 0)


def test_louvain_and_labels(spark, rows):
    two = [("g", *p, 1.0) for p in [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]]
    e = frame(spark, two, "graph string, source string, target string, weight double")
    assert {r.node: r.community for r in G.louvain(e).collect()} == dict.fromkeys("abc", "a") | dict.fromkeys("def", "d")
    n = frame(spark, [("g", x, i, "L" if x == "a" else "R" if x == "f" else None) for i, x in enumerate("abcdef")], "graph string, node string, ordinal int, anchor string")
    got = {r.node: r.label for r in G.label_propagation(e, n).collect()}
    assert got["a"] == "L" and got["f"] == "R"


def test_ranks_with_a_cycle(spark, rows):
    e = frame(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("x", "y"), ("y", "x")], "source string, target string")
    n = frame(spark, [(x,) for x in "abcxy"], "node string")
    assert rows(G.longest_rank(e, n)) == [("a", 0), ("b", 1), ("c", 2), ("x", 3), ("y", 3)]


def test_quota_counts_accepted_only(spark):
    e = frame(spark, [("p", t, t) for t in [0, 10, 20, 65, 70, 80]], "probe string, time_ms long, seq long")
    got = {r.time_ms: r.accepted for r in W.accepted_quota(e, "probe", "time_ms", 2, 60).collect()}
    assert got == {0: True, 10: True, 20: False, 65: True, 70: True, 80: False}


def test_token_bucket_batch_equals_stream(spark, tmp_path):
    rows = [("p", i, i * 100) for i in range(20)]
    e = frame(spark, rows, "probe string, seq long, time_ms long")
    batch = {r.time_ms for r in V.limit_batch(e, 2.0, 3.0).where("accepted").collect()}
    e.write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = V.stream_files(spark, str(tmp_path / "in"), "probe string, seq long, time_ms long").select("probe", "time_ms")
    out = []
    V.run_to_end(V.rate_limit(stream, 2.0, 3.0), lambda df, n: out.extend(r.time_ms for r in df.collect()), str(tmp_path / "state"))
    assert set(out) == batch and len(batch) < 20


def test_ring_stream(spark, tmp_path):
    frame(spark, [("p", i) for i in range(10)], "probe string, seq long").write.parquet(str(tmp_path / "in"))
    out = []
    V.run_to_end(V.recent_ring(V.stream_files(spark, str(tmp_path / "in"), "probe string, seq long"), 4), lambda df, n: out.extend(tuple(r) for r in df.collect()), str(tmp_path / "s"), "update")
    assert out == [("p", 4, 6, 9)]


def test_ring_stream_holds_the_last_by_number_in_any_order(spark, tmp_path):
    """More rows than an Arrow batch holds, latest first, then a file of earlier ones and some without a number."""
    down = [("p", 30_000 - i) for i in range(25_000)]
    for rows in (down, [("p", i) for i in range(9)] + [("q", None), ("q", 1 << 60), (None, None)]):
        frame(spark, rows, "probe string, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = {}
    V.run_to_end(V.recent_ring(V.stream_files(spark, str(tmp_path / "in"), "probe string, seq long", files_per_batch=1), 4), lambda df, n: last.update({r[0]: tuple(r)[1:] for r in df.collect()}), str(tmp_path / "s"), "update")
    assert last == {"p": (4, 29_997, 30_000), "q": (2, 1 << 60, 1 << 60), None: (1, None, None)}


def test_simulation(spark):
    m = V.Simulation({"go": [("increment", "n", 2), ("emit", "next", None)], "next": [("push", "q", "x"), ("move", "q", "done")]}, {"n": 1})
    m.fire("go")
    assert m.state == {"n": 3, "q": [], "done": ["x"]} and m.trace == ["go", "next"]
    with pytest.raises(RecursionError):
        V.Simulation({"a": [("emit", "a", None)]}, {}).fire("a")


def test_jsonl_skips_bad_lines(spark, tmp_path):
    lines = [json.dumps({"probe": "a", "time": "2026-08-14T10:00:00Z", "fields": {"err": "x", "n": 1}, "frame_id": 3}), "{broken", "[1]", ""]
    (tmp_path / "events1.jsonl").write_text("\n".join(lines))
    (tmp_path / "other.jsonl").write_text("x")
    paths = EV.event_files(spark, [str(tmp_path), str(tmp_path / "none")])
    assert len(paths) == 1
    good, skipped = EV.load_events(spark, paths)
    r = good.first()
    assert (r.probe, r.err, r.frame_id, str(r.time), skipped.first().skipped) == ("a", "x", 3, "2026-08-14 10:00:00", 2)


def test_ledger_documents_and_manifests(spark, tmp_path):
    (tmp_path / "ledger.json").write_text(json.dumps({"entries": [{"id": "1", "status": "ok", "declared_files": ["a"]}]}))
    (tmp_path / "bad.json").write_text("{")
    assert [r.id for r in EV.load_ledger(spark, str(tmp_path / "*.json")).collect()] == ["1"]
    for name, body in (("one", json.dumps({"name": "one", "closure": {"external": [{"source": "x", "class": "third_party"}]}})), ("two", "nope{")):
        (tmp_path / "m" / name).mkdir(parents=True)
        (tmp_path / "m" / name / "manifest.json").write_text(body)
    good, bad = EV.load_manifests(spark, str(tmp_path / "m"))
    assert ([r.name for r in good.collect()], bad.first().corrupt) == (["one"], 1)
    docs = spark.createDataFrame([("f1", "design", "T")], "feature string, view string, title string")
    EV.save_documents(docs, str(tmp_path / "d"))
    assert (tmp_path / "d" / "feature=f1" / "view=design").exists()


def test_tree(spark, tmp_path, rows):
    (tmp_path / "src" / "tests").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("from .b import helper\n\nclass C:\n    def load(self):\n        return helper()\n")
    (tmp_path / "src" / "b.ts").write_text("import {x} from './c'\nexport function helper() {}\n")
    (tmp_path / "src" / "bad.py").write_text("def (")
    (tmp_path / "src" / "tests" / "t.py").write_text("x = 1")
    files = T.walk(spark, str(tmp_path / "src"))
    assert rows(files, "path") == [("a.py",), ("b.ts",), ("bad.py",)]
    p = T.parse(files)
    assert rows(p.where("row = 'symbol'"), "path", "qualified_name", "kind") == [("a.py", "C", "class"), ("a.py", "C.load", "method"), ("b.ts", "helper", "function")]
    assert rows(p.where("row = 'import'"), "path", "name") == [("a.py", ".b"), ("b.ts", "./c")]
    assert rows(p.where("row = 'call'"), "name", "qualified_name") == [("helper", "C.load")]


def test_manifests(spark, rows):
    f = frame(spark, [("p/package.json", '{"dependencies": {"a": "1"}, "devDependencies": {"b": "2"}}'), ("go.mod", "module m\nrequire (\n\tgithub.com/x/y v1.2.3\n)"), ("requirements.txt", "numpy>=1 # c\n-r other"), ("pyproject.toml", '[project]\ndependencies = ["pandas[x] >= 2"]'), ("q/package.json", "{")], "path string, content string")
    assert rows(T.dependencies(f), "package", "version") == [("a", "1"), ("b", "2"), ("github.com/x/y", "v1.2.3"), ("numpy", ">=1"), ("pandas", ">= 2")]


def test_store(spark, rows):
    edges = frame(spark, [("a", "b", "call", None, None), ("a", "c", "call", 1, None)], "source string, target string, kind string, line int, col int")
    more = frame(spark, [("a", "b", "call", None, None), ("b", "c", "call", None, 2), ("b", "c", "call", None, 2)], edges.schema)
    assert store.insert_edges(edges, more).count() == 3
    nodes = frame(spark, [("a", "f1"), ("b", "f2"), ("c", "f2")], "id string, file_path string")
    left, kept = store.remove_file(nodes, edges, frame(spark, [("f1",)], "path string"))
    assert (rows(left, "id"), kept.count()) == ([("b",), ("c",)], 0)


def test_swap_and_rotate(spark, tmp_path):
    p = str(tmp_path / "t")
    store.swap(spark.range(3), p)
    before = store.read_snapshot(spark, p)
    store.swap(spark.range(5), p)
    assert (before.count(), store.read_snapshot(spark, p).count()) == (3, 5)
    store.swap(spark.range(7), p)
    assert store.read_snapshot(spark, p).count() == 7 and len([x for x in (tmp_path / "t").iterdir() if x.is_dir()]) == 2


def test_ring_extracts_before_it_recycles(spark, tmp_path, rows):
    log, schema = str(tmp_path / "log"), "seq long, err string"
    gone = []
    for k in range(6):
        batch = frame(spark, [(10 * k, "E"), (10 * k + 1, None), (10 * k + 2, "")], schema)
        gone += store.append_ring(batch, log, F.length("err") > 0, slot_bytes=10, keep=3)
    assert gone == [0, 1, 2]
    assert sorted(r.seq for r in store.read_ring(spark, log, schema).collect()) == [30, 31, 32, 40, 41, 42, 50, 51, 52]
    assert sorted(r.seq for r in store.read_ring(spark, log, schema, "deviations").collect()) == [0, 10, 20]
    assert store.append_ring(frame(spark, [(99, None)], schema), log, slot_bytes=1 << 20, keep=3) == []
    assert len(list((tmp_path / "log").glob("slot=*"))) == 3


def test_upsert_keeps_the_last_of_a_key(spark, rows):
    old = frame(spark, [(1, "a"), (2, "b")], "id long, name string")
    new = frame(spark, [(2, "x"), (2, "y"), (3, "z")], "id long, name string")
    assert rows(store.upsert(old, new, "id")) == [(1, "a"), (2, "y"), (3, "z")]


def test_flushes(spark, rows):
    assert V.flush_times([0, 100, 200, 1000], 150, 2000) == [350, 350, 350, 1150]
    # A storm: the first flush waits for a pause, later ones are forced.
    storm = list(range(0, 1000, 100)) + [1500] + list(range(1600, 6000, 100))
    got = V.flush_times(storm, 150, 2000)
    assert got[:10] == [1050] * 10 and got[10] == got[11] and all(f >= t for f, t in zip(got, storm, strict=True))
    assert {f - t for f, t in zip(got, storm, strict=True) if t > 1600} and max(f - t for f, t in zip(got, storm, strict=True)) <= 2000
    c = frame(spark, [("p", "a", 0, "added"), ("p", "a", 100, "changed"), ("p", "b", 100, "deleted"), ("p", "a", 900, "deleted"), ("q", "a", 5, "added")], "project string, path string, time_ms long, change string")
    assert sorted(rows(V.flush_changes(c), "project", "flush_ms", "path", "change", "n")) == [("p", 250, "a", "changed", 2), ("p", 250, "b", "deleted", 1), ("p", 1050, "a", "deleted", 1), ("q", 155, "a", "added", 1)]


def test_backfill_is_single_flight(spark, tmp_path):
    spark.range(40).repartition(8).write.parquet(str(tmp_path / "in"))
    seen, second = [], []
    files = lambda: V.stream_files(spark, str(tmp_path / "in"), "id long", files_per_batch=3)

    def handle(df, k):
        seen.append(df.count())
        if not second:
            second.append(V.backfill(files(), lambda *_: seen.append(-1), str(tmp_path / "ck")))

    assert V.backfill(files(), handle, str(tmp_path / "ck")) and second == [False] and sum(seen) == 40 and len(seen) >= 3
    assert V.backfill(files(), handle, str(tmp_path / "ck")) and sum(seen) == 40


def test_ignore_rules(spark, tmp_path, rows):
    for name in ("a.py", "skip.py", "gen/x.py", "gen/keep.py", "sub/gen/y.py", "sub/z.py", "sub/deep/q.py", "tmp1.py", "lib/b.ts~", "lib/c.gen.ts", "lib/d.ts.bak"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1")
    (tmp_path / ".gitignore").write_text("# none\nskip.py\n/gen/*\n!/gen/keep.py\ntmp?.py\n\n")
    (tmp_path / "sub" / ".gitignore").write_text("deep/\n")
    assert rows(T.walk(spark, str(tmp_path)), "path") == [("a.py",), ("gen/keep.py",), ("sub/gen/y.py",), ("sub/z.py",)]
    assert re.search(T.ignore_pattern("**/a/*.ts")[0], "x/y/a/b.ts") and not re.search(T.ignore_pattern("a/*.ts")[0], "x/a/b.ts")


def test_changed_files(spark, tmp_path, rows):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@e", *a], check=True, capture_output=True)
    assert T.changed_files(spark, str(tmp_path)).count() == 0
    (tmp_path / "a.py").write_text("1")
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "first")
    (tmp_path / "a.py").write_text("2")
    (tmp_path / "ü b.py").write_text("3")
    assert rows(T.changed_files(spark, str(tmp_path))) == [("a.py",), ("ü b.py",)]


def test_scc_of_long_chains_and_cycles(spark, rows):
    chain, ring = [(k, k + 1) for k in range(1000)], [(5000 + k, 5000 + (k + 1) % 1000) for k in range(1000)]
    got = G.scc(frame(spark, chain + ring, "source long, target long"))
    assert got.count() == 1000 and {(r.scc, r.size) for r in got.collect()} == {(5000, 1000)}


def test_scc_by_rounds_equals_memory(spark, rows):
    rng = random.Random(4)
    e = frame(spark, [(rng.randrange(30), rng.randrange(30)) for _ in range(45)], "source long, target long")
    assert rows(G.scc(e, local_edges=0)) == rows(G.scc(e))


def test_confusable_pairs_against_all_pairs(spark):
    rng = random.Random(9)
    names = {"".join(rng.choice("abB1") for _ in range(rng.randrange(1, 9))) for _ in range(150)} | {"count", "count2", "userData", "userdata", "node", "nodes", "mode", "abcd", "abdc", "city", "cities"}
    df = frame(spark, [("s", n) for n in names], "scope string, name string")
    want = {(a, b) for a in names for b in names if a < b and R.py_confusable(a, b)}
    assert {(r.a, r.b) for r in R.confusable_pairs(df).collect()} == want


def test_mentions_and_batches(spark, rows):
    s = frame(spark, [(f"f{k}", "x\nname here\nname\nname") for k in range(5)], "path string, content string")
    assert rows(R.text_mentions(s, "name", 2, 3), "path", "line") == [(f"f{k}", n) for k in range(3) for n in (2, 3)]
    t = frame(spark, [(f"t{k % 700}",) for k in range(1400)], "text string")
    sizes = [r["count"] for r in R.cache_misses(t, t.limit(0).select(F.col("text").alias("cache_key")), "m", 8, 128).groupBy("batch").count().collect()]
    assert sum(sizes) == 700 and max(sizes) <= 128


def test_json_scalars(spark):
    df = frame(spark, [('say {bad} {"a": {"b": "}"}} {"c": 1}', '{"a":{"b":1}}', {"x": {"k": "1"}, "y": None, "z": {"l": "2"}}), (None, "[1]", None), ("none {", '{"a":3}', {})], "t string, j string, m map<string,map<string,string>>")
    got = df.select(S.first_json_object(F.col("t")), S.json_set(F.col("j"), "a.c", F.lit('"v"')), S.flatten_map(F.col("m"))).collect()
    assert [tuple(r) for r in got] == [('{"a": {"b": "}"}}', '{"a":{"b":1,"c":"v"}}', {"x.k": "1", "z.l": "2"}), (None, None, None), (None, None, {})]


def test_hot_and_span_hash(spark):
    df = frame(spark, [("a b\n\tc\nd",)], "t string").select(S.span_hash(F.split("t", "\n"), F.lit(1), F.lit(2)).alias("h"), S.is_hot(F.lit("2024-01-01 10:00:00"), F.lit("2024-01-02 09:00:00")).alias("y"), S.is_hot(F.lit("2024-01-01 10:00:00"), F.lit("2024-01-02 11:00:00")).alias("n"))
    assert tuple(df.first()) == (hashlib.sha1(b"abc").hexdigest(), True, False)


def test_file_changes_stream(spark, rows):
    c = frame(spark, [("a", 1, "added"), ("a", 2, "changed"), ("b", 1, "deleted")], "path string, time int, change string")
    assert rows(V.dedupe_changes(c), "path", "change") == [("a", "changed"), ("b", "deleted")]


def test_conditions(spark, rows):
    df = frame(spark, [(1, "x"), (5, "y"), (9, "x")], "n int, s string")
    assert rows(P.where_condition(df, "n > 3 && s == 'x' || n == 1"), "n") == [(1,), (9,)]
    with pytest.raises(KeyError):
        P.where_condition(df, "zz == 1")
    with pytest.raises(ValueError):
        P.where_condition(df, "__import__('os')")


def test_scalars(spark):
    df = frame(spark, [("a\\b/c.test.ts", "parseHTTPConfig_v2", "1.20.3")], "p string, n string, v string")
    r = df.select(
        S.norm_path(F.col("p")), S.basename(S.norm_path(F.col("p"))), S.file_kind(F.col("p")), S.name_tokens(F.col("n")),
        S.version_at_least(F.col("v"), 1, 18), S.version_at_least(F.col("v"), 2, 0), S.half_up(F.lit(2.5)), S.half_up(F.lit(-2.5)),
        S.parse_time(F.lit("2026-01-01T00:00:00Z")), S.parse_time(F.lit("nope")), S.strip_scope(F.lit("a.b.exit")), S.file_of(F.lit("f.ts#C.m")),
    ).first()
    assert list(r) == ["a/b/c.test.ts", "c.test.ts", "test", ["parse", "httpconfig", "v2"], True, False, 3, -2, 1767225600000, 0, "a.b", "f.ts"]


def test_resolution(spark, rows):
    refs = frame(spark, [(1, "f", "helper", "call"), (2, "f", "fs.read", "call"), (3, "f", "gone", "call"), (4, "f", "print", "call")], "ref_id int, file_path string, name string, kind string")
    imports = frame(spark, [("f", 1, "x"), ("f", 2, "b"), ("f", 3, "c")], "file_path string, ordinal int, target_file string")
    nodes = frame(spark, [("b", "helper", "b#helper"), ("c", "helper", "c#helper")], "file_path string, name string, id string")
    got = rows(J.resolve_in_order(refs, imports, nodes, ["print"], complete=False), "ref_id", "target", "status")
    assert got == [(1, "b#helper", "resolved"), (2, None, "external"), (3, None, "pending"), (4, None, "external")]


def test_health_of_nothing(spark):
    r = A.health_score(spark.createDataFrame([], "kind string"), spark.createDataFrame([], "path string")).first()
    assert (r.score, r.grade) == (0, "N/A")


def test_reopened_references(spark, rows):
    diffs = frame(spark, [(["C.load"], ["gone"], None)], "added array<string>, removed array<string>, changed array<string>")
    assert rows(J.changed_names(diffs)) == [("gone",), ("load",)]
    refs = frame(spark, [(1, "load", "failed"), (2, "gone", "failed"), (3, "gone", "resolved"), (4, "load", "external"), (5, "x", "resolved")], "id int, reference_name string, status string")
    nodes = frame(spark, [("load",), ("x",)], "name string")
    got = J.reopen_refs(refs, J.changed_names(diffs), nodes)
    assert rows(got, "id", "status", "reopened") == [(1, "pending", True), (2, "failed", False), (3, "pending", True), (4, "external", False), (5, "resolved", False)]


def test_demand_tile(spark, rows):
    e = frame(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("d", "e")], "source string, target string")
    seed = frame(spark, [("a",)], "node string")
    of = lambda d, n: (lambda t: (rows(t[0], "node"), t[1]))(G.demand_tile(e, seed, d, n))
    assert of(1, 9) == ([("a",), ("b",), ("c",)], "depth")
    assert of(9, 9)[1] == "complete" and len(of(9, 9)[0]) == 5
    assert of(9, 2) == ([("a",), ("b",)], "files")


def test_json_checks(spark):
    df = frame(spark, [('{"a": 1, "b": {"c": [5]}}',), ('{"a": "x"}',), ("{",), (None,), ("3",)], "t string")
    assert [r[0] for r in df.select(S.fits_schema(F.col("t"), "a int, b struct<c:array<int>>")).collect()] == [True, False, False, False, False]
    assert [r[0] for r in df.select(S.json_path(F.col("t"), "b.c[0]")).collect()] == ["5", None, None, None, None]


def test_enclosing_symbol(spark):
    spans = [("f", s, f"n{s}") for s in (5, 40, 41, 200, 1000)] + [("g", 10, "only")]
    points = [(f"{f}{n}", f, n) for f, n in [("f", 1), ("f", 5), ("f", 39), ("f", 41), ("f", 63), ("f", 64), ("f", 199), ("f", 500), ("f", 5000), ("g", 9), ("g", 900), ("h", 3)]]
    got = J.enclosing(frame(spark, points, "key string, file string, line int"), frame(spark, spans, "file string, start int, name string"))
    want = {k: max((s for g, s, _ in spans if g == f and s <= n), default=None) for k, f, n in points}
    assert {r.key: r.start for r in got.collect()} == want
