"""Typed closure, observe points, dictionaries and structural rules on hand-seeded tables."""

import random
import re

from pyspark.sql import functions as F

from lodestar.operators import closure as C
from lodestar.operators import points as P
from lodestar.operators import rules as U


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_closure_knows_types_packages_and_resources(spark):
    files = frame(spark, [(p,) for p in ("a.ts", "b.ts", "t.ts", "u.ts", "v.ts", "caller.ts", "x/m.go", "x/n.go", "x/n_test.go", "y/o.go", "y/p.go", "z.go")], "path string")
    imports = frame(spark, [("a.ts", "b.ts", False), ("a.ts", "t.ts", True), ("t.ts", "u.ts", False), ("b.ts", "v.ts", None), ("caller.ts", "a.ts", False), ("x/m.go", "y/o.go", False)], "source string, target string, type_only boolean")
    seeds = lambda *p: frame(spark, [(x,) for x in p], "path string")
    got = {r.file: (r.depth, r.parent, r.runtime) for r in C.import_closure(imports, files, seeds("a.ts", "gone.ts")).collect()}
    # What only a type leads to is in the closure, but never loaded, nor is what it imports.
    assert got == {"a.ts": (0, None, True), "b.ts": (1, "a.ts", True), "t.ts": (1, "a.ts", False), "u.ts": (2, "t.ts", False), "v.ts": (2, "b.ts", True)}
    got = {r.file: r.depth for r in C.import_closure(imports, files, seeds("x/m.go")).collect()}
    assert got == {"x/m.go": 0, "x/n.go": 1, "y/o.go": 1, "y/p.go": 2}
    assert {r.file: r.depth for r in C.import_closure(imports, files, seeds("x/m.go"), max_depth=1).collect()} == {"x/m.go": 0, "x/n.go": 1, "y/o.go": 1}
    assert {r.file: r.runtime for r in C.import_closure(imports, files, seeds("b.ts"), callers=True).collect()}["caller.ts"] is False
    code = frame(spark, [("x/n.go", 'package x\n//go:embed "data/*.bin" all:tmpl\nvar f embed.FS\n//go:embed a?.txt'), ("z.go", "//go:embed *"), ("a.ts", "//go:embed q")], "path string, content string")
    resources = frame(spark, [(p,) for p in ("x/data/a.bin", "x/data/deep/b.bin", "x/tmpl/one/two.html", "x/ab.txt", "x/abc.txt", "data/c.bin", "y/ab.txt")], "path string")
    got = C.import_closure(imports, files, seeds("x/m.go"), embeds=C.embedded(code), resources=resources).where("resource").collect()
    assert {(r.file, r.depth, r.parent, r.runtime) for r in got} == {(p, 1, "x/n.go", True) for p in ("x/data/a.bin", "x/tmpl/one/two.html", "x/ab.txt")}


def plain_closure(imports, files, seeds, value):
    folder = lambda p: p.rpartition("/")[0]
    seen, at, depth = dict.fromkeys(seeds, 0), set(seeds), 0
    while at:
        depth += 1
        new = {t for s, t, type_only in imports if s in at and not (value and type_only)}
        new |= {f for f in files for a in at if a.endswith(".go") and f.endswith(".go") and folder(f) == folder(a)}
        at = new - seen.keys()
        seen |= dict.fromkeys(at, depth)
    return seen


def test_closure_on_a_random_graph(spark):
    rng = random.Random(4)
    files = [f"d{rng.randrange(4)}/f{k}.{rng.choice(['go', 'ts'])}" for k in range(30)]
    imports = [(rng.choice(files), rng.choice(files), rng.random() < 0.4) for _ in range(25)]
    seeds = rng.sample(files, 2)
    got = C.import_closure(frame(spark, imports, "source string, target string, type_only boolean"), frame(spark, [(f,) for f in files], "path string"), frame(spark, [(s,) for s in seeds], "path string")).collect()
    assert {r.file: r.depth for r in got} == plain_closure(imports, files, seeds, False)
    assert {r.file for r in got if r.runtime} == set(plain_closure(imports, files, seeds, True))


def test_sites_have_their_lines_and_spans(spark):
    rng = random.Random(5)
    texts = [("\n" * rng.randrange(3)).join(rng.choice(["rm(", "x", "try {", "} catch (e) {}", "} catch {\n log(1)\n}", "spawn  (", "arm(", "\n"]) for _ in range(rng.randrange(60))) for _ in range(30)]
    files = frame(spark, [(f"f{k}", t) for k, t in enumerate(texts)], "path string, content string")
    for pattern in (r"\b(rm|spawn)\s*\(", P.CATCH):
        want = {(f"f{k}", t[: m.start()].count("\n") + 1, t[: m.end()].count("\n") + 1, m[1]) for k, t in enumerate(texts) for m in re.finditer(pattern, t)}
        assert {tuple(r) for r in P.sites(files, pattern).collect()} == want
    spans = [(f"s{i}", f"f{rng.randrange(5)}", a, a + rng.randrange(900)) for i in range(60) for a in [rng.randrange(1, 900)]]
    dots = [(f"f{rng.randrange(5)}", a, a + rng.randrange(3), str(i)) for i in range(80) for a in [rng.randrange(1, 900)]]
    got = P.stab(frame(spark, spans, "id string, file string, start int, end int"), frame(spark, dots, "file string, first int, last int, value string"))
    assert sorted((r.id, r.value) for r in got.collect()) == sorted((i, v) for i, f, s, e in spans for g, a, b, v in dots if f == g and s <= a and b <= e)


def test_observe_points_keep_their_evidence(spark):
    body = ["x"] * 60
    body[2], body[5], body[6], body[50] = "writeFile(a)", "try {} catch (e) {", "}", "try {} catch (e) { throw e }"
    files = frame(spark, [("a.ts", "\n".join(body), 1000), ("b.ts", "y", 10)], "path string, content string, modified_at long")
    nodes = frame(spark, [("a#f", "function", "f", "f", "a.ts", 1, 45, False), ("a#g", "function", "g", "K.g", "a.ts", 46, 60, None), ("a#h", "function", "h", "h", "a.ts", 1, 9, True), ("a", "file", "a", "a", "a.ts", 1, 60, False), ("b#q", "function", "q", "q", "b.ts", 1, 1, False)], "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, is_closure boolean")
    calls = frame(spark, [("x", "a#g", "call")] * 12 + [("x", "b#q", "use")], "source string, target string, kind string")
    changed = frame(spark, [("K.g",), ("K.g",)], "qualified_name string")
    got = {r.id: r for r in P.observe_points(nodes, calls, files, changed, 1000 + P.HOT_MS - 1, focus="k\\.").collect()}
    assert got.keys() == {"a#f", "a#g"}
    assert (got["a#f"].score, got["a#f"].focus) == (0.5, False) and [(e.signal, e.detail, e.weight) for e in got["a#f"].evidence] == [("size", "45 lines", 0.1), ("hot_file", "modified within a day", 0.05), ("io", "writeFile", 0.2), ("silent_catch", "1 catch blocks", 0.15)]
    assert (got["a#g"].score, got["a#g"].focus) == (0.8, True) and [(e.signal, e.weight) for e in got["a#g"].evidence] == [("called", 0.3), ("changed", 0.2), ("hot_file", 0.05)]
    best = P.recommend(P.observe_points(nodes, calls, files, changed, 0), 1).collect()
    assert [r.id for r in best] == ["a#g"] and P.recommend(P.observe_points(nodes, calls, files, changed, 10**15, focus_paths=["b"]), 9).count() == 2


def plain_splits(text, terms):
    """All places of all terms, then overlapping ones merged from the left, the longer first."""
    low, spans = "".join(c.lower() if len(c.lower()) == 1 else c for c in text), []
    for name, form in terms:
        at = low.find(form.lower())
        while at >= 0:
            spans.append((at, -(at + len(form)), name))
            at = low.find(form.lower(), at + 1)
    out = []
    for start, end, name in sorted(spans):
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], -end)
        else:
            out.append([start, -end, name])
    return [tuple(x) for x in out]


def test_dictionary_splits(spark, monkeypatch):
    rng = random.Random(9)
    terms = [("cat", "cat"), ("cat", "feline"), ("category", "category"), ("at", "AT"), ("s p", "s p"), ("é", "é"), ("gory x", "gory x")]
    texts = [(k, "".join(rng.choice(["cat", "egory", " x", "AT", "é", "s p", "felin", "e", " ", "İ"]) for _ in range(rng.randrange(30)))) for k in range(60)] + [(100, None), (101, "")]
    t, d = frame(spark, texts, "id long, text string"), frame(spark, terms + [("none", ""), ("none", None)], "term string, form string")
    for chars in (U.PART_CHARS, 8):  # one automaton, and one for each part of the dictionary
        monkeypatch.setattr(U, "PART_CHARS", chars)
        got = {}
        for r in U.dictionary_splits(t, d).collect():
            got.setdefault(r.id, []).append((r.start, r.end, r.term))
        assert {k: sorted(v) for k, v in got.items()} == {k: s for k, x in texts if x and (s := plain_splits(x, terms))}
    assert U.dictionary_splits(t, d.limit(0)).count() == 0


def test_rules_match_tokens():
    def hits(text, pattern):
        return [(m.text, m.holes) for m in U.match_tokens(text, pattern)]

    assert hits("a = foo( b , c )\nfoo(d)", "foo($x)") == [("foo( b , c )", {"x": "b , c"}), ("foo(d)", {"x": "d"})]
    # A hole holds brackets and lines, but never half a bracket.
    assert hits("f(g(1,\n  [2, 3]), 4)", "f($a, $b)") == [("f(g(1,\n  [2, 3]), 4)", {"a": "g(1,\n  [2, 3])", "b": "4"})]
    assert hits("f(a), b)", "f($x, $y)") == []
    assert hits("x = x + 1; y = z + 1", "$v = $v + 1") == [("x = x + 1", {"v": "x"})]
    assert hits("if (a) { b(); c() }", "if ($c) { ... }") == [("if (a) { b(); c() }", {"c": "a"})]
    assert hits("if(a){}", "if ($c) { ... }") == [("if(a){}", {"c": "a"})]
    # The longest match of the first place counts, and matches do not overlap.
    assert hits("a.b.c()", "$x.c") == [("a.b.c", {"x": "a.b"})] and hits("k k k", "k ... k") == [("k k k", {})]
    assert hits("s = 'f(x)' + f(y)", "f($x)") == [("f(y)", {"x": "y"})]
    assert U.match_tokens("", "a") == [] and U.match_tokens("a", "") == []
    big = "f(" * 300 + "x" + ")" * 300
    assert len(U.match_tokens(big, "f($x)")) == 1


def test_rules_against_a_plain_search():
    """All splits of all starts, on random tokens with stray brackets."""

    def plain(words, want, start):
        out = []

        def whole(i, j):
            held = []
            for w in words[i:j]:
                if w in "([":
                    held.append(w)
                elif w in ")]" and (not held or held.pop() != {")": "(", "]": "["}[w]):
                    return False
            return not held

        def go(i, k, holes):
            if k == len(want):
                out.append((i, holes))
                return
            kind, value = want[k]
            if kind == "word":
                if i < len(words) and words[i] == value:
                    go(i + 1, k + 1, holes)
            elif value in holes and kind == "hole":
                if words[i : i + len(holes[value])] == holes[value]:
                    go(i + len(holes[value]), k + 1, holes)
            else:
                last = k + 1 == len(want) and kind == "hole"
                for j in range(i + (kind == "hole"), len(words) + 1):
                    if whole(i, j):
                        go(j, k + 1, holes if kind == "rest" else {**holes, value: words[i:j]})
                        if last:
                            break

        go(start, 0, {})
        return max((e for e, _ in out), default=None)

    rng = random.Random(11)
    for _ in range(1500):
        words = [rng.choice("aab=()[]") for _ in range(rng.randrange(1, 14))]
        pattern = [rng.choice(["a", "b", "=", "(", ")", "$x", "$y", "..."]) for _ in range(rng.randrange(1, 6))]
        want, at, spans = U._parts(" ".join(pattern)), 0, []
        while at < len(words):
            end = plain(words, want, at)
            if end is not None and end > at:
                spans.append(" ".join(words[at:end]))
                at = end
            else:
                at += 1
        assert [m.text for m in U.match_tokens(" ".join(words), " ".join(pattern))] == spans, (words, pattern)


def test_rules_over_files(spark):
    files = frame(spark, [("a", "x\nlog(e, {\n a: 1 })\nlog(e)"), ("b", "log ( e )"), ("c", None), ("d", "nothing")], "path string, content string")
    got = U.match_rules(files, {"one": "log($x)", "two": "log($x, $y)"}).collect()
    assert sorted((r.rule, r.path, r.line, r.end_line, r.holes["x"]) for r in got) == [("one", "a", 2, 3, "e, {\n a: 1 }"), ("one", "a", 4, 4, "e"), ("one", "b", 1, 1, "e"), ("two", "a", 2, 3, "e")]
    assert U.windows({"one": "log($x)"}) == {"one": ["(", ")", "log"]}


def test_rules_cut_tokens_only_as_far_as_a_match_can_reach(spark):
    """Plain words after the last match are not cut into tokens, brackets are; content is computed once for all rules."""
    code = "a = a + 1; log(b)"
    tokens = U._Tokens(code + " word" * 1000, U._bound(code, "log($x)"))
    assert len(tokens.words) == 10
    assert [m.text for m in U.match_tokens("f(x [ y) z" + " w" * 9, "f($x)")] == [] == U.match_tokens("{ f(x) ) w", "{ $x }")
    assert [m.text for m in U.match_tokens("f(x [ y) z ] )", "f($x)")] == []
    files = spark.createDataFrame([("p", code), ("n", None), ("e", "")], "path string, text string").select("path", F.regexp_replace("text", "b", "c").alias("content"))
    found = U.match_rules(files, {"log": "log($x)", "same": "$x = $x + 1"})
    assert found._jdf.queryExecution().executedPlan().toString().count("regexp_replace") == 1
    assert sorted((r["rule"], r.path, r.holes["x"]) for r in found.collect()) == [("log", "p", "c"), ("same", "p", "a")]
