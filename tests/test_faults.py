"""Cases that once gave wrong rows or work that grew with the square."""

import random

from pyspark.sql import functions as F

from lodestar.operators import observe as O
from lodestar.operators import search as R
from lodestar.sources import tree as T


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_nothing_below_an_ignored_folder_comes_back(spark, tmp_path):
    rules = [x for line in "lib/\n!lib/keep.ts\n/gen/*\n!/gen/keep.py\n*.log\nbuild\n!a.log".split("\n") if (x := T.ignore_pattern(line))]
    paths = ["lib/keep.ts", "gen/keep.py", "gen/x.py", "x/b.log", "x/build/c.ts", "gen/sub/x.py", "x/lib/deep/y.ts", "a.log", "src/a.ts", "libs/a.ts"]
    assert [p for p in paths if not T.ignored_by(rules, p)] == ["gen/keep.py", "a.log", "src/a.ts", "libs/a.ts"]
    for p in ("lib/keep.ts", "src/a.ts", "src/skip.ts"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    (tmp_path / ".gitignore").write_text("lib/\n!lib/keep.ts\n" + "\n".join(f"none{k}.ts" for k in range(2000)) + "\nskip.ts")
    assert [r.path for r in T.walk(spark, str(tmp_path)).collect()] == ["src/a.ts"]


def test_incidents_hold_the_last_events_of_their_trace(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50), k, f"p{k}", "E" if rng.random() < 0.1 else None, False, None) for k in range(400)]
    e = frame(spark, rows, "trace_id string, time long, seq long, probe string, err string, benign boolean, op string")
    for last in (1, 7, 50):
        got = {r.seq: [x.seq for x in r.window] for r in O.incidents(e, last).collect()}
        want = {}
        for t in ("a", "b", None):
            mine = sorted((r[1], r[2]) for r in rows if r[0] == t)
            want |= {s: [x for _, x in mine[max(0, k + 1 - last) : k + 1]] for k, (_, s) in enumerate(mine)}
        errors = {r.seq for r in e.where(O.silent_error()).select("seq").collect()}
        assert got == {s: w for s, w in want.items() if s in errors} and got


def test_near_names_against_all_pairs(spark):
    rng = random.Random(3)
    names = [(s, "".join(rng.choice("ab_c") for _ in range(rng.randrange(0, 9)))) for s in ("x", "y") for _ in range(60)]
    n = frame(spark, names + [("x", None)], "scope string, name string")
    a, b = n.distinct().toDF("scope", "a"), n.distinct().toDF("scope", "b")
    want = a.join(b, "scope").where("a < b").withColumn("distance", F.levenshtein("a", "b").cast("long")).where("distance <= 2")
    assert sorted(map(tuple, R.near_names(n).collect())) == sorted(map(tuple, want.collect()))


def test_trees_differ_by_the_names_git_gives(spark):
    f = frame(spark, [("a", ""), ("b", "hello\n"), ("c", None)], "path string, content string")
    assert [r[0] for r in f.select(T.blob_hash(F.col("content"))).collect()] == ["e69de29bb2d1d6434b8b29ae775ad8c2e48c5391", "ce013625030ba8dba906f756967f9e9ca394464a", None]
    after = frame(spark, [("a", ""), ("b", "hello"), ("d", "")], "path string, content string")
    assert sorted(map(tuple, T.tree_diff(f.where("path <> 'c'"), after).collect())) == [("b", "modified"), ("d", "added")]
