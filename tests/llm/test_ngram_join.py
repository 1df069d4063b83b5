import random
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import kernels as K
from lodestar.llm import ngram_join
from lodestar.llm.ngram_join import ngram_jaccard
from tests.llm.fixtures import awkward, empty, words


def shingles(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def brute(rows, width, pct):
    """Component of each (id, text) by all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= pct * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(ids.get(root(i), d), d)
    return Counter((d, len(s), ids.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("width,pct", [(4, 85), (5, 80), (2, 50)])
def test_against_all_pairs(spark, width, pct):
    r = random.Random(width)
    rows = []
    for g in range(12):
        base = words(g, r.randrange(3, 80)).split()
        for _ in range(r.randrange(1, 9)):
            t = list(base)
            for _ in range(r.randrange(0, 5)):
                t[r.randrange(len(t))] = f"edit{r.randrange(9)}"
            rows.append((len(rows), " ".join(t)))
    rows += [(900 + k, t) for k, t in enumerate([None, "", " \t", "one", "ONE", "one two", rows[0][1]])]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(x) for x in ngram_jaccard(df, width=width, pct=pct).collect()) == brute(rows, width, pct)


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert Counter(tuple(x) for x in ngram_jaccard(df).collect()) == brute(rows, 5, 80)
    assert ngram_jaccard(empty(spark)).collect() == []


def test_large_group_of_copies(spark):
    base = words(5, 60).split()
    rows = [(i, " ".join([*base[:-1], f"z{i % 150}"])) for i in range(600)]
    got = ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 600


def test_rows_without_id_link_and_bridge(spark, monkeypatch):
    """Null ids next to near copies, as the only link of two others, and among themselves."""
    a = words(1, 40).split()
    b = [*a[:39], "one"]
    c = ["two", *b[1:]]
    lone, pair = words(2, 30), words(3, 30)
    rows = [(1, " ".join(a)), (None, " ".join(b)), (2, " ".join(c)), (None, lone), (None, pair), (None, pair + " more"), (7, words(4, 9)), (7, words(5, 9)), (None, None), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # The bridge alone joins 1 and 2.
    assert brute([rows[0], rows[2]], 5, 90)[(2, 36, 2)] == 1
    for hot in (ngram_join.HOT, -1e9):  # all shingles hot: the salted way
        monkeypatch.setattr(ngram_join, "HOT", hot)
        got = Counter(tuple(x) for x in ngram_jaccard(df, width=5, pct=90).collect())
        assert got == brute(rows, 5, 90)
        assert got[(2, 36, 1)] == 1 and got[(None, 36, 1)] == 1


def test_unlinked_texts_that_share_prefixes(spark, monkeypatch):
    """A group whose texts share their rarest shingles and mostly stay below the threshold."""
    r = random.Random(3)
    common = words(1, 30)
    rows = [(i if i % 7 else None, common + " " + " ".join(words(100 + r.randrange(25), 4) for _ in range(3))) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (ngram_join.HOT, -1e9):
        monkeypatch.setattr(ngram_join, "HOT", hot)
        assert Counter(tuple(x) for x in ngram_jaccard(df, width=3, pct=60).collect()) == brute(rows, 3, 60)


def test_shingles_are_those_of_the_definition():
    texts = ["A b\x0bc d e", "x", None, "a a a a a a a", "é b c d e f", "q" * 5000]
    values, o = K.shingle_sets(texts, 3)
    assert list(np.diff(o)) == [len(shingles(t, 3)) for t in texts]
    same, o2 = K.shingle_sets(["a B C d E"], 3)
    assert set(same) == set(values[o[0] : o[1]])
