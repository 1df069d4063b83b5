"""Exact deduplication by block names against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import block_naming
from tests.llm.fixtures import SCHEMA, awkward, empty, words


def brute(rows):
    """(id, keep_id, group_size, kept, sha) of all rows, by the normalised texts themselves."""
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((d is None, d or 0, i, d))
    out = []
    for t, held in groups.items():
        first = min(held)
        out += [(d, first[3], len(held), i == first[2], hashlib.sha256(t.encode()).hexdigest()) for _, _, i, d in held]
    return sorted(out, key=repr)


def found(docs, **how):
    got = block_naming.exact_groups(docs, **how)
    return sorted((tuple(r) for r in got.drop("level", "name").collect()), key=repr)


@pytest.mark.parametrize("block", [64, 16_384])
def test_awkward_rows(spark, block):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(docs, block=block) == brute(rows)
    assert found(empty(spark), block=block) == []


def test_texts_that_share_all_but_little(spark):
    """Prefixes, equal halves, other orders of blocks and lengths that differ by a block or a byte."""
    a, b, c = ("".join(random.Random(k).choice("xy") for _ in range(8)) for k in range(3))
    texts = [a, a + b, b + a, a + b + c, a + c + b, a + b + a + b, a + b + a, a + b + c + a, a * 4, a * 5, a * 8, a * 9, (a + b) * 3, "", " ", "  ", a[:-1], a + "z", a + b, "\t", a * 8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert found(docs, block=8) == brute(list(enumerate(texts)))


def test_names_tell_levels_apart(spark):
    texts = [words(k % 6, 5 + 40 * (k % 6)) for k in range(18)]
    got = block_naming.exact_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=32).collect()
    assert len({(r.level, r.name) for r in got}) == 6 and all(r.group_size == 3 for r in got)


def test_clashing_keys_are_found_and_replaced(spark, monkeypatch):
    """Hashes that do not tell the blocks apart are noticed over all blocks and never decide."""
    real, seeds = block_naming._keys, []

    def weak(block, seed):
        seeds.append(seed)
        return [F.length(block).cast("long").alias("h1"), F.lit(seed).cast("long").alias("h2")] if seed < 2 else real(block, seed)

    monkeypatch.setattr(block_naming, "_keys", weak)
    docs = awkward(spark).where("doc_id is null or doc_id <> 10")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(docs, block=50) == brute(rows) and max(seeds) == 2


def test_no_python_on_the_main_path(spark):
    plan = block_naming.exact_groups(awkward(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" not in plan


def test_a_group_that_holds_most_rows(spark):
    rows = [(k, "one text  of all" if k % 3 else words(k, 6), None, None, None, 1, 1, 1, 1, "w", "m") for k in range(3000)]
    got = block_naming.exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert got.where("kept").count() == 1001 and got.agg(F.max("group_size")).first()[0] == 2000
    assert got.where("group_size = 2000 and keep_id = 1").count() == 2000
