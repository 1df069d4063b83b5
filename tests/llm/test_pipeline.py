from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import queries
from lodestar.llm.scratch import Scratch
from tests.conftest import DATA
from tests.llm.fixtures import awkward, empty, words
from tests.llm.test_ngram_join import brute


def test_stages_on_awkward_rows(spark):
    for docs in (awkward(spark), empty(spark)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, DATA)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
                docs = Scratch(spark, "test").keep(out, "stage")
            else:
                assert out.count() == docs.count()


def test_near_stage_keeps_one_of_each_group(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    keep = Counter(d for d, _, c in brute(rows, 5, 80) if d == c)
    got = Counter(r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, DATA).collect())
    assert {k for k in got if k is not None} == {k for k in keep if k is not None}
    assert got[1] == 1 and got[None] == 2
    same = {tuple(r) for r in docs.collect()}
    assert all(tuple(r) in same for r in corpus_pipeline.dedup_near(spark, docs, DATA).collect())


def test_names_with_dots_pass_all_stages(spark):
    docs = awkward(spark).withColumn("a.b", F.lit(1)).withColumn("tick`s", F.lit("x"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            docs = Scratch(spark, "test").keep(out, "stage")
        else:
            assert out.count() == docs.count() > 0


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    """A near copy of id 3 goes although another text of its id stays."""
    one = words(3, 200)
    rows = [(3, one), (5, one + " more"), (5, words(4, 200)), (5, words(4, 200)), (6, words(4, 200) + " end"), (None, one)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.dedup_near(spark, docs, DATA).collect())
    assert got == [(0, one), (3, one), (5, words(4, 200))]


def test_whole_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) and 0.5 * docs.count() < len(ids) < docs.count()


def test_mixing_order_reaches_the_batches(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stored = Scratch(spark, "test").keep(corpus_pipeline.mix(spark, docs, DATA), "mixed")
    by_file = corpus_pipeline.pack(spark, stored, DATA).collect()
    order = {r.doc_id: k for k, r in enumerate(stored.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect())}
    for b in {r.bucket for r in by_file}:
        rows = sorted((r for r in by_file if r.bucket == b), key=lambda r: (r.batch, r.slot))
        assert [order[r.doc_id] for r in rows] == sorted(order[r.doc_id] for r in rows)


def test_names():
    assert [n for n in queries.QUERIES if n.startswith("op")] == list(queries.QUERIES) and len(queries.QUERIES) == 13
