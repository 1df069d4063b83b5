"""From documents to training batches: five stages, each a table for the next one.

Toxic documents go; lines of passages that repeat go; of each group of near copies one
document stays; sources are interleaved to their target weights; what is left is
packed into batches.  A stage's function takes (spark, docs, sf_dir) and returns a
DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import line_windows, mixing, ngram_join, packing, toxicity
from lodestar.llm.scratch import Scratch, quoted


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model, trained on the labelled ones, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows.

    A document that loses its whole text this way, as a copy does, goes.
    """
    found = line_windows.line_dedup(docs)
    kept = found.where((F.col("n_lines_removed") == 0) | F.col("text").rlike(r"\S"))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*map(quoted, docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies.

    Documents are told apart by id and text: repeated rows stay once, and of several
    texts of one id just those that stand for their group.  Documents without id stay.
    """
    groups = ngram_join.ngram_jaccard(docs, width=5, pct=80, keep_hash=True)
    first = groups.where("component_id = doc_id").select(F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_hash")).distinct()
    # Packed in one column, the documents' own columns cannot clash with those made here.
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.struct("*").alias("row"))
    # Repeats are dropped where they lie before they meet.
    kept = rows.join(first, F.expr("doc_id = first_id and h = first_hash"), "left_semi").dropDuplicates(["doc_id", "h"]).select("row.*")
    return kept.union(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, interleaved; their order is that of the files and rows written."""
    return mixing.in_order(mixing.mix_sources(docs, smoothing=0.7)).select(*map(quoted, docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches in optimal length buckets; rows enter a bucket in the order of the files."""
    part = F.expr("try_cast(regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1) as long)")
    try:
        placed = docs.withColumns({"at_part": part, "at_row": F.col("_metadata.row_index")})
    except AnalysisException:  # not read from files: by id
        return packing.pack(docs)
    return packing.pack(placed, order=["at_part", "at_row"])


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_near),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``, each stored and reread for the next."""
    box = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = box.keep(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Training and the schedule are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None
