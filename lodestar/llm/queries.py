"""Queries of the training-data operators: thin digests of the operators' outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import block_naming, centroids, language, line_windows, mixing, ngram_join, packing, permutation_index, png_column, secrets, token_files, toxicity, whitening

END_ID = 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(of: str, by: int, is_: int) -> Column:
    """Whether the remainder is that; false for a null id, whose row is never learned from either."""
    return F.coalesce(_remainder(of, by) == is_, F.lit(False)).alias("held_out")


def _remainder(of: str, by: int) -> Column:
    return F.pmod(F.crc32(F.col(of).cast("string").cast("binary")), F.lit(by))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), _remainder("id", 3) != 1)
    found = toxicity.toxicity(docs, model)
    return found.select("doc_id", _held_out("doc_id", 3, 1), "score", "predicted", F.size("offending").alias("n_offending"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_scan(_table(spark, sf_dir, "documents")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs, smoothing=0.7)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard(_table(spark, sf_dir, "documents"), width=4, pct=85)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_windows.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = png_column.text_to_png(_table(spark, sf_dir, "documents"))
    # No text is longer than this, so none is left unread.
    return png_column.png_features(media, max_bytes=1 << 32).drop("error")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.language_id(docs, language.fit(docs, _remainder("doc_id", 5) != 0))
    return found.select("doc_id", _held_out("doc_id", 5, 0), "lang_pred", "score")


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return permutation_index.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(_table(spark, sf_dir, "embeddings")))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(_table(spark, sf_dir, "embeddings")))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_groups(_table(spark, sf_dir, "documents")).drop("level", "name")


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_secret_scan, op3_packing, op4_mixing, op5_ngram_join,
        op6_line_dedup, op7_png_media, op8_token_files, op9_language_id, op10_permutation_index,
        op11_whitening, op12_centroids, op13_exact_dedup,
    )
}
ORACLE: dict[str, str] = {"op3_packing": packing.SQL, "op6_line_dedup": line_windows.SQL, "op12_centroids": centroids.SQL, "op13_exact_dedup": block_naming.SQL}
