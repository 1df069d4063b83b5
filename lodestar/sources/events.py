"""Event logs, ledgers, documents and manifests as tables (SRC-3 to SRC-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.model import LEDGER, MANIFEST


def parse_lines(lines: DataFrame) -> DataFrame:
    """SRC-3: JSON lines (value) as events; ``bad`` marks lines that are no JSON object.

    ``fields`` stays JSON text, as its keys are open.
    """
    v = F.try_parse_json("value")
    get = lambda p, t: F.try_variant_get(v, p, t)
    return lines.select(
        get("$.probe", "string").alias("probe"),
        F.try_to_timestamp(get("$.time", "string")).alias("time"),
        get("$.source", "string").alias("source"),
        F.get_json_object("value", "$.fields").alias("fields"),
        get("$.fields.err", "string").alias("err"),
        get("$.fields.op", "string").alias("op"),
        get("$.fields.file", "string").alias("file"),
        F.coalesce(get("$.fields.benign", "boolean"), F.lit(False)).alias("benign"),
        get("$.trace_id", "string").alias("trace_id"),
        get("$.frame_id", "long").alias("frame_id"),
        get("$.parent_id", "long").alias("parent_id"),
        (v.isNull() | get("$.probe", "string").isNull()).alias("bad"),
    )


def load_events(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """SRC-3, SRC-4: (events, one row of skipped lines) of all files under ``paths`` (globs)."""
    lines = parse_lines(spark.read.text(paths).where(F.trim("value") != ""))
    return lines.where("not bad").drop("bad"), lines.agg(F.count_if("bad").alias("skipped"))


def event_files(spark: SparkSession, folders: list[str]) -> list[str]:
    """SRC-4: paths of events*.jsonl in the folders, sorted; folders that are missing have none."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    out = []
    for folder in folders:
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/events*.jsonl")
        found = p.getFileSystem(conf).globStatus(p)
        out += [s.getPath().toString() for s in found or []]
    return sorted(out)


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: entries of ledger files; a corrupt file has none."""
    doc = spark.read.schema(f"entries array<struct<{', '.join(f'{c.strip().split()[0]}:{c.strip().split()[1]}' for c in LEDGER.split(', '))}>>, _corrupt string")
    doc = doc.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return doc.where("_corrupt is null").select(F.inline("entries"))


def load_documents(spark: SparkSession, root: str, schema: str, view: str = "design") -> DataFrame:
    """SRC-5: documents of a view at root/FEATURE/VIEW.json, with their feature."""
    docs = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/{view}.json")
    return docs.withColumn("feature", F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+\.json$", 1))


def read_documents(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """SRC-5: all documents that ``save_documents`` holds, with their feature and view."""
    return spark.read.schema(schema + ", feature string, view string").json(root)


def save_documents(docs: DataFrame, root: str) -> None:
    """SRC-5: documents (feature, view, ...) as JSON, partitioned by both."""
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature", "view").json(root)


def load_manifests(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """SRC-6: (manifests, one row of corrupt ones) of root/*/manifest.json."""
    raw = spark.read.schema(MANIFEST + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(f"{root}/*/manifest.json")
    return raw.where("_corrupt is null").drop("_corrupt"), raw.agg(F.count(F.when(F.col("_corrupt").isNotNull(), F.coalesce("name", F.lit("")))).alias("corrupt"))


def sink_events(events: DataFrame, path: str, checkpoint: str):
    """SNK-5: a stream of events appended as JSON by day; see ``store.append_ring`` for retention by size."""
    dated = events.withColumn("day", F.to_date("time"))
    return dated.writeStream.format("json").partitionBy("day").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
