"""Snapshot tables: upserts, replacement by file, cascades (SNK-1 to SNK-6, STR-2 to STR-4)."""

from __future__ import annotations

import tempfile
import time
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.model import EDGE_KEY


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one is set only on one machine that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and reread; the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex[:12]}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def upsert(table: DataFrame, rows: DataFrame, key: str | list[str], order: str | None = None) -> DataFrame:
    """SNK-1: the table with ``rows`` in place of those of equal key.

    Of rows with one key the last by ``order`` stays, by default the last as they come.
    Null keys are equal to each other.
    """
    keys = [key] if isinstance(key, str) else key
    numbered = rows.select(F.struct(*rows.columns).alias("row"), (F.col(order) if order else F.monotonically_increasing_id()).alias("at"))
    fresh = numbered.groupBy(*[F.col("row")[k].alias(k) for k in keys]).agg(F.max_by("row", "at").alias("row")).select("row.*")
    taken = fresh.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)])
    same = [table[k].eqNullSafe(taken[f"_key{i}"]) for i, k in enumerate(keys)]
    return table.join(taken, reduce(and_, same), "left_anti").unionByName(fresh, allowMissingColumns=True)


def replace_files(table: DataFrame, rows: DataFrame, changed: DataFrame, path: str = "file_path") -> DataFrame:
    """SNK-2: all rows of the changed files (path) give way to ``rows``."""
    return table.join(changed.select(path).distinct(), path, "left_anti").select(table.columns).unionByName(rows)


def insert_edges(table: DataFrame, rows: DataFrame) -> DataFrame:
    """SNK-3: new edges that are not there yet; null lines and columns count as equal."""
    key = [F.coalesce(c, F.lit(-1)).alias(f"k{i}") if c in ("line", "col") else F.col(c).alias(f"k{i}") for i, c in enumerate(EDGE_KEY)]
    names = [f"k{i}" for i in range(len(EDGE_KEY))]
    fresh = rows.select("*", *key).dropDuplicates(names).join(table.select(*key), names, "left_anti")
    return table.unionByName(fresh.select(rows.columns), allowMissingColumns=True)


def remove_file(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-4: nodes without those of ``files`` (path), and edges whose ends both remain."""
    left = nodes.join(files.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti").select(nodes.columns)
    ids = left.select("id")
    kept = edges.join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi")
    return left, kept.select(edges.columns)


def append_usage(rows: DataFrame, path: str) -> None:
    """SNK-6: appends usage rows as JSON lines."""
    rows.write.mode("append").json(path)


def _files(spark: SparkSession, path: str):
    """Hadoop's view of a path: its file system, the path, and a maker of paths."""
    make = lambda *p: spark._jvm.org.apache.hadoop.fs.Path(*p)
    root = make(path)
    return root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), root, make


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file to any store that Spark reaches."""
    fs, target, _ = _files(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; null where there is none."""
    fs, target, _ = _files(spark, path)
    if not fs.exists(target):
        return None
    found = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(found)).decode()
    finally:
        found.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file in one step; False if it is there already."""
    fs, target, make = _files(spark, path)
    fs.mkdirs(target.getParent())
    draft = make(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex[:12]}")
    put_text(spark, draft.toString(), text)
    try:
        _rename(spark, draft, target, overwrite=False)
    except Exception as e:  # the class of the exception is the store's
        if fs.exists(target):
            return False
        raise e
    finally:
        fs.delete(draft, False)
    return True


def _rename(spark: SparkSession, source, target, overwrite: bool) -> None:
    jvm = spark._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(target.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    how = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    how[0] = jvm.Options.Rename.OVERWRITE if overwrite else jvm.Options.Rename.NONE
    context.rename(source, target, how)


class Lease:
    """A right that one run holds at a time, and loses if it does not renew it.

    Holders are numbered: each has a file ``<path>-<number>`` with the time up to which it
    holds, made only by the first who asks for that number.  A run that dies leaves a
    file whose time passes; then the next number may be taken.
    """

    def __init__(self, spark: SparkSession, path: str, lease_s: float = 600.0):
        self.spark, self.path, self.lease_s, self.number = spark, path, lease_s, None

    def _last(self) -> int:
        fs, own, _ = _files(self.spark, self.path)
        if not fs.exists(own.getParent()):
            return 0
        head = own.getName() + "-"
        names = [s.getPath().getName() for s in fs.listStatus(own.getParent())]
        return max((int(n[len(head) :]) for n in names if n.startswith(head) and n[len(head) :].isdigit()), default=0)

    def take(self) -> bool:
        last = self._last()
        if last and float(get_text(self.spark, f"{self.path}-{last}") or "inf") > time.time():
            return False
        if not put_if_absent(self.spark, f"{self.path}-{last + 1}", repr(time.time() + self.lease_s)):
            return False
        self.number = last + 1
        fs, _, make = _files(self.spark, self.path)
        for k in range(max(1, last - 3), last):  # a taken-over file stays for the run that lost it to see
            fs.delete(make(f"{self.path}-{k}"), False)
        return True

    def renew(self) -> None:
        """Holds on; raises if another run has taken over."""
        if self.number is None or self._last() != self.number:
            raise RuntimeError(f"{self.path} was taken over")
        self._write(time.time() + self.lease_s)

    def release(self) -> None:
        if self.number is not None and self._last() == self.number:
            self._write(0.0)
        self.number = None

    def _write(self, until: float) -> None:
        fs, target, make = _files(self.spark, f"{self.path}-{self.number}")
        draft = make(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex[:12]}")
        put_text(self.spark, draft.toString(), repr(until))
        _rename(self.spark, draft, target, overwrite=True)


def _slots(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(number, bytes) of the slots of a log, oldest first."""
    fs, root, _ = _files(spark, path)
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("slot=")]
    return sorted((int(p.getName()[5:]), fs.getContentSummary(p).getLength()) for p in found)


def append_ring(events: DataFrame, path: str, deviates: Column | None = None, slot_bytes: int = 64 << 20, keep: int = 6) -> list[int]:
    """SNK-5: appends events as JSON lines to the newest slot of a ring; returns the slots recycled.

    A slot of ``slot_bytes`` or more is full, and the next append opens a new one.  Beyond
    ``keep`` slots the oldest go, but first those of their events that ``deviates`` marks
    are written to the log's deviations, under the slot's number, so that a run which
    died before the slot went writes them anew and not twice.  A batch is never split, so the last one may
    fill a slot beyond its size.
    """
    spark = events.sparkSession
    slots = _slots(spark, path)
    at = slots[-1][0] + (slots[-1][1] >= slot_bytes) if slots else 0
    events.write.mode("append").json(f"{path}/slot={at}")
    gone = [k for k, _ in _slots(spark, path)][:-keep]
    fs, _, make = _files(spark, path)
    for k in gone:
        slot = f"{path}/slot={k}"
        if deviates is not None:
            spark.read.schema(events.schema).json(slot).where(deviates).write.mode("overwrite").json(f"{path}/deviations/slot={k}")
        fs.delete(make(slot), True)
    return gone


def read_ring(spark: SparkSession, path: str, schema: str, part: str = "slot=*") -> DataFrame:
    """Events of a ring's slots, or of its ``deviations``; corrupt lines are left out."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = spark.read.text(f"{path}/{part}").select(F.from_json("value", schema + ", _corrupt string", options).alias("r"))
    return rows.where("r._corrupt is null").select("r.*").drop("_corrupt")


def swap(df: DataFrame, path: str) -> None:
    """Writes a new version of a snapshot below ``path`` and points readers to it in one step.

    The pointer is a small file that a rename replaces at once, so a reader sees the old
    version or the new one, and a crash leaves the old.  It names the version before too,
    which stays for readers that have begun; the one before that goes.  What other
    writers have under way is never touched; of two at once the last pointer counts.
    """
    spark = df.sparkSession
    fs, _, make = _files(spark, path)
    name = f"v-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{path}/{name}")
    before, older = _pointer(spark, path)
    draft = make(f"{path}/.next-{name}")
    put_text(spark, draft.toString(), f"{name}\n{before or ''}")
    try:
        _rename(spark, draft, make(f"{path}/current"), overwrite=True)
    finally:
        fs.delete(draft, False)
    if older:
        fs.delete(make(f"{path}/{older}"), True)


def _pointer(spark: SparkSession, path: str) -> tuple[str | None, str | None]:
    """The version that readers see, and the one before."""
    names = (get_text(spark, f"{path}/current") or "").split("\n")
    return names[0] or None, names[1] or None if len(names) > 1 else None


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The version of a snapshot that ``swap`` wrote last."""
    name = _pointer(spark, path)[0]
    if name is None:
        raise ValueError(f"no snapshot at {path}")
    return spark.read.parquet(f"{path}/{name}")


def classify_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """STR-2, STR-3: (path, change): added, changed (size or time differ), deleted."""
    a = before.select("path", F.col("size").alias("s0"), F.col("modified_at").alias("m0"), F.lit(1).alias("in0"))
    b = after.select("path", F.col("size").alias("s1"), F.col("modified_at").alias("m1"), F.lit(1).alias("in1"))
    change = (
        F.when(F.col("in0").isNull(), "added").when(F.col("in1").isNull(), "deleted")
        .when(~(F.col("s0").eqNullSafe(F.col("s1")) & F.col("m0").eqNullSafe(F.col("m1"))), "changed")
    )
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def unchanged_content(files: DataFrame, indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """STR-4: (to index, skipped) by equal SHA-1 of the content under the same path."""
    hashed = files.withColumn("content_hash", F.sha1(F.col("content").cast("binary")))
    same = indexed.select("path", "content_hash")
    return hashed.join(same, ["path", "content_hash"], "left_anti"), hashed.join(same, ["path", "content_hash"], "left_semi")
