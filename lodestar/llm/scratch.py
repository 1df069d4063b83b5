"""Shared working folder of a job: tables that cut lineage.

Intermediate tables are written as Parquet below the folder that the cluster
names in ``spark.checkpoint.dir``, which driver and executors share; a lost
executor costs only the tasks it ran.  Where the setting is absent (tests on
one machine) a temporary folder is set and used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from the session; set here only if it is unset on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def quoted(name: str) -> str:
    """A column's name as an expression, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


class Scratch:
    """A folder of one operator call. ``keep`` writes a table there and reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._fs(self.path)[0].deleteOnExit(self._fs(self.path)[1])

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Frees tables that no later step reads."""
        for name in names:
            fs, p = self._fs(f"{self.path}/{name}")
            fs.delete(p, True)

    def leave(self, *names: str) -> None:
        """Frees all tables but those that the result still reads."""
        fs, p = self._fs(self.path)
        self.drop(*[x.getPath().getName() for x in fs.listStatus(p) if x.getPath().getName() not in names])
