"""Global positions of rows without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.scratch import Scratch


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str, box: Scratch, many: bool = False) -> DataFrame:
    """Adds ``name``, the 0-based position of a row in its group by ``order``.

    Rows are range-partitioned and sorted by (group, order) and stored once with the
    position in their partition.  A row's number is its distance from the first row of
    its group there plus the group's rows in earlier partitions.  Those starts are one
    row for each partition and group it holds, at most partitions plus groups, as
    ranges do not overlap.  With ``many`` groups they are stored and broadcast only if
    small.  A group of any size is dealt over many tasks.  ``df`` may not have columns
    _part, _row or _start.
    """
    by = [F.col(c) for c in [*group, *order]]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = box.keep(dealt.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), f"dealt-{name}")
    starts = dealt.groupBy("_part", *group).agg(F.count("*").alias("n"), F.min("_row").alias("first"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("n")
    starts = starts.select(F.col("_part").alias("p"), *[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], (before - F.col("first")).alias("_start"))
    same = F.col("_part") == F.col("p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"g{i}"))
    starts = box.keep(starts, f"starts-{name}") if many else F.broadcast(starts)
    return dealt.join(starts, same).withColumn(name, F.col("_row") + F.col("_start")).select(*df.columns, name)
