"""Connected components of an edge table (GRAPH-7), distributed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(
    edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame], max_rounds: int = 60
) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component = least node id.

    Alternating large-star and small-star steps: each round is two aggregations on
    narrow rows, the number of rounds grows with the logarithm of the longest path,
    and no row count exceeds that of the edges.  ``keep(df, name)`` stores a round's
    table and returns it reread, which cuts the lineage.  Self loops and nulls are
    ignored; an empty edge table gives an empty result.
    """
    e = keep(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null and a <> b")
        .distinct(),
        "cc0",
    )
    state = None
    for i in range(1, max_rounds + 1):
        e = keep(_small_star(_large_star(e)), f"cc{i}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return (
        e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .union(e.select("v", "v").distinct())
        .distinct()
    )


def _large_star(e: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node with the node's least neighbour."""
    both = e.union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Links the smaller neighbours of a node, and the node, with the least of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    return (
        e.join(least, "u")
        .where("v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", "m"))
        .distinct()
    )
