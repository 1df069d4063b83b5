"""Filters and projections (FLT-1 to FLT-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.scalars import condition, norm_path


def list_nodes(nodes: DataFrame, layer: str | None = None, kind: str | None = None) -> DataFrame:
    """FLT-1: nodes of a layer ('main' where none is set) and a type."""
    out = nodes.withColumn("layer", F.coalesce("layer", F.lit("main")))
    out = out if layer is None else out.where(F.col("layer") == layer)
    return out if kind is None else out.where(F.col("type") == kind)


def list_edges(edges: DataFrame, layer: str | None = None) -> DataFrame:
    """FLT-2: edges of a layer, with defaults straight, forward and main."""
    filled = {"type": "straight", "arrow": "forward", "layer": "main"}
    out = edges.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in filled.items()})
    return out if layer is None else out.where(F.col("layer") == layer)


def semantic_files(files: DataFrame, layer: str | None = None, status: str | None = None) -> DataFrame:
    """FLT-3: files by layer and status; unset values match nothing that is asked for."""
    out = files if layer is None else files.where(F.col("layer") == layer)
    return out if status is None else out.where(F.col("status") == status)


def list_annotations(annotations: DataFrame, node: str | None = None, severity: str | None = None, unresolved_only: bool = False) -> DataFrame:
    """FLT-4: annotations by node, severity and state."""
    out = annotations if node is None else annotations.where(F.col("node") == node)
    out = out if severity is None else out.where(F.col("severity") == severity)
    return out.where(~F.coalesce("resolved", F.lit(False))) if unresolved_only else out


def list_approvals(approvals: DataFrame, status: str | None = None, assignee: str | None = None) -> DataFrame:
    """FLT-4: approvals by status and assignee."""
    out = approvals if status is None else approvals.where(F.col("status") == status)
    return out if assignee is None else out.where(F.col("assignee") == assignee)


def matches_files(path: Column, files: list[str]) -> Column:
    """FLT-5: equal to, ending in or containing one of ``files``; a null path never does."""
    hit = F.lit(False)
    for f in files:
        hit = hit | F.contains(norm_path(path), F.lit(f.replace("\\", "/")))
    return F.coalesce(hit, F.lit(False))


def log_pool(events: DataFrame, deviating: Column, files: list[str] | None = None, show_all: bool = False) -> tuple[DataFrame, DataFrame]:
    """FLT-6: (rows shown, one row of total and anomalies).

    The pool is all events, or those of ``files``.  Without files and ``show_all`` only
    deviations are shown; the counts are of the whole pool all the same.
    """
    pool = events.withColumn("deviation", deviating)
    pool = pool.where(matches_files(F.col("file"), files)) if files else pool
    counts = pool.agg(F.count("*").alias("total"), F.count_if("deviation").alias("anomalies"))
    return (pool if files or show_all else pool.where("deviation")), counts


def brick_facets(bricks: DataFrame, language: str | None = None, verified: bool | None = None, has_invariants: bool | None = None, zero_third_party: bool = False) -> DataFrame:
    """FLT-7: components by facets; external is an array of (source, class)."""
    out = bricks if language is None else bricks.where(F.col("language") == language)
    out = out if verified is None else out.where(F.coalesce("verified", F.lit(False)) == verified)
    out = out if has_invariants is None else out.where((F.coalesce(F.size("invariants"), F.lit(0)) > 0) == has_invariants)
    if zero_third_party:
        out = out.where(~F.coalesce(F.exists("external", lambda x: x["class"] == "third_party"), F.lit(False)))
    return out


def in_directory(path: Column, folder: str) -> Column:
    """FLT-8: '.' holds paths without a slash, any other folder all below it."""
    return ~F.contains(path, F.lit("/")) if folder == "." else F.startswith(path, F.lit(folder + "/"))


def without_closures(nodes: DataFrame) -> DataFrame:
    """FLT-9: nodes that are not closures."""
    return nodes.where(~F.coalesce(F.col("is_closure").cast("boolean"), F.lit(False)))


def where_condition(df: DataFrame, text: str) -> DataFrame:
    """FLT-11: rows for which a condition over the columns holds."""
    return df.where(condition(text, {c: F.col(c) for c in df.columns}))
