"""What a set of files needs: a typed import closure (GRAPH-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.graph import Keep, bfs, checkpointed


def folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def package_steps(files: DataFrame) -> DataFrame:
    """(source, target) between files of one package, through a node of the package: two steps, no pairs.

    In Go all files of a folder are one package, but for its tests.
    """
    mine = files.where(F.endswith("path", F.lit(".go")) & ~F.endswith("path", F.lit("_test.go"))).select("path", F.concat(F.lit("package:"), folder(F.col("path"))).alias("package"))
    return mine.select(F.col("path").alias("source"), F.col("package").alias("target")).union(mine.select("package", "path"))


def glob_pattern(glob: Column) -> Column:
    """A regular expression for a glob of resources: * and ? within a name, a folder stands for all below it."""
    escaped = F.regexp_replace(glob, r"([.+^${}()|\[\]\\])", r"\\$1")
    inner = F.regexp_replace(F.regexp_replace(escaped, r"\*", "[^/]*"), r"\?", "[^/]")
    return F.concat(F.lit("^"), inner, F.lit("(/.*)?$"))


def embedded(files: DataFrame) -> DataFrame:
    """(path, glob) of the resources that Go files (path, content) embed, relative to the file's folder."""
    lines = F.regexp_extract_all("content", F.lit(r"(?m)^//go:embed\s+(.+)$"), F.lit(1))
    words = files.where(F.endswith("path", F.lit(".go"))).select("path", F.explode(lines).alias("line")).select("path", F.explode(F.split(F.trim("line"), r"\s+")).alias("glob"))
    return words.select("path", F.regexp_replace(F.regexp_replace("glob", '^["`]|["`]$', ""), "^all:", "").alias("glob")).where("glob <> ''")


def import_closure(
    imports: DataFrame, files: DataFrame, seeds: DataFrame, max_depth: int = 30, callers: bool = False, embeds: DataFrame | None = None, resources: DataFrame | None = None, keep: Keep = checkpointed
) -> DataFrame:
    """GRAPH-1, typed: (file, depth, parent, runtime, resource) of what the seeds (path) need.

    ``imports`` are (source, target, type_only); files (path) of one package need each
    other.  ``runtime`` tells what is reached by value imports and packages alone: a file
    that only types lead to is compiled against but never loaded.  With ``callers`` files
    that import a reached one come too, without being needed at run time.  Resources
    (path) that an embed glob (path, glob) of a reached file names follow it.
    """
    package, known = package_steps(files), seeds.select(F.col("path").alias("node")).distinct().join(files.select(F.col("path").alias("node")), "node", "left_semi")
    plain = imports.select("source", "target")
    # A step within a package takes two edges; import edges are cut in two, so that both count alike.
    halves = lambda e: e.select("source", F.concat_ws(" > ", "source", "target").alias("target")).union(e.select(F.concat_ws(" > ", "source", "target"), "target"))
    edges = halves(plain).union(package)
    if callers:
        edges = edges.union(halves(plain.select(F.col("target").alias("source"), F.col("source").alias("target"))))
    whole = bfs(edges, known, 2 * max_depth, "out", keep)
    loaded = bfs(halves(imports.where(~F.coalesce("type_only", F.lit(False))).select("source", "target")).union(package), known, 2 * max_depth, "out", keep)
    inner = F.startswith("node", F.lit("package:")) | F.contains("node", F.lit(" > "))
    before = F.when(F.startswith("parent", F.lit("package:")), None).otherwise(F.element_at(F.split("parent", " > "), 1))
    reached = whole.where(~inner).select(F.col("node").alias("file"), (F.col("depth") / 2).cast("int").alias("depth"), before.alias("parent"))
    out = reached.join(loaded.where(~inner).select(F.col("node").alias("file"), F.lit(True).alias("runtime")), "file", "left")
    out = keep(out.select("file", "depth", "parent", F.coalesce("runtime", F.lit(False)).alias("runtime"), F.lit(False).alias("resource")), "closure")
    if embeds is None or resources is None:
        return out
    # Resources meet the globs of one folder only; a glob that leads out of it finds nothing.
    globs = out.join(embeds.select(F.col("path").alias("file"), "glob"), "file").select("file", "depth", "runtime", folder(F.col("file")).alias("base"), glob_pattern(F.col("glob")).alias("pattern"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    below = resources.select("path", F.explode(above).alias("base"))
    hit = below.join(globs, "base").where(F.expr("regexp_like(if(base = '', path, substring(path, length(base) + 2)), pattern)"))
    found = hit.groupBy("path").agg(F.min(F.struct("depth", "file")).alias("first"), F.max("runtime").alias("runtime"))
    more = found.select(F.col("path").alias("file"), "first.depth", F.col("first.file").alias("parent"), "runtime", F.lit(True).alias("resource"))
    return out.union(more.join(out.select("file"), "file", "left_anti"))
