"""Where to observe: symbols ranked by six signals, each kept as evidence (section 2.11, WIN-1)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.windows import diversity_quota

#: Fixed weights of the signals, and what a symbol in focus gets on top.
WEIGHTS = {"called": 0.3, "changed": 0.2, "io": 0.2, "silent_catch": 0.15, "size": 0.1, "hot_file": 0.05}
FOCUS, FULL_DEGREE, BIG_LINES, HOT_MS = 0.25, 12, 40, 24 * 3600 * 1000
#: Fixed names of calls that write or start something.
IO_NAMES = (
    "writeFileSync writeFile appendFileSync appendFile mkdirSync mkdir copyFileSync copyFile renameSync rename"
    " unlinkSync unlink rmSync rm spawn execSync execFileSync"
).split()
CATCH = r"catch\s*(?:\([^)]*\))?\s*\{([^{}]*)\}"
HANDLED = r"(?i)\bthrow\b|\bconsole\.|\breject\b|report|logger|log\("
#: Lines of a block in which sites and spans meet.
BLOCK = 256


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def sites(files: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """(file, first, last, value) of every match of a pattern in (path, content), with its lines.

    Lines are counted along: a text's matches are numbered and what lies between is summed.
    """
    cut = F.arrays_zip(F.split("content", pattern, -1).alias("gap"), F.regexp_extract_all("content", F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all("content", F.lit(pattern), F.lit(group)).alias("value"))
    rows = files.where(F.col("content").rlike(pattern)).select("path", F.posexplode(cut).alias("k", "x")).select("path", "k", _newlines(F.col("x.gap")).alias("gap"), _newlines(F.col("x.hit")).alias("own"), "x.hit", "x.value")
    along = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    last = F.sum(F.col("gap") + F.coalesce("own", F.lit(0))).over(along) + 1
    return rows.withColumn("last", last.cast("int")).where("hit is not null").select(F.col("path").alias("file"), (F.col("last") - F.col("own")).alias("first"), "last", "value")


def stab(spans: DataFrame, points: DataFrame) -> DataFrame:
    """Sites (file, first, last, ...) with the id of every span (id, file, start, end) that holds them.

    Spans and sites meet in blocks of lines: a file of any length is dealt by them.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    s = spans.select("id", "file", "start", "end", F.explode(F.sequence(block("start"), block("end"))).alias("block"))
    return points.withColumn("block", block("first")).join(s, ["file", "block"]).where("start <= first and last <= end").drop("block", "start", "end")


def observe_points(
    nodes: DataFrame, calls: DataFrame, files: DataFrame, changed: DataFrame, now_ms: int, focus: str | None = None, focus_paths: list[str] | None = None, io_names: list[str] | None = None,
) -> DataFrame:
    """(id, file, symbol, score, focus, evidence) of symbols that any signal speaks for.

    Signals and their weights: calls that point to it, in proportion to the logarithm,
    full from 12 on; a change on record (qualified_name); calls of ``io_names`` in its span;
    catch blocks there that neither throw nor report; 40 lines or more; a file modified
    within a day (modified_at, ms).  A symbol in ``focus`` (a pattern on path and names, or
    the start of a path) gets 0.25 on top and comes first.  Files and closures are left out.
    """
    names = io_names or IO_NAMES
    spans = nodes.where((F.col("kind") != "file") & ~F.coalesce("is_closure", F.lit(False))).select("id", F.col("file_path").alias("file"), F.col("start_line").alias("start"), F.greatest("start_line", "end_line").alias("end"), "name", "qualified_name")
    content = files.select("path", "content")
    io = stab(spans, sites(content, rf"\b({'|'.join(map(re.escape, names))})\s*\("))
    order = F.array(*[F.lit(n) for n in names])
    placed = F.struct(F.array_position(order, F.col("value")).alias("at"), "value")
    io = io.groupBy("id").agg(F.transform(F.sort_array(F.collect_set(placed)), lambda x: x["value"]).alias("io"))
    silent = stab(spans, sites(content, CATCH).where(~F.coalesce("value", F.lit("")).rlike(HANDLED))).groupBy("id").agg(F.count("*").alias("silent"))
    degree = calls.where("kind = 'call'").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("called"))
    recent = changed.select("qualified_name").distinct().withColumn("changed", F.lit(True))
    hot = files.where((F.col("modified_at") > now_ms - HOT_MS) & (F.col("modified_at") > 0)).select(F.col("path").alias("file"), F.lit(True).alias("hot"))
    all_ = spans.join(degree, "id", "left").join(recent, "qualified_name", "left").join(hot, "file", "left").join(io, "id", "left").join(silent, "id", "left")
    lines = F.col("end") - F.col("start") + 1
    given = {
        "called": (F.col("called") > 0, F.lit(WEIGHTS["called"]) * F.least(F.lit(1.0), F.log1p("called") / F.log1p(F.lit(float(FULL_DEGREE)))), F.concat("called", F.lit(" calls"))),
        "changed": (F.col("changed"), F.lit(WEIGHTS["changed"]), F.lit("changed")),
        "size": (lines >= BIG_LINES, F.lit(WEIGHTS["size"]), F.concat(lines, F.lit(" lines"))),
        "hot_file": (F.col("hot"), F.lit(WEIGHTS["hot_file"]), F.lit("modified within a day")),
        "io": (F.size("io") > 0, F.lit(WEIGHTS["io"]), F.array_join(F.slice("io", 1, 3), "/")),
        "silent_catch": (F.col("silent") > 0, F.lit(WEIGHTS["silent_catch"]), F.concat("silent", F.lit(" catch blocks"))),
    }
    raw = sum((F.when(test, weight).otherwise(0.0) for test, weight, _ in given.values()), F.lit(0.0))
    near = F.lit(False)
    if focus:
        near = F.concat_ws(" ", "file", "qualified_name", "name").rlike(f"(?i){focus}")
    for p in focus_paths or []:
        near = near | F.startswith("file", F.lit(p))
    evidence = F.array(*[F.when(test, F.struct(F.lit(k).alias("signal"), detail.cast("string").alias("detail"), F.round(weight, 3).alias("weight"))) for k, (test, weight, detail) in given.items()])
    score = F.least(F.lit(1.0), F.round(F.col("raw") + F.when(near, FOCUS).otherwise(0.0), 3))
    return all_.withColumn("raw", raw).where("raw > 0").select("id", "file", F.col("qualified_name").alias("symbol"), score.alias("score"), near.alias("focus"), F.array_compact(evidence).alias("evidence"))


def recommend(points: DataFrame, most: int = 40, per_file: int = 8) -> DataFrame:
    """The best ``most`` points: those in focus first, then by score and id; at most ``per_file`` of a file."""
    ranked = diversity_quota(points.withColumn("f", F.col("focus").cast("int")).drop("focus").withColumnRenamed("f", "focus"), 3, per_file)
    return ranked.orderBy(F.desc("focus"), F.desc("score"), "id").limit(most).withColumn("focus", F.col("focus") == 1)
