"""Window-like operators and sorts (WIN-1 to WIN-8, SORT, TOPK)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators import sequences


def diversity_quota(sites: DataFrame, per_symbol: int = 3, per_file: int = 8) -> DataFrame:
    """WIN-1: at most so many sites (symbol, file, focus, score, id) of a symbol, then of a file.

    Order is focus, then score, both downwards, then id.  Numbering symbols first is
    exact, as a symbol lies in one file.
    """
    order = [F.desc("focus"), F.desc("score"), "id"]
    first = sites.withColumn("r", F.row_number().over(Window.partitionBy("file", "symbol").orderBy(*order))).where(F.col("r") <= per_symbol)
    return first.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy(*order))).where(F.col("r") <= per_file).drop("r")


def trace_sequences(events: DataFrame) -> DataFrame:
    """WIN-2: per trace the probes of its frames in order of first time, then frame; errors and events.

    A frame's name is its probe without suffix; events without a frame follow at the end
    under their full names.  Events without a trace belong to none.
    """
    traced = events.where("trace_id is not null")
    frames = traced.where("frame_id is not null").groupBy("trace_id", "frame_id").agg(F.min("time").alias("start"), F.min(F.regexp_replace("probe", r"\.(enter|exit|catch)$", "")).alias("name"))
    loose = traced.where("frame_id is null").select("trace_id", F.lit(1).alias("late"), F.col("time").alias("start"), F.lit(None).cast("long").alias("frame_id"), F.col("probe").alias("name"))
    steps = frames.select("trace_id", F.lit(0).alias("late"), "start", "frame_id", "name").union(loose)
    seq = steps.groupBy("trace_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("late", "start", "frame_id", "name"))), lambda x: x["name"]).alias("sequence"))
    sums = traced.groupBy("trace_id").agg(F.count("*").alias("events"), F.count_if(F.coalesce(F.length("err"), F.lit(0)) > 0).alias("errs"), F.min("time").alias("first"))
    return seq.join(sums, "trace_id")


def chain_budget(chains: DataFrame, frames: Column, most_chains: int = 512, most_frames: int = 4096, cut: int = 128) -> DataFrame:
    """WIN-3: chains in order of first, then trace, until a budget is spent; sequences cut.

    A chain is kept if it is among the first ``most_chains`` and those before it used
    fewer than ``most_frames`` frames.  Only the first ``most_chains`` are numbered.
    """
    top = chains.withColumn("frames", frames).orderBy("first", "trace_id").limit(most_chains)
    before = Window.orderBy("first", "trace_id").rowsBetween(Window.unboundedPreceding, -1)
    out = top.withColumn("used", F.coalesce(F.sum("frames").over(before), F.lit(0))).where(F.col("used") < most_frames)
    return out.withColumn("sequence", F.slice("sequence", 1, cut)).drop("used")


#: Fixed limits of the leak verdict, in MB.
LEAK_HEAP, GROW_RSS, NATIVE_RSS, NATIVE_HEAP, NATIVE_EXTERNAL = 64.0, 1024.0, 64.0, 16.0, 16.0


def leak_verdict(samples: DataFrame, grow_rss: float = GROW_RSS) -> DataFrame:
    """WIN-4: a verdict for each series (series, t, rss, heap, external, buffers) in MB.

    First and last sample and the last three heaps come from aggregates whose state is
    three rows at most; fewer than two samples are ok.
    """
    keep = F.struct("t", "rss", "heap", (F.col("external") + F.col("buffers")).alias("native"))
    recent = samples.withColumn("r", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("t")))).where("r <= 3")
    heaps = recent.groupBy("series").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "heap"))), lambda x: x["heap"]).alias("h"))
    s = samples.groupBy("series").agg(F.count("*").alias("n"), F.min_by(keep, "t").alias("a"), F.max_by(keep, "t").alias("b")).join(heaps, "series")
    d = lambda c: F.col(f"b.{c}") - F.col(f"a.{c}")
    h = F.col("h")
    rising = (F.size(h) >= 3) & (F.get(h, 0) < F.get(h, 1)) & (F.get(h, 1) < F.get(h, 2))
    verdict = (
        F.when(F.col("n") < 2, "ok").when((d("heap") > LEAK_HEAP) & rising, "leak").when(d("rss") >= grow_rss, "grow")
        .when((d("rss") > NATIVE_RSS) & (d("heap") <= NATIVE_HEAP) & (d("native") > NATIVE_EXTERNAL), "suspicious-native").otherwise("ok")
    )
    return s.select("series", "n", F.round(d("rss"), 6).alias("d_rss"), F.round(d("heap"), 6).alias("d_heap"), verdict.alias("verdict"))


def accepted_quota(events: DataFrame, key: str, time_ms: str, most: int = 10, span_ms: int = 60_000) -> DataFrame:
    """WIN-5, WIN-7: whether each event is accepted under a sliding quota that counts accepted ones only.

    With ``most`` = 1 this is a debounce.  Events of one time come in order of all other
    columns.  A key's events are dealt over many tasks.
    """
    if most == 1:
        return sequences.decided(events, key, time_ms, sequences.Debounce(span_ms))
    return sequences.quota(events, key, time_ms, most, span_ms)


def before_catch(events: DataFrame, last: int = 50) -> DataFrame:
    """WIN-6: for each .catch event of a trace the number and the first time of the up to ``last`` events up to it."""
    w = Window.partitionBy("trace_id").orderBy("time", "seq").rowsBetween(-(last - 1), 0)
    out = events.withColumns({"ambient": F.count("*").over(w), "since": F.min("time").over(w)})
    return out.where(F.endswith("probe", F.lit(".catch")))


def claims_hold(events: DataFrame, claims: dict[str, float]) -> DataFrame:
    """WIN-8: whether each probe's longest duration exceeds what is claimed."""
    most = events.groupBy("probe").agg(F.max("dur_us").alias("most"))
    bound = F.lit(None).cast("double")
    for probe, value in claims.items():
        bound = F.when(F.col("probe") == probe, F.lit(float(value))).otherwise(bound)
    return most.withColumn("claim", bound).where("claim is not null").withColumn("holds", F.col("most") > F.col("claim"))


def ranked(column: str, order: list[str]) -> Column:
    """SORT-2: place of a value in a fixed order, unknown ones last."""
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(F.col(column) == v, i).otherwise(out)
    return out


def sort_impact(rows: DataFrame) -> DataFrame:
    """SORT-2: high before medium before low, then depth, then dependents downwards, then file."""
    return rows.orderBy(ranked("risk", ["high", "medium", "low"]), "depth", F.desc("dep_count"), "file")


def sort_deviations(rows: DataFrame) -> DataFrame:
    """SORT-3: unobserved, then violated and chain-broken, then undesigned; else as they came (ordinal)."""
    place = F.when(F.col("kind") == "unobserved", 0).when(F.col("kind").isin("violated", "chain-broken"), 1).when(F.col("kind") == "undesigned", 2).otherwise(3)
    return rows.withColumn("place", place).orderBy("place", "ordinal")
