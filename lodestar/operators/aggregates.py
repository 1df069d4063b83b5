"""Aggregations (AGG-1 to AGG-21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scalars import dirname, half_up, log2_bucket, ratio, strip_scope


def index_stats(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-1: one row of counts and the latest indexing time."""
    f = files.agg(F.count("*").alias("files"), F.max("indexed_at").alias("indexed_at"))
    return f.join(nodes.agg(F.count("*").alias("nodes"))).join(edges.agg(F.count("*").alias("edges")))


def in_degree(edges: DataFrame) -> DataFrame:
    """AGG-2: calls into each target."""
    return edges.where("kind = 'call'").groupBy("target").agg(F.count("*").alias("n"))


def weighted_file_edges(calls: DataFrame, per_pair: int = 2, most: int = 40) -> DataFrame:
    """AGG-3: the heaviest calls, at most ``per_pair`` for two files, ``most`` in all.

    calls (source_file, source_name, target_file, target_name); ties by names.
    """
    keys = ["source_file", "source_name", "target_file", "target_name"]
    order = [F.desc("weight"), *keys]
    pair = Window.partitionBy(F.least("source_file", "target_file"), F.greatest("source_file", "target_file")).orderBy(*order)
    weighed = calls.groupBy(*keys).agg(F.count("*").alias("weight")).withColumn("r", F.row_number().over(pair))
    return weighed.where(F.col("r") <= per_pair).drop("r").orderBy(*order).limit(most)


def file_heat(calls: DataFrame) -> DataFrame:
    """AGG-4: calls out of plus calls into each file."""
    ends = calls.select(F.explode(F.array("source_file", "target_file")).alias("file"))
    return ends.groupBy("file").agg(F.count("*").alias("heat"))


def feature_deps(edges: DataFrame, features: DataFrame) -> DataFrame:
    """AGG-5: weights between features; a file belongs to the first feature naming it.

    edges (source, target) of files, features (feature, ordinal, file).
    """
    owner = features.groupBy("file").agg(F.min_by("feature", F.struct("ordinal", "feature")).alias("feature"))
    own = lambda side: owner.toDF(side, f"{side}_feature")
    met = edges.join(own("source"), "source").join(own("target"), "target").where("source_feature <> target_feature")
    return met.groupBy("source_feature", "target_feature").agg(F.count("*").alias("weight"))


def feature_ownership(features: DataFrame) -> DataFrame:
    """AGG-5: per file its owner, the number of features naming it, and if it is shared."""
    out = features.groupBy("file").agg(F.min_by("feature", F.struct("ordinal", "feature")).alias("owner"), F.count_distinct("feature").alias("features"))
    return out.withColumn("shared", F.col("features") > 1)


def probe_profile(events: DataFrame) -> DataFrame:
    """AGG-6: per probe: events, errors (non-empty), benign ones, ops in first-seen order.

    First-seen order is kept as one (op, least time and sequence) each, so the state of
    a probe is as large as its distinct ops, not as its events.
    """
    base = events.groupBy("probe").agg(
        F.count("*").alias("events"),
        F.count_if(F.coalesce(F.length("err"), F.lit(0)) > 0).alias("errs"),
        F.count_if(F.col("benign") == True).alias("benigns"),  # noqa: E712
    )
    ops = events.where("op is not null").groupBy("probe", "op").agg(F.min(F.struct("time", "seq")).alias("at"))
    ordered = ops.groupBy("probe").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "op"))), lambda x: x["op"]).alias("ops"))
    return base.join(ordered, "probe", "left").withColumn("ops", F.coalesce("ops", F.array().cast("array<string>")))


def latency_histogram(events: DataFrame) -> DataFrame:
    """AGG-7: events by probe and power-of-two bucket of microseconds."""
    return events.groupBy("probe", log2_bucket(F.col("dur_us")).alias("bucket")).agg(F.count("*").alias("n"))


def histogram_percentile(histogram: DataFrame, p: float) -> DataFrame:
    """AGG-8: percentile per probe, interpolated in the bucket, in whole microseconds."""
    run = Window.partitionBy("probe").orderBy("bucket")
    h = histogram.withColumns({"cum": F.sum("n").over(run), "total": F.sum("n").over(Window.partitionBy("probe"))})
    h = h.withColumn("target", F.greatest(F.lit(1), F.floor(F.col("total") * p + 0.5)))
    hit = h.where("cum >= target").groupBy("probe").agg(F.min(F.struct("bucket", "n", "cum", "target", "total")).alias("h")).select("probe", "h.*")
    low = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), F.col("bucket")))
    part = (F.col("target") - (F.col("cum") - F.col("n"))) / F.col("n")
    return hit.select("probe", "total", F.floor(low + part * (F.pow(F.lit(2.0), F.col("bucket") + 1) - low)).cast("long").alias("value_us"))


def probe_counters(events: DataFrame) -> DataFrame:
    """AGG-9: hits per probe; all hits of a .catch are errors."""
    hits = events.groupBy("probe").agg(F.count("*").alias("hits"))
    return hits.withColumn("errs", F.when(F.endswith("probe", F.lit(".catch")), F.col("hits")).otherwise(F.lit(0).cast("long")))


def ledger_summary(entries: DataFrame) -> DataFrame:
    """AGG-10: total, consumed, violated and their rate."""
    out = entries.agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce("consumed_at", F.lit("")) != "").alias("consumed"),
        F.count_if(F.col("status").isin("violated", "resolved")).alias("violated"),
    )
    return out.withColumn("rate", F.when(F.col("consumed") > 0, F.col("violated") / F.col("consumed")).otherwise(0.0))


def ledger_repeats(entries: DataFrame, least: int = 2) -> DataFrame:
    """AGG-10: declared files violated at least ``least`` times, with what was unexpected."""
    bad = entries.where(F.col("status").isin("violated", "resolved")).select("id", F.explode(F.array_distinct("declared_files")).alias("source"), "unexpected_files")
    times = bad.groupBy("source").agg(F.count("*").alias("violations")).where(F.col("violations") >= least)
    files = bad.select("source", F.explode("unexpected_files").alias("f")).distinct().groupBy("source").agg(F.sort_array(F.collect_list("f")).alias("files"))
    out = times.join(files, "source", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))
    return out.orderBy(F.desc("violations"), "source")


def usage_rollup(usage: DataFrame) -> DataFrame:
    """AGG-11: calls, ok and failed by tool and by (tool, action), in one pass."""
    named = usage.withColumn("action", F.coalesce("action", F.lit("—")))
    sets = named.groupingSets([["tool"], ["tool", "action"]], "tool", "action")
    return sets.agg(F.grouping("action").cast("int").alias("is_total"), F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))


def gateway_totals(usage: DataFrame) -> DataFrame:
    """AGG-12: totals of requests, failures and milliseconds."""
    return usage.agg(F.count("*").alias("requests"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("ms"), F.lit(0)).alias("ms"))


def directory_functions(nodes: DataFrame) -> DataFrame:
    """AGG-13: functions and files of each folder."""
    return nodes.groupBy(dirname(F.col("file_path")).alias("dir")).agg(F.count("*").alias("functions"), F.count_distinct("file_path").alias("files"))


def layer_matrix(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """AGG-14: dependencies between different layers, most first."""
    side = lambda s: layers.toDF(s, f"{s}_layer")
    met = edges.join(side("source"), "source").join(side("target"), "target").where("source_layer <> target_layer")
    return met.groupBy("source_layer", "target_layer").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_layer", "target_layer")


#: Fixed weights of the health score: issue kind, weight, density at which it counts fully.
HEALTH = [("layer", 30, 15), ("cycle", 30, 10), ("complexity", 25, 30), ("orphan", 20, 10), ("unused_export", 15, 50), ("unused_import", 10, 25)]


def health_score(issues: DataFrame, files: DataFrame) -> DataFrame:
    """AGG-15: 100 less the weighted densities per 100 files, not below 0, with a grade."""
    counts = issues.groupBy().agg(*[F.count_if(F.col("kind") == k).alias(k) for k, _, _ in HEALTH])
    n = files.agg(F.count("*").alias("files"))
    loss = F.lit(0.0)
    for kind, weight, full in HEALTH:
        loss = loss + weight * F.least(F.lit(1.0), F.col(kind) * 100.0 / F.col("files") / full)
    score = F.when(F.col("files") == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), half_up(100 - loss)))
    out = n.join(counts).withColumn("score", score.cast("long"))
    s = F.col("score")
    return out.withColumn("grade", F.when(F.col("files") == 0, "N/A").when(s >= 90, "A").when(s >= 75, "B").when(s >= 60, "C").otherwise("D"))


def integrity_counts(refs: DataFrame, indexed: DataFrame, on_disk: DataFrame) -> DataFrame:
    """AGG-16: (what, n): references by status, ghosts, files not indexed or not fresh.

    indexed and on_disk are (path, hash).
    """
    status = refs.groupBy(F.concat(F.lit("ref:"), "status").alias("what")).agg(F.count("*").alias("n"))
    both = indexed.select("path", F.col("hash").alias("ih")).join(on_disk.select("path", F.col("hash").alias("dh")), "path", "full_outer")
    state = F.when(F.col("dh").isNull(), "ghost").when(F.col("ih").isNull(), "not_indexed").when(F.col("ih") != F.col("dh"), "not_fresh").otherwise("fresh")
    return status.union(both.groupBy(state.alias("what")).agg(F.count("*").alias("n")))


def majority(df: DataFrame, group: str, value: str, seen: str) -> DataFrame:
    """AGG-17: the most frequent value of a group; of equals the first seen."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"), F.min(seen).alias("at"))
    best = counts.groupBy(group).agg(F.max_by(F.struct(value, "n"), F.struct("n", (-F.col("at")).alias("at"))).alias("b"))
    return best.select(group, f"b.{value}", "b.n")


def decision_catalogue(decisions: DataFrame) -> DataFrame:
    """AGG-18: decisions by thread; those without come last as (uncategorised)."""
    out = decisions.groupBy("thread").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("title")).alias("titles"))
    out = out.orderBy(F.col("thread").isNull(), "thread")
    return out.withColumn("thread", F.coalesce("thread", F.lit("(uncategorised)")))


def merge_contracts(items: DataFrame, effects: DataFrame) -> DataFrame:
    """AGG-19: per side (exposes, consumes, emits) names once, the first file's kind wins; and irreversible effects.

    items (side, name, kind, ordinal), effects (name, holds, reversible).
    """
    first = items.groupBy("side", "name").agg(F.min_by("kind", "ordinal").alias("kind"))
    hard = effects.where(~F.coalesce("reversible", F.lit(False))).select(F.lit("irreversible").alias("side"), "name", F.when(F.col("holds"), "hold").otherwise("write").alias("kind")).distinct()
    return first.unionByName(hard)


def effect_observations(events: DataFrame) -> DataFrame:
    """AGG-20: per file, kind and target: events, probes and the latest time."""
    return events.groupBy("file", "kind", "target").agg(F.count("*").alias("n"), F.count_distinct("probe").alias("probes"), F.max("time").alias("latest"))


def distinct_values(df: DataFrame, column: str | Column) -> DataFrame:
    """AGG-21: the distinct values of a column."""
    return df.select(column).distinct()


def scope_profile(events: DataFrame) -> DataFrame:
    """Events by probe without its scope suffix, and the share of errors."""
    out = events.groupBy(strip_scope(F.col("probe")).alias("base")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.length("err"), F.lit(0)) > 0).alias("errs"))
    return out.withColumn("rate", F.round(ratio(F.col("errs"), F.col("n")), 6))
