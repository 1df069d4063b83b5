"""Joins over the symbol store (JOIN-1 to JOIN-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scalars import file_of, fold_blanks


def cross_file_calls(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """JOIN-1: call edges whose ends lie in different files, with both ends' names."""
    end = lambda side: nodes.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"), F.col("file_path").alias(f"{side}_file"))
    return edges.where("kind = 'call'").join(end("source"), "source").join(end("target"), "target").where("source_file <> target_file")


def edges_touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """JOIN-3: edges whose source or target is among ``ids`` (column id), each once."""
    marks = ids.select("id").distinct().withColumn("hit", F.lit(True))
    out = edges.join(marks.toDF("source", "hs"), "source", "left").join(marks.toDF("target", "ht"), "target", "left")
    return out.where("hs or ht").select(edges.columns)


def stale_refs(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """JOIN-4: resolved references whose name no node has any more."""
    names = nodes.select(F.col("name").alias("reference_name")).distinct()
    return refs.where("status = 'resolved'").join(names, "reference_name", "left_anti")


def resolve_in_order(refs: DataFrame, imports: DataFrame, nodes: DataFrame, builtins: list[str], complete: bool = True) -> DataFrame:
    """JOIN-5: the first imported file, in import order, that has the name.

    refs (ref_id, file_path, name, kind), imports (file_path, ordinal, target_file), nodes
    (file_path, name, id).  Adds target and status: external for dotted calls and
    builtins, resolved, or failed (pending while the index is incomplete).  A file that
    is imported twice counts at its first place; of equal names the smallest id wins.
    The winner is a minimum, so candidates meet in a partial aggregation, not a sort.
    """
    outside = ((F.col("kind") == "call") & F.contains("name", F.lit("."))) | F.col("name").isin(builtins)
    first = imports.groupBy("file_path", "target_file").agg(F.min("ordinal").alias("ordinal"))
    named = nodes.groupBy("file_path", "name").agg(F.min("id").alias("id")).withColumnRenamed("file_path", "target_file")
    found = refs.where(~outside).join(first, "file_path").join(named, ["target_file", "name"])
    best = found.groupBy("ref_id").agg(F.min(F.struct("ordinal", "target_file", "id")).alias("best")).select("ref_id", F.col("best.id").alias("target"))
    missing = F.lit("failed" if complete else "pending")
    status = F.when(outside, "external").when(F.col("target").isNotNull(), "resolved").otherwise(missing)
    return refs.join(best, "ref_id", "left").withColumn("status", status)


def resolve_unique(calls: DataFrame, bindings: DataFrame, definitions: DataFrame) -> DataFrame:
    """JOIN-6: names with exactly one possible provider; else target stays null.

    calls (call_id, file_path, name); bindings (file_path, prefix, provider) serve dotted
    names, definitions (name, file_path, id) in other files the rest.
    """
    dotted = F.contains("name", F.lit("."))
    one = bindings.groupBy("file_path", "prefix").agg(F.count_distinct("provider").alias("n"), F.min("provider").alias("target")).where("n = 1").drop("n")
    left = calls.where(dotted).withColumn("prefix", F.substring_index("name", ".", 1)).join(one, ["file_path", "prefix"], "left").select("call_id", "target")
    per = definitions.groupBy("name").agg(F.count("*").alias("n"))
    mine = definitions.groupBy("name", "file_path").agg(F.count("*").alias("here"))
    plain = calls.where(~dotted).join(per, "name", "left").join(mine, ["name", "file_path"], "left")
    # Definitions elsewhere are all but the own file's; only one may be left.
    elsewhere = F.col("n") - F.coalesce("here", F.lit(0))
    single = plain.where(elsewhere == 1).select("call_id", "name", F.col("file_path").alias("own"))
    target = single.join(definitions, "name").where("file_path <> own").groupBy("call_id").agg(F.min("id").alias("target"))
    return left.union(calls.where(~dotted).select("call_id").join(target, "call_id", "left"))


def compare_versions(a: DataFrame, b: DataFrame) -> DataFrame:
    """JOIN-7: names of two lists (name, version): shared, conflict, a_only or b_only."""
    both = a.select("name", F.col("version").alias("va"), F.lit(1).alias("ina")).join(b.select("name", F.col("version").alias("vb"), F.lit(1).alias("inb")), "name", "full_outer")
    state = F.when(F.col("inb").isNull(), "a_only").when(F.col("ina").isNull(), "b_only").when(fold_blanks(F.col("va")).eqNullSafe(fold_blanks(F.col("vb"))), "shared").otherwise("conflict")
    return both.select("name", "va", "vb", state.alias("state"))


def compare_symbols(a: DataFrame, b: DataFrame) -> DataFrame:
    """JOIN-8: names of two symbol sets (name, kind, signature).

    A name's fingerprint is its sorted kind:signature pairs; names in both are
    duplicate if the fingerprints are equal, else conflict.
    """
    def prints(df: DataFrame, side: str) -> DataFrame:
        pairs = F.sort_array(F.collect_list(F.concat_ws(":", "kind", F.coalesce("signature", F.lit("")))))
        return df.groupBy("name").agg(F.array_join(pairs, "|").alias(side))

    both = prints(a, "fa").join(prints(b, "fb"), "name", "full_outer")
    state = F.when(F.col("fb").isNull(), "a_only").when(F.col("fa").isNull(), "b_only").when(F.col("fa") == F.col("fb"), "duplicate").otherwise("conflict")
    return both.select("name", state.alias("state"))


def edges_of_file(edges: DataFrame, file: str) -> DataFrame:
    """JOIN-10: edges into or out of a file's nodes; the prefix test is an equality."""
    own = {side: file_of(F.col(side)) == file for side in ("source", "target")}
    return edges.where(own["source"] | own["target"]).withColumn("direction", F.when(own["source"] & own["target"], "inside").when(own["source"], "out").otherwise("in"))


def first_path(wanted: DataFrame, files: DataFrame, strip: str = "./") -> DataFrame:
    """JOIN-11: for each wanted path the first variant that is a file.

    Variants in order: the path, without a leading ``strip``, its base name.
    """
    p = F.col("path")
    forms = F.array(p, F.when(F.startswith(p, F.lit(strip)), F.substr(p, F.lit(len(strip) + 1))), F.substring_index(p, "/", -1))
    tried = wanted.select("path", F.posexplode(forms).alias("ordinal", "variant")).where("variant is not null")
    hits = tried.join(files.select(F.col("path").alias("variant")).distinct(), "variant", "left_semi")
    best = hits.groupBy("path").agg(F.min(F.struct("ordinal", "variant")).alias("b")).select("path", F.col("b.variant").alias("found"))
    return wanted.join(best, "path", "left")


def target_class(target: Column) -> Column:
    """The class that stands for aliases of an effect's target."""
    out = target
    for prefix in ("listen", "db-pool", "file-handle"):
        out = F.when(F.startswith(target, F.lit(prefix)), F.lit(prefix)).otherwise(out)
    return out


def reconcile_effects(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """JOIN-12: effects (file, kind, target) as confirmed, newly_observed or unobserved.

    Targets meet by their class, so an alias confirms a declaration.  Both sides are
    reduced to one row for each key first.
    """
    keyed = lambda df, side: df.select("file", "kind", target_class(F.col("target")).alias("cls")).distinct().withColumn(side, F.lit(1))
    both = keyed(observed, "seen").join(keyed(declared, "said"), ["file", "kind", "cls"], "full_outer")
    state = F.when(F.col("said").isNull(), "newly_observed").when(F.col("seen").isNull(), "unobserved").otherwise("confirmed")
    return both.select("file", "kind", F.col("cls").alias("target"), state.alias("state"))


def enclosing(points: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """SRCH-8, JOIN-9: for each point (key, file, line) the span with the greatest start at or before it.

    An as-of join without a range join.  Lines are cut into buckets of ``width``; points
    and spans of one bucket meet in a running window, and where a bucket has no span
    before the point the last one of earlier buckets is carried to it, one row for each
    bucket.  A file with very many points is so dealt by buckets.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long").alias("bucket")
    s = spans.select("file", bucket("start"), F.col("start").alias("line"), F.lit(0).alias("side"), "start", "name", F.lit(None).cast("string").alias("key"))
    p = points.select("file", bucket("line"), "line", F.lit(1).alias("side"), F.lit(None).cast(spans.schema["start"].dataType).alias("start"), F.lit(None).cast("string").alias("name"), F.col("key").cast("string"))
    run = Window.partitionBy("file", "bucket").orderBy("line", "side", "start", "name").rowsBetween(Window.unboundedPreceding, 0)
    here = F.last(F.when(F.col("side") == 0, F.struct("start", "name")), ignorenulls=True).over(run)
    inside = s.unionByName(p).withColumn("at", here).where("side = 1").select("key", "file", "bucket", "line", "at")
    marks = s.groupBy("file", "bucket").agg(F.max(F.struct("start", "name")).alias("last"))
    wanted = p.select("file", "bucket").distinct().join(marks, ["file", "bucket"], "full_outer")
    before = Window.partitionBy("file").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = wanted.select("file", "bucket", F.last("last", ignorenulls=True).over(before).alias("prior"))
    found = F.coalesce("at", "prior")
    return inside.join(carried, ["file", "bucket"]).select("key", "file", "line", found["start"].alias("start"), found["name"].alias("name"))


def changed_names(diffs: DataFrame) -> DataFrame:
    """STR-5: short names that a stored diff (added, removed, changed) mentions, each once."""
    names = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("added", "removed", "changed")])
    return diffs.select(F.explode(F.transform(names, lambda n: F.substring_index(n, ".", -1))).alias("name")).where("name <> ''").distinct()


def reopen_refs(refs: DataFrame, names: DataFrame, nodes: DataFrame) -> DataFrame:
    """STR-5: references to changed names become pending again.

    Resolved ones do; failed ones only if the name exists in the index now.  Adds
    ``reopened``; the files of those rows are the scope of the resolution that follows.
    """
    there = nodes.select("name").distinct().withColumn("exists", F.lit(True))
    marks = names.select("name").distinct().join(there, "name", "left").select(F.col("name").alias("reference_name"), F.coalesce("exists", F.lit(False)).alias("exists"), F.lit(True).alias("hit"))
    joined = refs.join(marks, "reference_name", "left")
    again = F.coalesce("hit", F.lit(False)) & ((F.col("status") == "resolved") | ((F.col("status") == "failed") & F.col("exists")))
    status = F.when(again, "pending").otherwise(F.col("status")).alias("status")
    return joined.select(*[status if c == "status" else F.col(c) for c in refs.columns], again.alias("reopened"))
