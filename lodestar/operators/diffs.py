"""Set operations, keyed diffs and reconciliation (SET, DIFF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_split(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """SET-1, SET-2: each value once with where it is: both, a or b."""
    sides = a.select(column, F.lit(1).alias("ina"), F.lit(0).alias("inb")).union(b.select(column, F.lit(0), F.lit(1)))
    both = sides.groupBy(column).agg(F.max("ina").alias("ina"), F.max("inb").alias("inb"))
    return both.select(column, F.when(F.col("ina") + F.col("inb") == 2, "both").when(F.col("ina") == 1, "a").otherwise("b").alias("side"))


def unplanned(actual: Column, expected: Column) -> Column:
    """SET-3: what was touched but not expected, sorted."""
    return F.sort_array(F.array_except(actual, expected))


def keyed_diff(a: DataFrame, b: DataFrame, key: str | list[str], columns: list[str]) -> DataFrame:
    """DIFF-1: keys added, removed or modified between two tables, with the columns that differ."""
    keys = [key] if isinstance(key, str) else key
    x = a.select(*keys, F.struct(*columns).alias("a"))
    y = b.select(*keys, F.struct(*columns).alias("b"))
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(differ) > 0, "modified")
    out = x.join(y, keys, "full_outer").select(*keys, change.alias("change"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), differ).alias("columns"))
    return out.where("change is not null")


def symbol_cdc(before: DataFrame, after: DataFrame) -> DataFrame:
    """DIFF-2: (file_path, qualified_name, state) by the set of hashes under a name."""
    sets = lambda df, n: df.groupBy("file_path", "qualified_name").agg(F.sort_array(F.collect_set("sym_hash")).alias(n))
    both = sets(before, "h0").join(sets(after, "h1"), ["file_path", "qualified_name"], "full_outer")
    state = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed")
    return both.select("file_path", "qualified_name", state.alias("state")).where("state is not null")


def chain_diffs(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """DIFF-3: two diffs (file_path, qualified_name, state) in a row as one.

    added + removed is nothing, added + changed is added, removed + added is changed;
    else the later state.
    """
    both = earlier.withColumnRenamed("state", "s0").join(later.withColumnRenamed("state", "s1"), ["file_path", "qualified_name"], "full_outer")
    s0, s1 = F.col("s0"), F.col("s1")
    state = (
        F.when((s0 == "added") & (s1 == "removed"), None).when((s0 == "added") & (s1 == "changed"), "added")
        .when((s0 == "removed") & (s1 == "added"), "changed").otherwise(F.coalesce(s1, s0))
    )
    return both.select("file_path", "qualified_name", state.alias("state")).where("state is not null")


def merge_symbol_diffs(stored: DataFrame, new: DataFrame) -> DataFrame:
    """DIFF-3 on the stored table: chains a file's diff if it continues the stored one, else replaces it."""
    s = stored.select("file_path", F.struct("from_hash", "to_hash", "added", "removed", "changed").alias("s"))
    n = new.select("file_path", F.struct("from_hash", "to_hash", "added", "removed", "changed").alias("n"))
    both = s.join(n, "file_path", "full_outer")
    goes_on = F.col("s").isNotNull() & F.col("n").isNotNull() & (F.col("s.to_hash") == F.col("n.from_hash"))
    none = F.array().cast("array<string>")
    g = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), none)
    # Names by their state before and after, as in chain_diffs.
    added = F.array_union(F.array_except(g("s", "added"), g("n", "removed")), F.array_except(g("n", "added"), g("s", "removed")))
    changed = F.array_union(F.array_union(F.array_except(F.array_except(g("s", "changed"), g("n", "removed")), g("n", "added")), F.array_except(g("n", "changed"), g("s", "added"))), F.array_intersect(g("s", "removed"), g("n", "added")))
    removed = F.array_union(F.array_except(F.array_except(g("s", "removed"), g("n", "added")), g("n", "changed")), F.array_except(g("n", "removed"), g("s", "added")))
    pick = lambda c, merged: F.when(goes_on, F.sort_array(merged)).otherwise(F.sort_array(F.coalesce(F.col(f"n.{c}"), F.col(f"s.{c}"))))
    return both.select(
        "file_path",
        F.when(goes_on, F.col("s.from_hash")).otherwise(F.coalesce("n.from_hash", "s.from_hash")).alias("from_hash"),
        F.coalesce("n.to_hash", "s.to_hash").alias("to_hash"),
        pick("added", added).alias("added"), pick("removed", removed).alias("removed"), pick("changed", changed).alias("changed"),
    )


def three_way(baseline: DataFrame, design: DataFrame | None, live: DataFrame | None, key: str = "id", value: str = "value") -> DataFrame:
    """DIFF-4: state of each key over baseline, design and live."""
    b = baseline.select(key, F.col(value).alias("b"), F.lit(True).alias("in_b"))
    none = b.limit(0)
    d = (design if design is not None else none.withColumnRenamed("b", value)).select(key, F.col(value).alias("d"), F.lit(True).alias("in_d"))
    v = (live if live is not None else none.withColumnRenamed("b", value)).select(key, F.col(value).alias("v"), F.lit(True).alias("in_v"))
    j = b.join(d, key, "full_outer").join(v, key, "full_outer")
    has = lambda c: F.coalesce(F.col(f"in_{c}"), F.lit(False))
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    if design is None:
        state = F.when(~has("b"), "live_only").when(~has("v"), "deleted_from_live").when(same("b", "v"), "unchanged").otherwise("live_only")
    elif live is None:
        state = F.when(~has("b"), "added").when(~has("d"), "removed").when(same("b", "d"), "unchanged").otherwise("design_only")
    else:
        state = (
            F.when(~has("b") & has("d") & has("v"), F.when(same("d", "v"), "implemented").otherwise("conflict"))
            .when(~has("b") & has("d"), "added")
            .when(~has("b") & has("v"), "live_only")
            .when(~has("d") & ~has("v"), "removed")
            .when(~has("d"), "removed")
            .when(~has("v"), "deleted_from_live")
            .when(same("d", "v"), F.when(same("b", "d"), "unchanged").otherwise("converged"))
            .when(same("b", "v"), "design_only")
            .when(same("b", "d"), "live_only")
            .otherwise("conflict")
        )
    return j.select(key, state.alias("state"))


def api_consistency(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """DIFF-5: functions (file, name, signature) as matched, mismatched, missing or unexpected."""
    e = expected.select("file", "name", F.col("signature").alias("want"), F.lit(1).alias("ine"))
    a = actual.select("file", "name", F.col("signature").alias("have"), F.lit(1).alias("ina"))
    state = F.when(F.col("ina").isNull(), "missing").when(F.col("ine").isNull(), "unexpected").when(F.col("want").eqNullSafe(F.col("have")), "matched").otherwise("mismatched")
    return e.join(a, ["file", "name"], "full_outer").select("file", "name", state.alias("state"))


def drift(consistency: DataFrame) -> DataFrame:
    """DIFF-5: per file stale, missing_impl, both or clean."""
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    out = consistency.groupBy("file").agg(n("unexpected", "mismatched").alias("stale"), n("missing").alias("missing"))
    state = F.when((F.col("stale") > 0) & (F.col("missing") > 0), "both").when(F.col("stale") > 0, "stale").when(F.col("missing") > 0, "missing_impl").otherwise("clean")
    return out.select("file", state.alias("drift"))


def contract_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """DIFF-6: undefined references (file, line, ident) that are new."""
    return after.join(before.select("file", "line", "ident").distinct(), ["file", "line", "ident"], "left_anti")


def contract_gate(after: DataFrame, skipped: DataFrame) -> DataFrame:
    """DIFF-6: ok only without any undefined reference; files skipped by extension are counted."""
    return after.agg(F.count("*").alias("undefined")).join(skipped.agg(F.count("*").alias("skipped"))).withColumn("ok", F.col("undefined") == 0)


def behavior_diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """DIFF-7: cases (case, outcome) that are new, gone, changed or same."""
    b, c = baseline.select("case", F.col("outcome").alias("b"), F.lit(1).alias("inb")), current.select("case", F.col("outcome").alias("c"), F.lit(1).alias("inc"))
    state = F.when(F.col("inb").isNull(), "new").when(F.col("inc").isNull(), "gone").when(F.col("b").eqNullSafe(F.col("c")), "same").otherwise("changed")
    return b.join(c, "case", "full_outer").select("case", state.alias("state"))


def reanchor(anchors: DataFrame, symbols: DataFrame) -> DataFrame:
    """DIFF-8: anchors (id, path, node_id, signature, orphaned) against symbols (node_id, path, signature).

    By path first, else the least node of equal signature: retained, migrated (other
    node), stale (same node, other signature), orphaned; orphans are not tried again.
    """
    by_path = symbols.groupBy("path").agg(F.min(F.struct("node_id", "signature")).alias("p"))
    by_sig = symbols.groupBy("signature").agg(F.min("node_id").alias("s"))
    live = anchors.join(by_path, "path", "left").join(by_sig, "signature", "left")
    node = F.coalesce("p.node_id", "s")
    state = (
        F.when(F.coalesce("orphaned", F.lit(False)), "orphaned").when(node.isNull(), "orphaned").when(node != F.col("node_id"), "migrated")
        .when(F.col("p.signature").isNotNull() & ~F.col("p.signature").eqNullSafe(F.col("signature")), "stale").otherwise("retained")
    )
    return live.select("id", F.when(state == "orphaned", None).otherwise(node).alias("node_id"), state.alias("state"))
