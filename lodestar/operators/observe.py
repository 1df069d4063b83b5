"""Judging of probe events (STR-11 to STR-17): expressions that work in batch and stream alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed operations whose errors a benign mark excuses.
BENIGN_OPS = ("remove", "remove-tmp", "cleanup")
BLAST_LIMIT = 50

Rule = Callable[[], Column]


def silent_error() -> Column:
    """A non-empty error, unless it is marked benign and the operation only cleans up."""
    excused = F.coalesce(F.col("op").isin(*BENIGN_OPS), F.lit(False)) & F.coalesce("benign", F.lit(False))
    return (F.coalesce(F.length("err"), F.lit(0)) > 0) & ~excused


def unplanned_spread() -> Column:
    """Files touched that were not expected."""
    return F.coalesce(F.size("unexpected"), F.lit(0)) > 0


def blast_radius(limit: int = 0) -> Column:
    """Direct and indirect impact of an ``impact.`` probe beyond the limit (0: the default)."""
    reach = F.coalesce("direct", F.lit(0)) + F.coalesce("indirect", F.lit(0))
    return F.startswith("probe", F.lit("impact.")) & (reach > (limit or BLAST_LIMIT))


#: Rules by name, in the order in which the first one that holds is reported.
RULES: dict[str, Rule] = {"silent-error-discard": silent_error, "unplanned-spread": unplanned_spread, "blast-radius": blast_radius}


def judge(events: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """STR-11: the first rule each event breaks, null if none.  Stateless, so streams too.

    ``rules`` are an open registry: a name and an expression over the event's columns.
    """
    verdict = F.lit(None).cast("string")
    for name, rule in reversed(list((rules or RULES).items())):
        verdict = F.when(rule(), F.lit(name)).otherwise(verdict)
    return events.withColumn("rule", verdict)


def compare_contract(profile: DataFrame, events: DataFrame, decls: DataFrame) -> DataFrame:
    """STR-12: (kind, rule, probe): unobserved, violated and undesigned probes.

    decls (rule, probe, expect, limit); a probe of '' stands for all.  profile has a row
    for each probe (probe, events, errs, most); ``expect`` is observed, no-err or
    dur-below.
    """
    named = decls.where("probe <> ''")
    unseen = named.join(profile.select("probe"), "probe", "left_anti").select(F.lit("unobserved").alias("kind"), "rule", "probe")
    every = decls.where("probe = ''").drop("probe")
    # Declarations are a design document's rules: a small table joined to one row a probe.
    asked = named.join(profile, "probe").select("rule", "probe", "expect", "limit", "errs", "most").union(profile.join(every).select("rule", "probe", "expect", "limit", "errs", "most"))
    broken = ((F.col("expect") == "no-err") & (F.col("errs") > 0)) | ((F.col("expect") == "dur-below") & (F.col("most") >= F.col("limit")))
    violated = asked.where(broken).select(F.lit("violated"), "rule", "probe")
    free = profile.join(named.select("probe"), "probe", "left_anti").select(F.lit("undesigned"), F.lit("").alias("rule"), "probe")
    return unseen.union(violated).union(free)


def prefix_length(sequence: Column, want: list[str]) -> Column:
    """STR-13: how many of ``want`` occur in order in a sequence, from its first on."""
    wanted = F.array(*[F.lit(w) for w in want]).cast("array<string>")
    return F.aggregate(sequence, F.lit(0), lambda i, s: F.when(F.get(wanted, i) == s, i + 1).otherwise(i))


def chain_matches(chains: DataFrame, want: list[str]) -> DataFrame:
    """STR-13: per chain the matched prefix and if the whole of ``want`` is a subsequence."""
    n = prefix_length(F.col("sequence"), want)
    return chains.withColumn("matched", n).withColumn("complete", F.col("matched") == len(want))


def best_chain(chains: DataFrame, want: list[str]) -> DataFrame:
    """STR-13: the chain with the longest matched prefix among those that hold the root."""
    held = chain_matches(chains, want).where(F.array_contains("sequence", want[0]) if want else F.lit(True))
    return held.orderBy(F.desc("matched"), "trace_id").limit(1)


def needles(events: DataFrame, pattern: str = "(?i)error|fail|panic") -> DataFrame:
    """STR-14: all events of traces that hold a keep mark or an error text."""
    marked = events.groupBy("trace_id").agg(F.bool_or(F.coalesce("keep", F.lit(False)) | F.coalesce(F.col("err").rlike(pattern), F.lit(False))).alias("hit"))
    return events.join(marked.where("hit").select("trace_id"), "trace_id", "left_semi")


def incidents(events: DataFrame, last: int = 50) -> DataFrame:
    """STR-15: for each error the events of its trace up to it, at most ``last``, oldest first.

    Events are numbered along their trace; only errors fetch the blocks of events that
    their windows reach into.
    """
    numbered = events.withColumn("_k", F.row_number().over(Window.partitionBy("trace_id").orderBy("time", "seq")))
    errors = numbered.where(silent_error())
    block = lambda c: F.floor(c / last).cast("int")
    asked = errors.select(F.col("trace_id").alias("t"), F.col("_k").alias("to"), F.explode(F.array_distinct(F.array(block(F.col("_k")), block(F.col("_k") - (last - 1))))).alias("b"))
    pool = numbered.select("trace_id", "_k", block(F.col("_k")).alias("_b"), "seq", "probe")
    met = pool.join(asked, F.col("trace_id").eqNullSafe(F.col("t")) & (F.col("_b") == F.col("b")) & F.col("_k").between(F.col("to") - (last - 1), F.col("to")))
    held = met.groupBy("t", "to").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "seq", "probe"))), lambda x: F.struct(x["seq"].alias("seq"), x["probe"].alias("probe"))).alias("window"))
    return errors.join(held, F.col("trace_id").eqNullSafe(F.col("t")) & (F.col("_k") == F.col("to"))).drop("_k", "t", "to")


def inbox(alerts: DataFrame, cursor: int, most: int = 10) -> DataFrame:
    """STR-16: the newest alerts with an id beyond the cursor, newest first."""
    return alerts.where(F.col("id") > cursor).orderBy(F.desc("id")).limit(most)


def design_trigger(profile: DataFrame, deviations: DataFrame, ledger: DataFrame, repeats: DataFrame, min_undesigned: int, min_rate: float) -> DataFrame:
    """STR-17: one row of counts and whether the design loop starts, and why.

    Undesigned probes reach their minimum; or violations per event do; or the ledger's
    rate does; or some source repeats.
    """
    d = deviations.agg(F.count_if(F.col("kind") == "undesigned").alias("undesigned"), F.count_if(F.col("kind") == "violated").alias("violated"))
    out = d.join(profile.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("events"))).join(ledger.select(F.col("rate").alias("ledger_rate"))).join(repeats.agg(F.count("*").alias("repeats")))
    rate = F.when(F.col("events") > 0, F.col("violated") / F.col("events")).otherwise(0.0)
    why = (
        F.when(F.col("undesigned") >= min_undesigned, "undesigned").when(rate >= min_rate, "deviation-rate")
        .when(F.col("ledger_rate") >= min_rate, "ledger-rate").when(F.col("repeats") > 0, "repeat-spread")
    )
    return out.withColumn("why", why).withColumn("triggered", F.col("why").isNotNull())


def propose(deviations: DataFrame, profile: DataFrame, frozen: DataFrame) -> DataFrame:
    """STR-17: declarations proposed for undesigned probes that are not frozen yet."""
    free = deviations.where("kind = 'undesigned'").select("probe").join(frozen.select("probe"), "probe", "left_anti")
    return free.join(profile, "probe").select("probe", F.when(F.col("errs") == 0, "no-err").otherwise("observed").alias("expect"), F.lit("proposed").alias("status"))


def freeze(store: DataFrame, proposals: DataFrame) -> DataFrame:
    """STR-19: the append-only store with the proposals as the next version."""
    top = store.agg(F.coalesce(F.max("version"), F.lit(0)).alias("top"))
    return store.unionByName(proposals.join(top).select((F.col("top") + 1).cast("int").alias("version"), "probe", "expect", F.lit("frozen").alias("status")))


def roll_back(store: DataFrame, version: int) -> DataFrame:
    """STR-19: the store with an old version again, as a new one."""
    top = store.agg(F.max("version").alias("top"))
    old = store.where(F.col("version") == version).join(top).select((F.col("top") + 1).cast("int").alias("version"), *[c for c in store.columns if c != "version"])
    return store.unionByName(old)


def current(store: DataFrame) -> DataFrame:
    """STR-19: the rows of the latest version."""
    return store.join(store.agg(F.max("version").alias("version")), "version", "left_semi")
