"""Decisions that depend on earlier ones, without one task for a key (WIN-5, WIN-7, STR-1, STR-8).

Whether an event passes a debounce or a token bucket, or is flushed, depends on what was
decided before, so a key's events look like one long chain.  They are cut into pieces
by ranges of (key, time); each piece tells, for every state that may enter it, the state
that leaves it; the few numbers of each piece are folded along a key; then all pieces are
decided at once, each from its true state.  A key may be any share of the events.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.store import checkpoint

NEVER = -(1 << 62)


def pieces(events: DataFrame, key: str, time: str) -> DataFrame:
    """The events with ``_piece``: they are ordered by key, time and all else, and dealt by ranges."""
    rest = [c for c in events.columns if c not in (key, time)]
    dealt = events.repartitionByRange(key, time, *rest).withColumn("_piece", F.spark_partition_id())
    return checkpoint(dealt)


@dataclass(frozen=True)
class Debounce:
    """State: the time from which an event is accepted again."""

    span: int

    def start(self) -> list[int]:
        return [NEVER]

    def table(self, t: np.ndarray) -> np.ndarray:
        """(time, state): what leaves if the first event accepted is at that time, or a little before."""
        last = np.searchsorted(t, t + self.span)
        last = np.where(last < len(t), last, np.arange(len(t)))
        while not np.array_equal(last, hop := last[last]):  # to the end of each chain of accepted events
            last = hop
        first = slice(0, int(np.searchsorted(t, t[0] + self.span, "right")) + 1)
        return _runs(t[first], t[last[first]] + self.span)

    def leave(self, state: list[int], first: int, last: int, table: np.ndarray) -> list[int]:
        at = np.searchsorted(table[:, 0], state[0])
        return [int(table[at, 1])] if at < len(table) and state[0] <= last else state

    def decide(self, state: list[int], t: np.ndarray) -> np.ndarray:
        ok, at = np.zeros(len(t), bool), int(np.searchsorted(t, state[0]))
        while at < len(t):
            ok[at] = True
            at = int(np.searchsorted(t, t[at] + self.span))
        return ok

    def follow(self, state: list[int], t: np.ndarray) -> list[int]:
        taken = np.flatnonzero(self.decide(state, t))
        return [int(t[taken[-1]]) + self.span] if len(taken) else state


def _runs(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(key, value) with only the last key of a run of equal values."""
    keep = np.append(values[1:] != values[:-1], True)
    return np.stack([keys[keep], values[keep]], 1)


class Bucket:
    """Tokens in whole numbers: an event costs ``unit``, a millisecond gives ``refill``, ``cap`` at most.

    State: tokens, and the time they were counted at.
    """

    def __init__(self, rate: float, burst: float):
        per_ms = Fraction(rate).limit_denominator(10**9) / 1000
        whole = math.lcm(per_ms.denominator, Fraction(burst).limit_denominator(10**6).denominator)
        self.unit, self.refill, self.cap = whole, int(per_ms * whole), int(Fraction(burst).limit_denominator(10**6) * whole)
        by = math.gcd(self.unit, self.refill, self.cap)
        self.unit, self.refill, self.cap = self.unit // by, self.refill // by, self.cap // by

    def start(self) -> list[int]:
        return [self.cap, NEVER]

    def refilled(self, state: list[int], t: int) -> int:
        tokens, at = state
        return self.cap if at == NEVER else min(self.cap, tokens + max(0, t - at) * self.refill)

    def table(self, t: np.ndarray) -> np.ndarray:
        """(from, tokens, slope): tokens that leave, for those at the first event from a number on.

        All numbers are followed at once, as runs that move together (slope 1) or have met
        (slope 0); an event cuts one run in two at most, a full bucket joins many.  Once
        all have met, one number is followed.  Runs are no more than events, and than cap.
        """
        low, value, slope = np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64)

        def cut(at: int) -> None:
            """Cuts the runs that pass ``at`` on the way."""
            nonlocal low, value, slope
            size = np.diff(np.append(low, self.cap + 1))
            hit = np.flatnonzero((slope == 1) & (value < at) & (value + size - 1 >= at))
            if len(hit):
                low = np.insert(low, hit + 1, low[hit] + at - value[hit])
                value, slope = np.insert(value, hit + 1, at), np.insert(slope, hit + 1, 1)

        for k, wait in enumerate(np.diff(t, prepend=t[0]).tolist()):
            if wait:
                value += min(wait * self.refill, self.cap)
                cut(self.cap)
                full = value >= self.cap
                value[full], slope[full] = self.cap, 0
            cut(self.unit)
            value[value >= self.unit] -= self.unit
            if k % 16 == 0:
                keep = np.append(True, (slope[1:] == 1) | (slope[:-1] == 1) | (value[1:] != value[:-1]))
                low, value, slope = low[keep], value[keep], slope[keep]
            if len(low) == 1 and not slope[0]:
                rest = self.follow([int(value[0]), int(t[k])], t[k + 1 :])
                return np.array([[0, rest[0], 0]], np.int64)
        return np.stack([low, value, slope], 1)

    def follow(self, state: list[int], t: np.ndarray) -> list[int]:
        (tokens, at), refill, cap, unit = state, self.refill, self.cap, self.unit
        for now in t.tolist():
            tokens = cap if at == NEVER else min(cap, tokens + (now - at) * refill)
            tokens -= unit * (tokens >= unit)
            at = now
        return [tokens, at]

    def leave(self, state: list[int], first: int, last: int, table: np.ndarray) -> list[int]:
        tokens = self.refilled(state, first)
        low, value, slope = table[np.searchsorted(table[:, 0], tokens, "right") - 1].tolist()
        return [value + (tokens - low) * slope, last]

    def decide(self, state: list[int], t: np.ndarray) -> np.ndarray:
        ok = np.zeros(len(t), bool)
        for k, now in enumerate(t.tolist()):
            tokens = self.refilled(state, now)
            ok[k] = tokens >= self.unit
            state = [tokens - self.unit * bool(ok[k]), now]
        return ok


class RealBucket:
    """Tokens as doubles, added up event by event: min(burst, tokens + seconds * rate), less 1 where that is 1 or more.

    The sum depends on the rounding of every step, so whole numbers give other decisions
    where it comes near 1.  State: tokens, and the time they were counted at.
    """

    def __init__(self, rate: float, burst: float):
        self.rate, self.burst = rate, float(burst)

    def start(self) -> list[float]:
        return [self.burst, float(NEVER)]

    def sure(self, t: np.ndarray) -> bool:
        """Whether a pause between these events fills the bucket, whatever it held."""
        return bool((np.diff(t) / 1000 * self.rate >= self.burst).any())

    def run(self, state: list[float], t: np.ndarray) -> tuple[np.ndarray, list[float]]:
        """Which events are accepted, and the state after them."""
        ok, (tokens, at) = np.zeros(len(t), bool), state
        if not len(t):
            return ok, state
        seconds = np.maximum(np.diff(t, prepend=t[0] if at == NEVER else int(at)), 0) / 1000
        gain, least, burst = seconds * self.rate, min(1.0, self.burst), self.burst
        each, k, size = gain.tolist(), 0, 16
        while k < len(t):
            for k in range(k, min(k + 16, len(t))):
                tokens = min(burst, tokens + each[k])
                if tokens >= 1:
                    tokens -= 1
                    ok[k], size = True, 16
            k += 1
            # While all are refused the sum is a plain one, in the same order.
            while tokens < least and k < len(t) and not ok[max(k - 16, 0) : k].any():
                sums = np.add.accumulate(np.concatenate([[tokens], gain[k : k + size]]))[1:]
                n = int(np.argmax(sums >= least)) if sums[-1] >= least else len(sums)
                if n:
                    tokens, k = float(sums[n - 1]), k + n
                if n < len(sums):
                    break
                size = min(2 * size, 1 << 16)
        return ok, [tokens, float(t[-1])]

    def decide(self, state: list[float], t: np.ndarray) -> np.ndarray:
        return self.run(state, t)[0]

    def follow(self, state: list[float], t: np.ndarray) -> list[float]:
        return self.run(state, t)[1]


@dataclass(frozen=True)
class Flush:
    """State: the time of the last flush, and that of the event before.

    An event puts the flush off to ``window`` after itself; once ``wait`` have gone by
    since the last flush it comes at once.
    """

    window: int
    wait: int

    def start(self) -> list[int]:
        return [NEVER, NEVER]

    def step(self, state: list[int], t: int) -> int:
        """The last flush after an event at ``t``."""
        last, before = state
        if before not in (NEVER, last) and before + self.window < t:
            last = before + self.window
        return t if last != NEVER and t - last >= self.wait else last

    def follow(self, state: list[int], t: np.ndarray) -> list[int]:
        for now in t.tolist():
            state = [self.step(state, now), now]
        return state

    def table(self, t: np.ndarray) -> np.ndarray:
        """Rows (time, last flush that leaves if one is forced there first); two rows before them tell
        what leaves if the first event was flushed itself, and if the first pause comes first."""
        m = len(t)
        pause = np.append(np.flatnonzero(np.diff(t) > self.window) + 1, m)
        after = np.append(pause[np.searchsorted(pause, np.arange(m), "right")], m)  # the first pause after an event
        # Nodes: forced at event k; flushed in the pause before event k. Then what leaves unless one follows.
        quiet = np.append(NEVER, t[:-1] + self.window)
        then, left = np.full(2 * m, -1), np.concatenate([t, quiet])
        for k in range(m - 1, -1, -1):
            for node, last, skip in ((k, t[k], 1), (m + k, quiet[k], 0)):
                g = after[k + 1] if skip and after[k] == k + 1 else after[k]
                j = max(k + 1, int(np.searchsorted(t, last + self.wait)))
                if j < g:
                    then[node] = j
                elif g < m:
                    then[node] = g if t[g] - quiet[g] >= self.wait else m + g
                if then[node] >= 0:
                    left[node] = left[then[node]]
        g = int(after[0])
        end = left[g if t[g] - quiet[g] >= self.wait else m + g] if g < m else NEVER
        upto = min(g, int(np.searchsorted(t, t[0] + self.wait)) + 1, m)
        rows = _runs(t[1:upto], left[1:upto]) if upto > 1 else np.zeros((0, 2), np.int64)
        return np.concatenate([[[int(left[0]), int(end)]], [[int(g < m), 0]], rows])

    def leave(self, state: list[int], first: int, last: int, table: np.ndarray) -> list[int]:
        now = self.step(state, first)
        forced, rows = table[0, 0], table[2:]
        if now == first:
            return [int(forced), last]
        at = np.searchsorted(rows[:, 0], now + self.wait) if now != NEVER else len(rows)
        if at < len(rows):
            return [int(rows[at, 1]), last]
        return [int(table[0, 1]) if table[1, 0] else now, last]

    def decide(self, state: list[int], t: np.ndarray) -> np.ndarray:
        """The flush of each event; NEVER where it comes after the piece, -1 - f for a first event before which one came at f."""
        out, open_, early = np.full(len(t), NEVER, np.int64), 0, None
        for k, now in enumerate(t.tolist()):
            last, before = state
            if before not in (NEVER, last) and before + self.window < now:
                out[open_:k] = before + self.window
                early = before + self.window if k == 0 else early
                open_ = k
            state = [self.step(state, now), now]
            if state[0] == now:
                out[open_ : k + 1], open_ = now, k + 1
        return out if early is None else np.append(out, early)


def _group(run, columns: list[str], kind: pa.DataType, name: str):
    """A piece's rows in order, with the machine's answer as a column."""

    def decide(keys, rows, state):
        rows = rows.sort_by([(c, "ascending") for c in columns]).drop_columns(["_piece"])
        found = run(state.column("state")[0].as_py(), rows.column(columns[0]).to_numpy().astype(np.int64))
        return rows.append_column(name, pa.array(found, kind))

    return decide


def states(dealt: DataFrame, key: str, time: str, machine) -> DataFrame:
    """(key, _piece, state): the state that enters each piece, and the piece's first time."""

    kind = dealt.schema[key].dataType.simpleString()
    rows = dealt.select(F.col(key).alias("key"), "_piece", F.col(time).cast("long").alias("t"))
    # A row for each piece: as many as there are keys and partitions, together.
    along = Window.partitionBy("key")
    edges = rows.groupBy("key", "_piece").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    edges = checkpoint(edges.withColumns({"head": F.col("_piece") == F.min("_piece").over(along), "tail": F.col("_piece") == F.max("_piece").over(along)}))

    def told(keys, group, edge):
        t = np.sort(group.column("t").to_numpy().astype(np.int64))
        state, table = None, np.zeros((0, 1), np.int64)
        if edge.column("head")[0].as_py():  # what enters is known
            state = machine.follow(machine.start(), t)
        else:
            table = machine.table(t)
        return edge.drop_columns(["head", "tail"]).append_column("left", pa.array([state], pa.list_(pa.int64()))).append_column("width", pa.array([table.shape[1]], pa.int32())).append_column("table", pa.array([table.astype(np.int64).tobytes()]))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_piece")
        state, out = machine.start(), []
        for r in pdf.itertuples():
            out.append(state)
            if r.left is not None:
                state = [int(x) for x in r.left]
            elif r.table is not None:
                state = machine.leave(state, r.first, r.last, np.frombuffer(r.table, np.int64).reshape(-1, int(r.width)))
        return pdf[["key", "_piece"]].assign(state=out)

    # Nothing follows a key's last piece: what leaves it is not asked.
    needed = edges.where("not tail")
    same = [F.col("key").eqNullSafe(F.col("k")), F.col("_piece") == F.col("p")]
    inner = rows.join(needed.select(F.col("key").alias("k"), F.col("_piece").alias("p")), same[0] & same[1], "left_semi")
    schema = f"key {kind}, _piece int, first long, last long, left array<long>, width int, table binary"
    tables = inner.groupBy("key", "_piece").cogroup(needed.groupBy("key", "_piece")).applyInArrow(told, schema)
    ends = edges.where("tail").select("key", "_piece", "first", "last", F.lit(None).cast("array<long>"), F.lit(None).cast("int"), F.lit(None).cast("binary"))
    return checkpoint(tables.union(ends).groupBy("key").applyInPandas(fold, f"key {kind}, _piece int, state array<long>"))


def chained_states(dealt: DataFrame, key: str, time: str, machine: RealBucket) -> DataFrame:
    """(key, _piece, state): the state that enters each piece, where it depends on every event before.

    A piece with a sure pause passes on the same state whatever entered.  It and the
    pieces up to the next such one are a chain, whose times alone are followed in order,
    batch by batch; chains run side by side, and no task holds one.
    """
    kind = dealt.schema[key].dataType.simpleString()
    rows = dealt.select(F.col(key).alias("key"), "_piece", F.col(time).cast("long").alias("t"))

    def told(keys, group):
        sure = machine.sure(np.sort(group.column("t").to_numpy().astype(np.int64)))
        return pa.table({"key": group.column("key").slice(0, 1), "_piece": group.column("_piece").slice(0, 1), "sure": [sure]})

    # A row for each piece; ``own`` numbers them all, ``chain`` is the first of a chain.
    along = Window.partitionBy("key").orderBy("_piece")
    own = F.col("_piece").cast("long") * (1 << 32) + F.row_number().over(Window.partitionBy("_piece").orderBy("key"))
    edges = rows.groupBy("key", "_piece").applyInArrow(told, f"key {kind}, _piece int, sure boolean")
    edges = edges.withColumns({"own": own, "nth": F.sum(F.col("sure").cast("int")).over(along), "tail": F.lead("_piece").over(along).isNull()})
    edges = checkpoint(edges.withColumn("chain", F.min("own").over(Window.partitionBy("key", "nth"))))

    def follow(batches):
        at, chain, state = None, None, None
        for batch in batches:
            chains, owns, times = (batch.column(c).to_numpy() for c in ("chain", "own", "t"))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(owns)) + 1, [len(owns)]])
            left = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                if at is not None and owns[a] != at:
                    left.append((at, state))
                if chains[a] != chain:
                    chain, state = int(chains[a]), machine.start()
                at, state = int(owns[a]), machine.follow(state, times[a:b])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in left], pa.int64()), pa.array([x[1] for x in left], pa.list_(pa.float64()))], ["own", "left"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([state], pa.list_(pa.float64()))], ["own", "left"])

    # Nothing follows a key's last piece: what leaves it is not asked.
    needed = edges.where("not tail").select(F.col("key").alias("k"), F.col("_piece").alias("p"), "own", "chain")
    asked = rows.join(needed, F.col("key").eqNullSafe(F.col("k")) & (F.col("_piece") == F.col("p"))).select("chain", "own", "t")
    left = asked.repartition("chain").sortWithinPartitions("chain", "own", "t").mapInArrow(follow, "own long, left array<double>")
    start = F.array(*[F.lit(x) for x in machine.start()])
    found = edges.select("key", "_piece", "own").join(left, "own", "left")
    return checkpoint(found.select("key", "_piece", F.coalesce(F.lag("left").over(along), start).alias("state")))


def decided(events: DataFrame, key: str, time: str, machine, name: str = "accepted", kind: str = "boolean") -> DataFrame:
    """The events with the machine's decision in ``name``; a null key is a key like others."""
    dealt = pieces(events, key, time)
    entering = (chained_states if isinstance(machine, RealBucket) else states)(dealt, key, time, machine).withColumnRenamed("key", key)
    order = [time, *[c for c in events.columns if c not in (key, time)]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + f", {name} {kind}"
    run = _group(machine.decide, order, pa.bool_() if kind == "boolean" else pa.int64(), name)
    return dealt.groupBy(key, "_piece").cogroup(entering.groupBy(key, "_piece")).applyInArrow(run, schema)


def flush_points(events: DataFrame, key: str, time: str, machine: Flush) -> DataFrame:
    """(key, time, flush) for each distinct time of a key."""
    dealt = pieces(events.select(key, time).distinct(), key, time)
    entering = states(dealt, key, time, machine)
    kind = dealt.schema[key].dataType.simpleString()

    def run(keys, rows, state):
        t = np.sort(rows.column("t").to_numpy().astype(np.int64))
        found = machine.decide(state.column("state")[0].as_py(), t)
        early = int(found[-1]) if len(found) > len(t) else None
        found = found[: len(t)]
        known = found[found != NEVER]
        first = early if early is not None else int(known[0]) if len(known) else None
        n = len(t)
        return pa.table({"key": rows.column("key"), "_piece": pa.array([keys[1].as_py()] * n, pa.int32()), "t": t, "flush": pa.array(found, mask=found == NEVER), "first": pa.array([first] * n, pa.int64()), "due": pa.array([int(t[-1]) + machine.window] * n, pa.int64())})

    rows = dealt.select(F.col(key).alias("key"), "_piece", F.col(time).cast("long").alias("t"))
    done = checkpoint(rows.groupBy("key", "_piece").cogroup(entering.groupBy("key", "_piece")).applyInArrow(run, f"key {kind}, _piece int, t long, flush long, first long, due long"))
    # What a piece leaves open is flushed by the first flush of a later one, or when its last event is due.
    later = Window.partitionBy("key").orderBy("_piece").rowsBetween(1, Window.unboundedFollowing)
    ends = done.groupBy("key", "_piece").agg(F.min("first").alias("first"), F.max("due").alias("due"))
    ends = ends.select(F.col("key").alias("k"), F.col("_piece").alias("p"), F.min("first").over(later).alias("next"), F.max("due").over(later).alias("end"), F.col("due").alias("own"))
    joined = done.join(ends, F.col("key").eqNullSafe(F.col("k")) & (F.col("_piece") == F.col("p")))
    return joined.select(F.col("key").alias(key), F.col("t").alias(time), F.coalesce("flush", "next", "end", "own").alias("flush"))


def sure_state(t: np.ndarray, most: int, span: int) -> tuple[int, list[int]] | None:
    """(event, accepted times in the span up to it) where a quota's state is known, whatever came before.

    Events with at most ``most`` in the span up to them are accepted for sure; where all
    in a span are, they are the state.
    """
    before = np.searchsorted(t, t - span, "right")
    sure = (np.arange(len(t)) - before < most) & (t - span >= t[0])
    bad = np.concatenate([[0], np.cumsum(~sure)])
    found = np.flatnonzero(bad[np.arange(len(t)) + 1] == bad[before])
    if not len(found):
        return None
    k = int(found[-1])  # the last one leaves the least to follow
    return k, t[before[k] : k + 1].tolist()


def quota_run(taken: list[int], t: np.ndarray, most: int, span: int) -> tuple[np.ndarray, list[int]]:
    """Which events a quota accepts that has accepted ``taken``, and what it has taken after them."""
    held, ok = deque(taken, most), np.zeros(len(t), bool)
    for k, now in enumerate(t.tolist()):
        while held and held[0] <= now - span:
            held.popleft()
        if len(held) < most:
            ok[k] = True
            held.append(now)
    return ok, list(held)


def quota(events: DataFrame, key: str, time: str, most: int, span: int) -> DataFrame:
    """Adds ``accepted``: at most ``most`` accepted events in any ``span`` up to an event.

    What a piece passes on is known where its own events are so sparse, for one span, that
    all are accepted.  Pieces without such a stretch are decided together with the one
    before; only a key that never slows down is so one chain.
    """
    dealt = pieces(events, key, time)
    kind = dealt.schema[key].dataType.simpleString()
    rows = dealt.select(F.col(key).alias("key"), "_piece", F.col(time).cast("long").alias("t"))

    def known(keys, group):
        found = sure_state(np.sort(group.column("t").to_numpy().astype(np.int64)), most, span)
        return pa.table({"key": group.column("key").slice(0, 1), "_piece": group.column("_piece").slice(0, 1), "known": [found is not None]})

    along = Window.partitionBy("key").orderBy("_piece")
    told = rows.groupBy("key", "_piece").applyInArrow(known, f"key {kind}, _piece int, known boolean")
    chains = checkpoint(told.select(F.col("key").alias("k"), F.col("_piece").alias("p"), F.sum(F.col("known").cast("int")).over(along).alias("_chain")))
    chained = dealt.join(chains, F.col(key).eqNullSafe(F.col("k")) & (F.col("_piece") == F.col("p"))).drop("k", "p")

    def leaving(keys, group):
        t = np.sort(group.column("t").to_numpy().astype(np.int64))
        k, taken = sure_state(t, most, span) or (-1, [])
        return pa.table({"key": group.column("key").slice(0, 1), "_chain": [keys[1].as_py()], "state": pa.array([quota_run(taken, t[k + 1 :], most, span)[1]], pa.list_(pa.int64()))})

    left = chained.select(F.col(key).alias("key"), "_chain", F.col(time).cast("long").alias("t"))
    left = left.groupBy("key", "_chain").applyInArrow(leaving, f"key {kind}, _chain long, state array<long>")
    none = F.array().cast("array<long>")
    entering = left.select(F.col("key").alias(key), "_chain", F.coalesce(F.lag("state").over(Window.partitionBy("key").orderBy("_chain")), none).alias("state"))
    order = [time, *[c for c in events.columns if c not in (key, time)]]
    run = _group(lambda state, t: quota_run(state, t, most, span)[0], order, pa.bool_(), "accepted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", accepted boolean"
    dealt = chained.drop("_piece").withColumnRenamed("_chain", "_piece")
    return dealt.groupBy(key, "_piece").cogroup(entering.withColumnRenamed("_chain", "_piece").groupBy(key, "_piece")).applyInArrow(run, schema)
