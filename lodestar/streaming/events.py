"""Structured Streaming over events and file changes (STR-1, STR-7 to STR-10, STR-18)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.functions.scalars import log2_bucket
from lodestar.operators import sequences
from lodestar.sources.store import Lease


def stream_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 20) -> DataFrame:
    """STR-7: files of a folder as a stream, so many in a batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def stream_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines of event files as a stream of parsed events; bad lines have a null probe."""
    from lodestar.sources.events import parse_lines

    return parse_lines(spark.readStream.text(path))


def run_to_end(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """STR-1: feeds all that is there to ``handle`` batch by batch, then stops.

    A batch that fails is read again from the checkpoint.
    """
    q = df.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def dedupe_changes(changes: DataFrame) -> DataFrame:
    """STR-1: of the changes (path, time, change) of one batch the last of each path."""
    return changes.groupBy("path").agg(F.max_by("change", "time").alias("change"), F.max("time").alias("time"))


def flush_times(times: list[int], window_ms: int, max_wait_ms: int) -> list[int]:
    """STR-1: when each change, of ascending times, is flushed.

    Each change puts the flush off to ``window_ms`` after itself; once ``max_wait_ms`` have
    gone by since the last flush it comes at once.
    """
    out, pending, due, last = [], 0, None, None
    for t in times:
        if due is not None and due < t:
            out += [due] * pending
            pending, last, due = 0, due, None
        pending += 1
        due = t if last is not None and t - last >= max_wait_ms else t + window_ms
        if due == t:
            out += [t] * pending
            pending, last, due = 0, t, None
    return out + [due] * pending


def flush_changes(changes: DataFrame, window_ms: int = 150, max_wait_ms: int = 2000) -> DataFrame:
    """STR-1: (project, flush_ms, path, change, n) of changes (project, path, time_ms, change).

    A flush holds the last change of each path since the one before, and how many there
    were.  A project's times are dealt over many tasks, and so are the changes.
    """
    at = sequences.flush_points(changes, "project", "time_ms", sequences.Flush(window_ms, max_wait_ms))
    grouped = changes.join(at.withColumnRenamed("flush", "flush_ms"), ["project", "time_ms"]).groupBy("project", "flush_ms", "path")
    return grouped.agg(F.max_by("change", F.struct("time_ms", "change")).alias("change"), F.count("*").alias("n"))


class ChangeFlusher(StatefulProcessor):
    """STR-1 on a stream: the changes of a project are held, the last of each path, and flushed together.

    A change puts the flush off by ``window_ms`` of the clock, by a timer; when
    ``max_wait_ms`` have gone by since the last flush it comes at once.  Time is that of
    the batch, so a batch that fails comes again with the state as it was.
    """

    def __init__(self, window_ms: int = 150, max_wait_ms: int = 2000):
        self.window_ms, self.max_wait_ms = window_ms, max_wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "path string", "change string, time_ms long, n long")
        self.times = handle.getValueState("times", "due_ms long, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        due, last = self.times.get() if self.times.exists() else (0, -1)
        for pdf in rows:
            for r in pdf.sort_values("time_ms", kind="stable").itertuples():
                change, at, n = self.held.getValue((r.path,)) if self.held.containsKey((r.path,)) else (r.change, r.time_ms, 0)
                self.held.updateValue((r.path,), (r.change if r.time_ms >= at else change, max(at, r.time_ms), n + 1))
        if due:
            self.handle.deleteTimer(due)
        if last >= 0 and now - last >= self.max_wait_ms:
            yield from self._flush(key, now)
        else:
            self.times.update((now + self.window_ms, last))
            self.handle.registerTimer(now + self.window_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._flush(key, timerValues.getCurrentProcessingTimeInMs())

    def _flush(self, key, now: int) -> Iterator[pd.DataFrame]:
        held = [(key[0], now, path[0], *value) for path, value in self.held.iterator()]
        self.held.clear()
        self.times.update((0, now))
        if held:
            yield pd.DataFrame(held, columns=["project", "flush_ms", "path", "change", "time_ms", "n"])

    def close(self) -> None:
        pass


def flush_stream(changes: DataFrame, window_ms: int = 150, max_wait_ms: int = 2000) -> DataFrame:
    """STR-1: flushes (project, flush_ms, path, change, time_ms, n) of a stream (project, path, change, time_ms)."""
    schema = "project string, flush_ms long, path string, change string, time_ms long, n long"
    return changes.groupBy("project").transformWithStateInPandas(ChangeFlusher(window_ms, max_wait_ms), schema, "append", "processingTime")


def backfill(files: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, lease_s: float = 600.0) -> bool:
    """STR-7: runs a stream of files to its end, chunk by chunk; False if another run holds the flight.

    The flight is a lease beside the checkpoint, renewed with each chunk.  A run that was
    killed loses it after ``lease_s``; the next one goes on from the checkpoint.
    """
    flight = Lease(files.sparkSession, f"{checkpoint}.flight", lease_s)
    if not flight.take():
        return False

    def held(df: DataFrame, batch: int) -> None:
        flight.renew()
        handle(df, batch)

    try:
        run_to_end(files, held, checkpoint)
    finally:
        flight.release()
    return True


def live_counters(events: DataFrame) -> DataFrame:
    """STR-10: hits, errors by .catch and errors of each probe, kept up to date."""
    return events.groupBy("probe").agg(F.count("*").alias("hits"), F.count_if(F.coalesce(F.length("err"), F.lit(0)) > 0).alias("errs"))


def live_histogram(events: DataFrame) -> DataFrame:
    """STR-10: events by probe and power-of-two bucket, kept up to date."""
    return events.groupBy("probe", log2_bucket(F.col("dur_us")).alias("bucket")).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: events by probe and tumbling window of event time, with a watermark."""
    return events.withWatermark("time", late).groupBy(F.window("time", size), "probe").agg(F.count("*").alias("n"))


class TokenBucket(StatefulProcessor):
    """STR-8: at most ``rate`` events a second for each probe; idle buckets may expire.

    A full bucket is as good as none, so expiry changes no decision.
    """

    def __init__(self, rate: float = 200.0, burst: float | None = None, idle_ms: int | None = None):
        self.rule, self.idle_ms = sequences.Bucket(rate, burst or rate), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens long, at_ms long", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = list(self.bucket.get()) if self.bucket.exists() else self.rule.start()
        pdf = pd.concat(list(rows)).sort_values("time_ms", kind="stable")
        # A late event counts as one of the time up to which the bucket is known.
        times = pdf["time_ms"].clip(lower=state[1]).to_numpy()
        ok = self.rule.decide(state, times)
        self.bucket.update(tuple(self.rule.follow(state, times)))
        yield pdf[ok][["probe", "time_ms"]]

    def close(self) -> None:
        pass


def rate_limit(events: DataFrame, rate: float = 200.0, burst: float | None = None, idle_ms: int | None = None) -> DataFrame:
    """STR-8 on a stream (probe, time_ms).

    With ``idle_ms`` (300,000, say) idle buckets expire by the
    clock.  Such a query has work without input and suits running streams only, not
    those that end when all that is there has been read.
    """
    bucket = TokenBucket(rate, burst, idle_ms)
    return events.groupBy("probe").transformWithStateInPandas(bucket, "probe string, time_ms long", "append", "processingTime" if idle_ms else "none")


def limit_batch(events: DataFrame, rate: float, burst: float, whole: bool = True) -> DataFrame:
    """STR-8 on a table: adds ``accepted``; a probe's events, in order of time, are dealt over many tasks.

    Tokens are whole numbers of the smallest step, or, without ``whole``, doubles added
    up event by event, as a plain loop or SQL does.
    """
    bucket = (sequences.Bucket if whole else sequences.RealBucket)(rate, burst)
    return sequences.decided(events.select("probe", "seq", "time_ms"), "probe", "time_ms", bucket)


class ByteRing(StatefulProcessor):
    """STR-9: the last events of a probe within a budget of bytes; the oldest give way.

    Events stand under running numbers, so a batch writes those it adds and removes those
    it evicts, whatever the ring holds.  An event beyond the whole budget is held alone.
    """

    def __init__(self, budget: int):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("events", "number long", "seq long, bytes long")
        self.ends = handle.getValueState("ends", "head long, tail long, bytes long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        head, tail, held = self.ends.get() if self.ends.exists() else (0, 0, 0)
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        sizes = pdf["bytes"].to_numpy()
        # Of a large batch only the end can stay.
        after = sizes[::-1].cumsum()[::-1] - sizes
        keep = (after + sizes <= self.budget) | (after == 0)
        if not keep.all():
            for k in range(head, tail):
                self.events.removeKey((k,))
            head, held = tail, 0
        for seq, size in zip(pdf["seq"][keep].tolist(), sizes[keep].tolist(), strict=True):
            self.events.updateValue((tail,), (seq, size))
            tail, held = tail + 1, held + size
            while held > self.budget and tail - head > 1:
                held -= self.events.getValue((head,))[1]
                self.events.removeKey((head,))
                head += 1
        self.ends.update((head, tail, held))
        yield pd.DataFrame({"probe": [key[0]], "held": [tail - head], "bytes": [held], "oldest": [self.events.getValue((head,))[0]], "newest": [self.events.getValue((tail - 1,))[0]]})

    def close(self) -> None:
        pass


def byte_ring(events: DataFrame, budget: int = 64 << 20) -> DataFrame:
    """STR-9 on a stream (probe, seq, bytes): what each probe's ring holds after a batch."""
    return events.groupBy("probe").transformWithStateInPandas(ByteRing(budget), "probe string, held long, bytes long, oldest long, newest long", "update", "none")


def recent_ring(events: DataFrame, most: int = 1000) -> DataFrame:
    """STR-9 on a stream (probe, seq): per probe the sequence numbers of the last ``most`` events.

    Last by number, however the rows of a batch, or of several, come in.  Events without
    a number are held while there are too few others.
    """
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring, bare = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for pdf in batches:
            none = pdf["none"].to_numpy(bool)
            ring = sorted(ring + pdf["seq"][~none].nlargest(most).tolist())[-most:]
            bare = min(most, bare + int(none.sum()))
        state.update((ring, bare))
        yield pd.DataFrame({"probe": [key[0]], "held": [min(most, len(ring) + bare)], "oldest": pd.array(ring[:1] or [None], "Int64"), "newest": pd.array(ring[-1:] or [None], "Int64")})

    told = events.select("probe", F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), F.col("seq").isNull().alias("none"))
    return told.groupBy("probe").applyInPandasWithState(run, "probe string, held long, oldest long, newest long", "ring array<long>, bare long", "update", GroupStateTimeout.NoTimeout)


class Simulation:
    """STR-18: an event-driven state machine with set, increment, decrement, push, pop and move.

    rules: {event: [(action, target, value)]}; an emit recurses depth first, at most
    ``max_depth`` deep.
    """

    def __init__(self, rules: dict[str, list[tuple]], state: dict, max_depth: int = 100):
        self.rules, self.state, self.max_depth, self.trace = rules, dict(state), max_depth, []

    def fire(self, event: str, depth: int = 0) -> None:
        if depth > self.max_depth:
            raise RecursionError(f"{event} keeps emitting")
        self.trace.append(event)
        for action, target, value in self.rules.get(event, []):
            s = self.state
            if action == "set":
                s[target] = value
            elif action in ("increment", "decrement"):
                s[target] = s.get(target, 0) + (value or 1) * (1 if action == "increment" else -1)
            elif action == "push":
                s[target] = [*s.get(target, []), value]
            elif action == "pop":
                s[target] = s.get(target, [])[:-1]
            elif action == "move":
                have = s.get(target, [])
                if have:
                    s[target], s[value] = have[:-1], [*s.get(value, []), have[-1]]
            elif action == "emit":
                self.fire(target, depth + 1)
            else:
                raise ValueError(action)


def simulate(events: DataFrame, rules: dict[str, list[tuple]], initial: dict, order: str = "seq") -> DataFrame:
    """STR-18 by simulation (sim, event, order): final state as JSON and the events fired."""
    import json

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = Simulation(rules, initial)
        for e in pdf.sort_values(order)["event"]:
            m.fire(e)
        return pd.DataFrame({"sim": [pdf["sim"].iloc[0]], "state": [json.dumps(m.state, sort_keys=True)], "fired": [len(m.trace)]})

    return events.groupBy("sim").applyInPandas(run, "sim string, state string, fired long")
