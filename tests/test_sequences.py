"""Debounce, quota, token bucket and flushes in pieces, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import sequences as S
from lodestar.operators import windows as W
from lodestar.streaming import events as V


def cut(rng, t):
    places = np.sort(rng.choice(np.arange(1, len(t)), min(rng.integers(0, 6), len(t) - 1), replace=False)) if len(t) > 1 else []
    return np.split(t, places)


def plain_quota(times, most, span):
    taken, ok = [], []
    for t in times:
        taken = [x for x in taken if x > t - span]
        ok.append(len(taken) < most)
        taken += [t] * ok[-1]
    return ok


def plain_bucket(times, unit, refill, cap):
    tokens, at, ok = cap, None, []
    for t in times:
        tokens = cap if at is None else min(cap, tokens + (t - at) * refill)
        ok.append(tokens >= unit)
        tokens, at = tokens - unit * ok[-1], t
    return ok


def test_pieces_pass_on_the_true_state():
    """Whatever the cuts, the states told by the pieces' tables give the decisions of one pass."""
    rng = np.random.default_rng(7)
    for _ in range(1500):
        t = np.sort(rng.integers(0, int(rng.choice([30, 200, 3000])), int(rng.integers(1, 60))))
        span, wait = int(rng.integers(1, 60)), int(rng.integers(1, 120))
        rate, burst = float(rng.choice([0.5, 2, 7, 100, 1 / 3])), float(rng.choice([1, 2, 2.5, 10]))
        bucket, slow = S.Bucket(rate, burst), t * int(rng.choice([1, 10, 100]))
        for machine, times, want in (
            (S.Debounce(span), t, plain_quota(t, 1, span)),
            (bucket, slow, plain_bucket(slow.tolist(), bucket.unit, bucket.refill, bucket.cap)),
            (S.Flush(span, wait), np.unique(t), None),
        ):
            state, got = machine.start(), []
            for p in cut(rng, times):
                got += machine.decide(state, p)[: len(p)].tolist()
                left = machine.leave(state, int(p[0]), int(p[-1]), machine.table(p))
                assert left == machine.follow(state, p)
                state = left
            assert want is None or got == want


def test_bucket_counts_in_whole_numbers():
    b = S.Bucket(200.0, 200.0)
    assert (b.unit, b.refill, b.cap) == (5, 1, 1000)
    assert S.Bucket(1 / 3600, 2.0).unit == 3_600_000 and S.Bucket(2.0, 2.5).cap == 1250
    assert [S.Bucket(1.0, 1.0).decide([1000, S.NEVER], np.array([0, 999, 1000])).tolist()] == [[True, False, True]]


def test_a_quota_is_sure_of_its_state_whatever_came_before():
    rng = np.random.default_rng(8)
    known = 0
    for _ in range(2000):
        t = np.sort(rng.integers(0, 400, int(rng.integers(1, 40))))
        most, span = int(rng.integers(1, 5)), int(rng.integers(1, 60))
        found = S.sure_state(t, most, span)
        if found:
            known += 1
            before = sorted(rng.integers(t[0] - span, t[0] + 1, most).tolist())
            after = S.quota_run(before, t[: found[0] + 1], most, span)[1]
            assert [x for x in after if x > t[found[0]] - span] == found[1]
    assert known > 300


@pytest.fixture(scope="module")
def hot(spark):
    """One probe with most events, in bursts and at rest, others with few; repeated times and a null probe."""
    rng, rows = random.Random(3), []
    for k in range(6000):
        probe = "hot" if k % 3 else f"p{k % 30}" if k % 5 else None
        rows.append((probe, int(rng.random() ** 2 * 400_000) // 7 * 7, k))
    # Small tables would be put together into one piece.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.createDataFrame(rows, "probe string, time_ms long, seq long").repartition(6).cache()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("most", "span"), [(1, 900), (1, 1), (3, 2000), (10, 60_000)])
def test_quota_of_a_hot_key(hot, most, span):
    want = {}
    for probe in {r.probe for r in hot.select("probe").distinct().collect()}:
        mine = sorted((r.time_ms, r.seq) for r in hot.where(F.col("probe").eqNullSafe(F.lit(probe))).collect())
        want |= {seq: ok for (_, seq), ok in zip(mine, plain_quota([t for t, _ in mine], most, span), strict=True)}
    got = W.accepted_quota(hot, "probe", "time_ms", most, span)
    assert {r.seq: r.accepted for r in got.collect()} == want and got.columns == [*hot.columns, "accepted"]


def test_bucket_of_a_hot_key(hot):
    rule, want = S.Bucket(5.0, 8.0), {}
    for probe in {r.probe for r in hot.select("probe").distinct().collect()}:
        mine = sorted((r.time_ms, r.seq) for r in hot.where(F.col("probe").eqNullSafe(F.lit(probe))).collect())
        want |= {seq: ok for (_, seq), ok in zip(mine, plain_bucket([t for t, _ in mine], rule.unit, rule.refill, rule.cap), strict=True)}
    assert {r.seq: r.accepted for r in V.limit_batch(hot, 5.0, 8.0).collect()} == want


def doubles(times, rate, burst):
    tokens, at, ok = burst, None, []
    for t in times:
        tokens = burst if at is None else min(burst, tokens + (t - at) / 1000 * rate)
        ok.append(tokens >= 1)
        tokens, at = tokens - ok[-1], t
    return ok


def test_bucket_in_doubles_is_the_plain_sum():
    rng = np.random.default_rng(9)
    for _ in range(1000):
        t = np.sort(rng.integers(0, int(rng.choice([30, 1000, 20_000, 10**6])), int(rng.integers(1, 150))))
        rate, burst = float(rng.choice([0.5, 7, 1 / 3, 100, 1 / 3600])), float(rng.choice([0.5, 1, 2, 2.5, 10]))
        bucket, got = S.RealBucket(rate, burst), []
        state = bucket.start()
        for p in cut(rng, t):
            ok, state = bucket.run(state, p)
            got += ok.tolist()
        assert got == doubles(t.tolist(), rate, burst)


@pytest.mark.parametrize(("rate", "burst", "rest"), [(1000 / 70, 3.0, 0), (1 / 7, 2.0, 0), (1000 / 700, 2.0, 7_000)])
def test_bucket_in_doubles_of_a_hot_key(hot, rate, burst, rest):
    """As SQL counts: sums that come near 1 are rounded, step by step; with rests, and without any."""
    events = hot.withColumn("time_ms", F.col("time_ms") + F.expr(f"{rest} * (time_ms div 20000)"))
    want, whole = {}, {}
    for probe in {r.probe for r in events.select("probe").distinct().collect()}:
        mine = sorted((r.time_ms, r.seq) for r in events.where(F.col("probe").eqNullSafe(F.lit(probe))).collect())
        times, rule = [t for t, _ in mine], S.Bucket(rate, burst)
        want |= {seq: ok for (_, seq), ok in zip(mine, doubles(times, rate, burst), strict=True)}
        whole |= {seq: ok for (_, seq), ok in zip(mine, plain_bucket(times, rule.unit, rule.refill, rule.cap), strict=True)}
    assert {r.seq: r.accepted for r in V.limit_batch(events, rate, burst, whole=False).collect()} == want != whole


def test_flushes_of_a_hot_project(hot):
    changes = hot.select(F.col("probe").alias("project"), F.concat(F.lit("f"), F.col("seq") % 4).alias("path"), "time_ms", F.lit("changed").alias("change")).where("project is not null")
    want = {}
    rows = [tuple(r) for r in changes.collect()]
    for project in {r[0] for r in rows}:
        times = sorted({t for p, _, t, _ in rows if p == project})
        due = dict(zip(times, V.flush_times(times, 150, 2000), strict=True))
        for p, path, t, _ in rows:
            if p == project:
                want[p, due[t], path] = want.get((p, due[t], path), 0) + 1
    assert {(r.project, r.flush_ms, r.path): r.n for r in V.flush_changes(changes).collect()} == want


def test_no_piece_holds_a_whole_hot_key(hot):
    dealt = S.pieces(hot, "probe", "time_ms")
    sizes = [r["count"] for r in dealt.where("probe = 'hot'").groupBy("_piece").count().collect()]
    assert len(sizes) >= 2 and max(sizes) <= 0.6 * 6000
    assert S.decided(hot.limit(0), "probe", "time_ms", S.Debounce(5)).count() == 0 and S.quota(hot.limit(0), "probe", "time_ms", 2, 5).count() == 0
