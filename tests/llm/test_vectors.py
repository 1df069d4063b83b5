"""Whitening and clustering of embeddings against plain numpy."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import centroids, queries, whitening
from tests.conftest import DATA

SCHEMA = "vec_id long, embedding array<float>, label int, id long, n long, component int, cluster int, v string"


def table(spark, vectors, parts=3):
    rows = [(i, v, 1, 2, 3, 4, 5, "v") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def sphere(n, d, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return [(i, [float(c) for c in row]) for i, row in enumerate((x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32))]


BAD = [(900, None), (901, [1.0] * 63 + [None]), (902, [math.nan] * 64), (903, [math.inf] + [0.0] * 63), (904, []), (None, None)]


# --- whitening


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_symmetric_qr(d):
    a = np.random.default_rng(d).normal(size=(2 * d, d))
    m = a.T @ a
    values, vectors = whitening.symmetric_qr(m)
    want = np.linalg.eigvalsh(m)[::-1]
    assert np.allclose(values, want, rtol=0, atol=1e-13 * want[0] * d)
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-13 and np.abs(vectors * values @ vectors.T - m).max() < 1e-13 * want[0] * d


def test_symmetric_qr_of_special_matrices():
    b = np.random.default_rng(1).normal(size=(9, 3))
    for m in (np.zeros((4, 4)), np.eye(5), np.ones((6, 6)), np.diag([0.0, 7, 0, 3]), b @ b.T, np.diag([1e12, 1, 1e-12]), np.array([[0.0, 1], [1, 0]])):
        values, vectors = whitening.symmetric_qr(m)
        assert np.abs(vectors * values @ vectors.T - m).max() <= 1e-13 * max(np.abs(m).max(), 1) and (np.diff(values) <= 0).all()


def test_welford_and_merge_equal_exact_sums():
    """Against exact rational arithmetic, with a common offset that would cost a plain sum its digits."""
    rng = np.random.default_rng(3)
    x = rng.integers(-40, 40, (300, 5)) + np.array([10**6, 10**9, 0, -(10**12), 7])
    parts = []
    for piece in np.array_split(x, [1, 2, 90, 200]):
        s = whitening.Stats.at(piece[0])
        for block in np.array_split(piece, 3):
            s.update(block)
        parts.append(s)
    whole = parts[0]
    for s in parts[1:]:
        whole.merge(s)
    away = x.astype(object) * 300 - x.astype(object).sum(0)
    exact = (away.T @ away).astype(float) / 300**3
    assert whole.n == 300 and [int(t) + 300 * int(o) for t, o in zip(whole.total, whole.origin, strict=True)] == x.astype(object).sum(0).tolist()
    assert np.allclose(whole.covariance(), exact, rtol=1e-11, atol=1e-9)


def brute_whitening(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 10**6
    n, total = len(x), x.sum(0)
    away = n * x - total
    v = (away / n).T @ (away / n) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return (away.astype(object) ** 2).sum(1), (away / n) @ u[:, :32] / np.sqrt(e[:32]), e[:32] / e.sum()


def test_whitening_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)  # several rounds of merging
    vectors = sphere(500, 64) + [(7, sphere(8, 64)[7][1]), (None, sphere(3, 64, 9)[2][1])]
    got = whitening.whiten(table(spark, vectors + BAD, 11)).where("size(whitened) > 0").collect()
    assert len(got) == len(vectors)
    deviation, white, explained = brute_whitening([v for _, v in vectors])
    place = {i: k for k, (i, _) in enumerate(vectors) if k < 500 or i is None}
    at = [place[r.vec_id] for r in got]
    y = np.array([r.whitened for r in got])
    sign = np.sign((y * white[at]).sum(0))
    assert np.abs(y * sign - white[at]).max() < 1e-9
    assert [r.deviation for r in got] == deviation[at].tolist() and {r.n for r in got} == {502}
    assert np.allclose(got[0].explained, explained, rtol=1e-10) and got[0].identity_error < 1e-10


def test_whitening_query(spark):
    got = queries.op11_whitening(spark, DATA)
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    r = got.agg(F.count("*"), F.min("component"), F.max("component"), F.max("identity_error"), F.countDistinct("identity_error")).first()
    assert tuple(r)[:3] == (32 * n, 1, 32) and r[3] <= 1e-4 and r[4] == 1


def test_whitening_of_awkward_vectors(spark):
    assert whitening.by_component(whitening.whiten(table(spark, []))).count() == 0
    assert whitening.whiten(table(spark, BAD)).count() == 1  # the empty vector, without components
    # Each length is a space of its own; equal vectors have no direction at all.
    vectors = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [1.0]), (4, [2.0]), (5, [3.0]), (6, [1.0, 2.0, 3.0]), (6, [3.0, 2.0, 1.0]), (7, [1e38, -1e38, 0.0])]
    got = {(r.vec_id, len(r.whitened)): r for r in whitening.whiten(table(spark, vectors)).collect()}
    assert got[1, 2].whitened == [None, None] and got[1, 2].explained == [0, 0] and got[1, 2].deviation == 0 and got[1, 2].identity_error is None
    assert [abs(round(got[i, 1].whitened[0], 9)) for i in (3, 4, 5)] == [1.224744871, 0, 1.224744871] and got[3, 1].deviation == 192**2
    assert got[7, 3].deviation is None and got[7, 3].n == 3


# --- clustering


def brute_clusters(vectors, rounds=5, k=40):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in vectors]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    now = [v for _, v in first]
    for step in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in now] for _, v in kept]
        at = [min(range(len(now)), key=lambda j: (row[j], j)) for row in d]
        if step < rounds:
            for j in range(len(now)):
                own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
                if own:
                    now[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return sorted(((i, a, row[a]) for (i, _), a, row in zip(kept, at, d, strict=True)), key=repr), now


@pytest.mark.parametrize("n", [0, 1, 39, 160])
def test_clusters_equal_brute_force(spark, n):
    vectors = sphere(n, 64, n)
    vectors += [(5, v) for i, v in vectors if i == 5] + [(1000 + k, vectors[3][1]) for k in range(60) if n > 3] + [(None, v) for _, v in vectors[:1]]
    found, now = centroids.cluster(table(spark, vectors + BAD))
    want, final = brute_clusters(vectors)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert now.tolist() == final


def test_inertia_and_digests(spark):
    vectors = sphere(90, 64, 4)
    rows = centroids.with_inertia(*centroids.cluster(table(spark, vectors))).collect()
    want, now = brute_clusters(vectors)
    for r in rows:
        assert r.inertia == sum(d for _, _, d in want) and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, now[r.cluster])).encode()).hexdigest()


def test_vectors_beyond_the_limit(spark):
    vectors = [(k, [float(k * 1e37)] + [0.5] * 63) for k in range(5)] + [(9, [-3e38] * 64)]
    found, _ = centroids.cluster(table(spark, vectors))
    assert found.count() == 6 and found.where("distance < 0").count() == 0


@pytest.mark.parametrize("spread", [0.02, 0.2, 5.0])
@pytest.mark.parametrize("size", [8, 1 << 23])
def test_bounds_never_miss_the_nearest(spread, size):
    """Twelve rounds of advance give the clusters of full scans, on data with structure and without, and with ties."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, spread, (80, 6)) for m in rng.normal(size=(12, 6))])
    x = np.floor(x * size).astype(np.int64)
    x[::7] = x[0]
    c, b = x[:: len(x) // 24][:24].copy(), 6
    c[5] = c[2]
    state, skipped = centroids.scan(x, c, b), 0
    for _ in range(12):
        full = centroids.squared(x, c).argmin(1)
        assert (state.cluster == full).all()
        before = c.copy()
        for j in range(len(c)):
            if (full == j).any():
                c[j] = x[full == j].sum(0) // (full == j).sum()
        moved = np.sqrt(((c - before) ** 2).sum(1).astype(float))
        b = max(3, min(b, int(state.used.max()))) if _ else b
        state = centroids.advance(x, c, moved, state, b)
        skipped += int((state.used < state.near.shape[1]).sum())
    assert skipped > len(x)


def test_clusters_need_no_full_scan_when_nothing_moves():
    x = np.random.default_rng(1).integers(-50, 50, (100, 4))
    c = x[:20].copy()
    state = centroids.advance(x, c, np.zeros(20), centroids.scan(x, c, 5), 5)
    assert (state.cluster == centroids.squared(x, c).argmin(1)).all()
