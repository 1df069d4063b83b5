"""Centroid clustering with Drake's adaptive bounds, exact in integers.

A vector keeps an upper bound of the distance to its centroid, lower bounds to the few
centroids next to it, in order, and one lower bound for all the rest.  When centroids
move the bounds widen by how far; distances are computed anew only up to the first bound
that certifies the order, and to all centroids only where none does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.scratch import Scratch
from lodestar.llm.whitening import usable

SIZE, SCALE, CENTROIDS, ROUNDS = 64, 256, 40, 5
#: Entries beyond this count as this: squared distances stay within 64 bits.
LIMIT = 1 << 27
#: Below this all sums of products are exact in doubles.
EXACT = 1 << 22

_STATE = "id long, x binary, cluster int, upper double, near binary, lower binary, rest double, used int"


@dataclass
class Bounds:
    """The state of n vectors: cluster, upper bound, b nearest others, their bounds, that of the rest."""

    cluster: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    rest: np.ndarray
    used: np.ndarray


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors: x (n, d) to c (k, d), or to c (n, m, d) row by row."""
    if c.ndim == 3:
        away = x[:, None, :] - c
        return np.einsum("nmd,nmd->nm", away, away)
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def scan(x: np.ndarray, c: np.ndarray, b: int) -> Bounds:
    """Bounds from the distances to all centroids; of equal ones the smaller number is nearer."""
    d = squared(x, c)
    order = np.argsort(d, 1, kind="stable")
    root = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    n, k = d.shape
    rest = root[:, b + 1] if b + 1 < k else np.full(n, np.inf)
    return Bounds(order[:, 0], root[:, 0], order[:, 1 : b + 1], root[:, 1 : b + 1], rest, np.full(n, b, np.int64))


def certified(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Whether a distance is below another one for sure, whatever was rounded on the way."""
    return upper < lower - 1e-6 - 1e-9 * np.abs(lower)


def advance(x: np.ndarray, c: np.ndarray, moved: np.ndarray, old: Bounds, b: int) -> Bounds:
    """The state of ``x`` after the centroids, now ``c``, moved by the distances ``moved``.

    With the own distance computed anew, the first bound above it, in order, ends the
    search: only the centroids before it can have come nearer, and they and the own one
    are ordered by exact distances.  A vector that no bound certifies is scanned in full.
    ``used`` is how many bounds that took.  ``b`` bounds are kept, no more than before.
    """
    n, held = old.near.shape
    upper = old.upper + moved[old.cluster]
    lower, rest = old.lower - moved[old.near], old.rest - moved.max(initial=0)
    if b < held:
        # What is no longer listed is part of the rest.
        rest = np.minimum(rest, lower[:, b:].min(1))
    new = Bounds(old.cluster.copy(), upper, old.near[:, :b].copy(), lower[:, :b].copy(), rest.copy(), np.zeros(n, np.int64))
    b = new.near.shape[1]
    # A bound holds for its centroid and all after it.
    floor = np.minimum.accumulate(np.concatenate([new.lower, rest[:, None]], 1)[:, ::-1], 1)[:, ::-1]
    open_ = np.flatnonzero(~certified(upper, floor[:, 0]))
    if not len(open_):
        return new
    new.upper[open_] = np.sqrt(squared(x[open_], c[new.cluster[open_]][:, None, :])[:, 0].astype(np.float64))
    tests = certified(new.upper[open_][:, None], floor[open_])
    first = np.where(tests.any(1), tests.argmax(1), b + 1)
    new.used[open_] = np.minimum(first, b)
    for z in np.unique(first):
        at = open_[first == z]
        if z == b + 1:
            full = scan(x[at], c, b)
            for name in ("cluster", "upper", "near", "lower", "rest"):
                getattr(new, name)[at] = getattr(full, name)
        elif z:
            ids = np.sort(np.concatenate([new.cluster[at][:, None], new.near[at, :z]], 1), 1)
            for part in np.array_split(np.arange(len(at)), max(1, len(at) * (int(z) + 1) // 20_000)):
                d = squared(x[at[part]], c[ids[part]])
                order = np.argsort(d, 1, kind="stable")
                found, root = np.take_along_axis(ids[part], order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
                new.cluster[at[part]], new.upper[at[part]] = found[:, 0], root[:, 0]
                new.near[at[part], :z], new.lower[at[part], :z] = found[:, 1:], root[:, 1:]
    return new


def integers(vector: Column) -> Column:
    """floor(256 * x) of each entry, within the limits."""
    return F.transform(vector, lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c.cast("double") * SCALE))).cast("int"))


def _binary(x: np.ndarray, kind: type) -> pa.Array:
    """A binary value for each row of a matrix."""
    n, width = x.shape
    data = np.ascontiguousarray(x, kind)
    offsets = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (width * data.itemsize))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(data)])


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1) if n else np.zeros((0, 0), kind)


def _out(ids: pa.Array, x: np.ndarray, s: Bounds) -> pa.RecordBatch:
    arrays = [ids, _binary(x, np.int32), pa.array(s.cluster.astype(np.int32)), pa.array(s.upper), _binary(s.near, np.int16), _binary(s.lower, np.float64), pa.array(s.rest), pa.array(s.used.astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, ["id", "x", "cluster", "upper", "near", "lower", "rest", "used"])


def assign_first(kept: DataFrame, centroids: np.ndarray, b: int) -> DataFrame:
    """The state of all vectors (id, x array<int>) at the first centroids."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).values.to_numpy().reshape(batch.num_rows, SIZE) if batch.num_rows else np.zeros((0, SIZE))
            for at in range(0, batch.num_rows, 8192):
                part = x[at : at + 8192].astype(np.int64)
                yield _out(batch.column(0).slice(at, len(part)), part, scan(part, centroids, b))

    return kept.mapInArrow(run, _STATE)


def assign_next(state: DataFrame, centroids: np.ndarray, moved: np.ndarray, b: int) -> DataFrame:
    """The state after the centroids moved."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                x = _matrix(part.column(1), np.int32).astype(np.int64)
                old = Bounds(
                    part.column(2).to_numpy().astype(np.int64), part.column(3).to_numpy(), _matrix(part.column(4), np.int16).astype(np.int64).reshape(len(x), -1),
                    _matrix(part.column(5), np.float64).reshape(len(x), -1), part.column(6).to_numpy(), part.column(7).to_numpy(),
                )
                yield _out(part.column(0), x, advance(x, centroids, moved, old, b))

    return state.mapInArrow(run, _STATE)


def means(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The exact floors of the clusters' means, and the most bounds that a vector used.

    A task adds up its vectors by cluster; what meets is a row for each task and cluster.
    """
    k = len(centroids)

    def run(batches):
        total, count, used = np.zeros((k, SIZE), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            if batch.num_rows:
                cluster, x = batch.column(0).to_numpy(), _matrix(batch.column(1), np.int32).astype(np.int64)
                order = np.argsort(cluster, kind="stable")
                ids, first = np.unique(cluster[order], return_index=True)
                total[ids] += np.add.reduceat(x[order], first)
                count += np.bincount(cluster, minlength=k)
                used = max(used, int(batch.column(2).to_numpy().max()))
        held = np.flatnonzero(count)
        columns = [pa.array(held.astype(np.int32)), pa.array(count[held]), pa.array([used] * len(held), pa.int32()), pa.array(total[held].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "used", "total"])

    parts = state.select("cluster", "x", "used").mapInArrow(run, "cluster int, n long, used int, total array<long>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("used").alias("used"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(SIZE)])
    out, most = centroids.copy(), 0
    for r in sums.collect():  # one row for each centroid
        out[r.cluster] = [r[f"t{i}"] // r.n for i in range(SIZE)]
        most = max(most, r.used)
    return out, most


def first_centroids(kept: DataFrame, k: int) -> np.ndarray:
    """The vectors of the ``k`` least hashes of their ids; equal hashes by the vector, null ids last."""
    name = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = kept.select(name.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), SIZE)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids): (id, cluster, distance) of every usable vector, and the final centroids.

    Entries count as the integers floor(256 * x).  ``rounds`` times all vectors go to their
    nearest centroid (squared distance; of equal ones the smaller number) and centroids to
    the floor of their vectors' mean; then vectors are assigned once more.  An empty
    centroid stays.  The number of bounds starts at k / 4 and shrinks to what the last
    round used, but not below k / 8.

    Vectors that are null, of other than 64 entries, or hold a null or non-finite one are
    dropped.  Repeated rows count each; with fewer vectors than ``k`` there are as many
    centroids as vectors; an empty table gives none; other columns are not read.
    """
    spark = vectors.sparkSession
    box = Scratch(spark, "centroids")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(usable(F.col("v")) & (F.size("v") == SIZE))
    kept = rows.select("id", integers(F.col("v")).alias("x"))
    now = first_centroids(kept, k)
    if not len(now):
        return spark.createDataFrame([], "id long, cluster int, distance long").withColumnRenamed("id", id_col), now
    k = len(now)
    b = max(1, k // 4)
    state = box.keep(assign_first(kept, now, b), "state0")
    for step in range(1, rounds + 1):
        before, (now, used) = now, means(state, now)
        moved = np.sqrt(((now - before) ** 2).sum(1).astype(np.float64))
        b = min(b, max(used, k // 8, 1)) if step > 1 else b
        state = box.keep(assign_next(state, now, moved, b), f"state{step}")
        box.drop(f"state{step - 1}")

    def distances(batches):
        for batch in batches:
            ids = batch.column(1).to_numpy()
            d = [((_matrix(batch.column(2).slice(at, 8192), np.int32).astype(np.int64) - now[ids[at : at + 8192]]) ** 2).sum(1) for at in range(0, len(ids), 8192)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(d) if d else ids.astype(np.int64))], ["id", "cluster", "distance"])

    found = box.keep(state.select("id", "cluster", "x").mapInArrow(distances, "id long, cluster int, distance long"), "found")
    box.leave("found")
    return found.withColumnRenamed("id", id_col), now


def with_inertia(found: DataFrame, centroids: np.ndarray, id_col: str = "vec_id") -> DataFrame:
    """Adds the inertia of a row's cluster and of all, and the digest of its centroid.

    Sums beyond a long are null.
    """
    spark: SparkSession = found.sparkSession
    names = spark.createDataFrame([(i, ",".join(map(str, row))) for i, row in enumerate(centroids.tolist())], "c int, line string")
    total = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    # One row for each centroid, as are the names.
    sums = total.select(F.col("cluster").alias("c"), F.expr("try_cast(d as long)").alias("cluster_inertia"))
    whole = total.agg(F.expr("try_cast(sum(d) as long)").alias("inertia"))
    digest = names.select("c", F.sha2(F.col("line").cast("binary"), 256).alias("centroid_sha256"))
    facts = sums.join(F.broadcast(digest), "c").crossJoin(F.broadcast(whole))
    joined = found.join(F.broadcast(facts), found["cluster"] == facts["c"])
    return joined.select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """DuckDB SQL for op12 over embeddings: one assignment and one update for each round."""
    steps = [
        """kept AS (
  SELECT row_number() OVER () AS r, vec_id, x FROM (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)
), c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM kept ORDER BY h LIMIT 40))"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, arg_min(c, d * 64 + c) AS c, min(d) AS d FROM (SELECT r, c, CAST(list_sum(list_transform(list_zip(v.x, c{k}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept v, c{k}) GROUP BY r)""")
        if k < ROUNDS:
            steps.append(f"""s{k} AS (
  SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (
    SELECT a.c, u.i, sum(v.x[u.i])::BIGINT AS s, count(*) AS n FROM a{k} a JOIN kept v USING (r), UNNEST(range(1, 65)) AS u(i) GROUP BY a.c, u.i)
), c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(list(s.m ORDER BY s.i) FILTER (s.m IS NOT NULL), any_value(o.x)) AS x FROM c{k} o LEFT JOIN s{k} s ON o.c = s.c GROUP BY o.c)""")
    return f"""WITH {", ".join(steps)}
SELECT v.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(o.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN kept v USING (r) JOIN c{ROUNDS} o ON o.c = a.c"""


SQL = _sql()
