"""Whitening of embeddings: Welford updates in partitions, parallel merges, symmetric QR.

Means and covariances come from one pass: a partition iterator folds each vector into
its running mean and sum of products by a rank-one update, partitions are merged by the
parallel formula in groups of bounded size, and the covariance that is left, one matrix,
is solved by Householder reduction and QR steps with Wilkinson's shift.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.scratch import Scratch

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Statistics merged at a time.
FAN_IN = 32
#: Entries beyond this count as this; larger ones are no embedding's.
LIMIT = float(1 << 40)

_STATS = "size int, part long, n long, origin binary, total binary, mean binary, moment binary"


@dataclass
class Stats:
    """Count, exact sum, mean and sum of products of deviations of some vectors.

    Sum and mean are those of the distances from ``origin``, one of the vectors, so
    that a common offset of any size costs no digits.
    """

    n: int
    origin: np.ndarray
    total: np.ndarray
    mean: np.ndarray
    moment: np.ndarray

    @classmethod
    def at(cls, origin: np.ndarray) -> Stats:
        d = len(origin)
        return cls(0, origin.copy(), np.zeros(d, origin.dtype), np.zeros(d), np.zeros((d, d)))

    def update(self, vectors: np.ndarray) -> None:
        """Welford: folds the vectors in, one rank-one update each."""
        away = vectors - self.origin
        self.total += away.sum(0)
        mean, moment, n = self.mean, self.moment, self.n
        step = np.empty_like(moment)
        for x in away.astype(np.float64):
            n += 1
            before = x - mean
            mean += before / n
            np.multiply(before[:, None], x - mean, out=step)
            moment += step
        self.n = n

    def merge(self, other: Stats) -> None:
        """The statistics of both sets of vectors, by the parallel formula."""
        if not other.n:
            return
        n, apart = self.n + other.n, other.origin - self.origin
        delta = other.mean - self.mean + apart.astype(np.float64)
        self.moment += other.moment + np.outer(delta, delta) * (self.n * (other.n / n))
        self.mean += delta * (other.n / n)
        self.total += other.total + other.n * apart
        self.n = n

    def covariance(self) -> np.ndarray:
        return (self.moment + self.moment.T) / (2 * self.n)

    def row(self, size: int, part: int) -> dict:
        return {"size": size, "part": part, "n": self.n} | {k: getattr(self, k).tobytes() for k in ("origin", "total", "mean", "moment")}


def _from_row(row: dict, kind: type) -> Stats:
    d = len(row["mean"]) // 8
    origin, total = (np.frombuffer(row[k], kind).copy() for k in ("origin", "total"))
    return Stats(row["n"], origin, total, np.frombuffer(row["mean"]).copy(), np.frombuffer(row["moment"]).reshape(d, d).copy())


def _table(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("size", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), *((k, pa.binary()) for k in ("origin", "total", "mean", "moment"))]
    return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def by_size(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length in a batch."""
    lists = batch.column(batch.schema.get_field_index(column))
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(ends)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, values[ends[at][:, None] + np.arange(d)].astype(np.float64)


def to_integers(vectors: np.ndarray) -> np.ndarray:
    """floor(64 * c) + 1,000,000 of each entry c."""
    return np.floor(np.clip(vectors, -LIMIT, LIMIT) * SCALE).astype(np.int64) + SHIFT


def _merged(rows: DataFrame, kind: type, box: Scratch, name: str) -> dict[int, Stats]:
    """The statistics of each length of vector, merged FAN_IN at a time."""

    def merge(table: pa.Table) -> pa.Table:
        found = table.sort_by("part").to_pylist()
        whole = _from_row(found[0], kind)
        for other in found[1:]:
            whole.merge(_from_row(other, kind))
        return pa.Table.from_batches([_table([whole.row(found[0]["size"], found[0]["part"] // FAN_IN)])])

    step = 0
    rows = box.keep(rows, f"{name}0")
    while (rows.agg(F.max("part")).first()[0] or 0) > 0:
        step += 1
        rows = box.keep(rows.groupBy("size", F.expr(f"part div {FAN_IN}")).applyInArrow(merge, _STATS), f"{name}{step}")
    # One row for each length of vector.
    return {r["size"]: _from_row(r, kind) for r in rows.toArrow().to_pylist()}


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder: diagonal, subdiagonal and q with q @ T @ q.T the symmetric matrix."""
    a, d = matrix.copy(), len(matrix)
    q = np.eye(d)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        if not np.any(x[1:]):
            continue
        x /= np.abs(x).max()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        x /= np.linalg.norm(x)
        rest = a[k + 1 :, k:]
        rest -= 2 * np.outer(x, x @ rest)
        rest = a[k:, k + 1 :]
        rest -= 2 * np.outer(rest @ x, x)
        rest = q[:, k + 1 :]
        rest -= 2 * np.outer(rest @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix.

    Implicit QR steps with Wilkinson's shift on the tridiagonal form; a subdiagonal
    entry that no longer counts beside its neighbours splits the matrix.
    """
    diag, sub, q = tridiagonal(matrix)
    vectors = np.ascontiguousarray(q.T)  # a row for each eigenvector
    eps, hi = np.finfo(float).eps, len(diag) - 1
    for _ in range(60 * len(diag)):
        small = np.abs(sub) <= eps * (np.abs(diag[:-1]) + np.abs(diag[1:])) + np.finfo(float).tiny
        sub[small] = 0
        while hi > 0 and sub[hi - 1] == 0:
            hi -= 1
        if hi <= 0:
            break
        lo = hi
        while lo > 0 and sub[lo - 1] != 0:
            lo -= 1
        half, tail = (diag[hi - 1] - diag[hi]) / 2, sub[hi - 1]
        x = diag[lo] - (diag[hi] - tail * tail / (half + np.copysign(np.hypot(half, tail), half)))
        z = sub[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (1.0, 0.0) if r == 0 else (x / r, -z / r)
            if k > lo:
                sub[k - 1] = r
            a, b, e = diag[k], diag[k + 1], sub[k]
            diag[k] = c * c * a - 2 * c * s * e + s * s * b
            diag[k + 1] = s * s * a + 2 * c * s * e + c * c * b
            sub[k] = c * s * (a - b) + (c * c - s * s) * e
            if k < hi - 1:
                z, sub[k + 1] = -s * sub[k + 1], c * sub[k + 1]
                x = sub[k]
            upper, lower = vectors[k], vectors[k + 1]
            vectors[k], vectors[k + 1] = c * upper - s * lower, s * upper + c * lower
    else:
        raise ArithmeticError("QR steps did not converge")
    order = np.argsort(-diag, kind="stable")
    return diag[order], vectors[order].T


@dataclass(frozen=True)
class Whitener:
    """What whitens vectors of one length: their number, sum and leading directions."""

    n: int
    total: np.ndarray
    values: np.ndarray
    directions: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly; Python's integers take over where 64 bits may not do."""
        wide = self.n * (int(np.abs(x).max(initial=0)) + 1) * 2 >= 1 << 62
        return x.astype(object) * self.n - self.total if wide else x * self.n - self.total.astype(np.int64)

    def whiten(self, deviations: np.ndarray) -> np.ndarray:
        """Projections over the standard deviation; NaN along directions without variance."""
        centred = deviations.astype(np.float64) / self.n if deviations.dtype != object else (deviations / self.n).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            return centred @ self.directions / np.sqrt(np.where(self.values > 0, self.values, np.nan))


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, box: Scratch | None = None) -> dict[int, Whitener]:
    """Fits over all usable vectors; vectors of each length are a space of their own."""

    def run(batches):
        held: dict[int, Stats] = {}
        for batch in batches:
            for _, m in by_size(batch, "v"):
                x = to_integers(m)
                held.setdefault(x.shape[1], Stats.at(x[0])).update(x)
        yield _table([s.row(d, TaskContext.get().partitionId()) for d, s in held.items()])

    box = box or Scratch(vectors.sparkSession, "whitening")
    rows = vectors.select(F.col(vector_col).alias("v")).where(usable(F.col("v")) & (F.size("v") > 0))
    out = {}
    for d, s in _merged(rows.mapInArrow(run, _STATS), np.int64, box, "stats").items():
        values, directions = symmetric_qr(s.covariance())
        # Below this, an eigenvalue is rounding and its direction has no variance.
        values = np.where(values > d * np.finfo(float).eps * max(values[0], 0), values, 0.0)
        total = np.array([int(t) + s.n * int(o) for t, o in zip(s.total, s.origin, strict=True)], object)
        out[d] = Whitener(s.n, total, values[:components], directions[:, :components], float(np.trace(s.covariance())))
    return out


def identity_errors(vectors: DataFrame, model: dict[int, Whitener], vector_col: str = "embedding", box: Scratch | None = None) -> dict[int, float]:
    """For each length, the largest entry of the whitened vectors' covariance minus the identity.

    Measured by a second pass over all vectors; directions without variance are left out.
    """
    share = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        held: dict[int, Stats] = {}
        for batch in batches:
            for _, m in by_size(batch, "v"):
                w = share.value[m.shape[1]]
                y = w.whiten(w.deviations(to_integers(m)))[:, w.values > 0]
                if y.shape[1]:
                    held.setdefault(m.shape[1], Stats.at(np.zeros(y.shape[1]))).update(y)
        yield _table([s.row(d, TaskContext.get().partitionId()) for d, s in held.items()])

    box = box or Scratch(vectors.sparkSession, "whitening")
    rows = vectors.select(F.col(vector_col).alias("v")).where(usable(F.col("v")) & (F.size("v") > 0))
    found = _merged(rows.mapInArrow(run, _STATS), np.float64, box, "checks")
    return {d: float(np.abs(s.covariance() - np.eye(len(s.mean))).max()) for d, s in found.items()}


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error) for every usable row.

    An entry c counts as the integer floor(64 * c) + 1,000,000.  ``whitened`` holds the
    projections on the leading directions of variance, divided by its root; ``explained``
    their shares of all variance; ``deviation`` is the exact squared distance from the
    mean times n squared; ``identity_error`` is measured on the whitened vectors.

    Rows whose vector is null or holds a null or non-finite entry are dropped, and so
    have no part in the fit.  Vectors of each length are a space of their own; an empty
    vector has no component.  Along a direction without variance (equal vectors, fewer
    rows than entries) whitened is null and explained 0.  A deviation beyond a long is
    null.  Repeated rows and null ids count and come back each; an empty table gives
    none; other columns are not read.
    """
    box = Scratch(vectors.sparkSession, "whitening")
    model = fit(vectors, vector_col, components, box)
    errors = identity_errors(vectors, model, vector_col, box)
    box.leave()
    share = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at, m in by_size(batch, "v"):
                ids = batch.column(0).take(pa.array(at))
                if not m.shape[1]:
                    yield _whitened(ids, 0, [0] * len(at), np.zeros((len(at), 0)), np.zeros(0), 0.0)
                    continue
                w = share.value[m.shape[1]]
                away = w.deviations(to_integers(m))
                if int(np.abs(away).max()) ** 2 * m.shape[1] >= 1 << 63:
                    away = away.astype(object)
                squares = (away * away).sum(1).tolist()
                yield _whitened(ids, w.n, [x if x < 1 << 63 else None for x in squares], w.whiten(away), w.values / w.trace if w.trace else w.values, errors.get(m.shape[1]))

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    schema = "id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _whitened(ids: pa.Array, n: int, deviation: list, y: np.ndarray, explained: np.ndarray, error: float | None) -> pa.RecordBatch:
    rows, k = y.shape
    ends = pa.array(np.arange(rows + 1, dtype=np.int32) * k)
    flat = y.ravel()
    lists = [pa.ListArray.from_arrays(ends, pa.array(x, mask=np.isnan(x))) for x in (flat, np.tile(explained, rows))]
    columns = [ids, pa.array(np.full(rows, n)), pa.array(deviation, pa.int64()), *lists, pa.array([error] * rows, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, ["id", "n", "deviation", "whitened", "explained", "identity_error"])


def by_component(found: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A row for each vector and component, numbered from 1."""
    zipped = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return found.select(id_col, "n", "deviation", "identity_error", zipped).select(
        id_col, (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error"
    )
