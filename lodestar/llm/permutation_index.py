"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order in which it sees a set of pivots.  It is posted to
the inverted file of each of its nearest pivots.  A query visits the files of its own
nearest pivots, ranks their entries by the footrule distance between the orders, and
scores the best by the true cosine.

There are 8 * sqrt(n) pivots for n vectors, so files hold about sqrt(n) entries.  Orders
are those of the first 256 pivots, which are spread out.  How near an entry's order must be is read off a
sample of vectors for each query, so that about as many entries are scored exactly at
any number of vectors.  Files are cut into pieces of bounded size, and so are a file's
queries: a pivot that many vectors share is dealt over many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.scratch import Scratch

#: Pivots: PIVOT_RATE * sqrt(n), at most a quarter of the vectors, within these bounds.  The
#: upper one bounds what workers hold (131 MB at 64 dimensions); it is reached at 10**9 vectors.
PIVOT_RATE, MIN_PIVOTS, MAX_PIVOTS = 8, 16, 1 << 18
#: Pivots of an order.
ORDER = 256
#: Files that a vector is posted to; files that a query visits, VISIT_RATE * pivots**0.6 over
#: POSTED (all if the pivots are few).
POSTED, VISIT_RATE, FEW = 6, 9, 96
#: Entries scored exactly: about SLACK * RERANK for a query, by a sample of SAMPLE vectors.
RERANK, SLACK, SAMPLE = 256, 4, 4096
#: Of one piece of a file, at most this many entries are scored for a query.
PIECE_RERANK = 256
#: Entries of a piece of a file, and queries that meet it in one task.
PIECE, QUERY_PIECE = 4096, 8192
FAR = (1 << 31) - 1


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that no square overflows or vanishes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, initial=0))[1][:, None])


def unit(vectors: np.ndarray) -> np.ndarray:
    v = scaled(vectors)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def usable(vector_col: str) -> F.Column:
    """Vectors that take part: no null, NaN or infinite component, and not all zero."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def nearest_pivots(units: np.ndarray, pivots: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the ``size`` nearest pivots, nearest first, equal ones by number."""
    near = -(units @ pivots.T)
    size = min(size, near.shape[1])
    top = np.argpartition(near, size - 1, axis=1)[:, :size] if size < near.shape[1] else np.tile(np.arange(size), (len(near), 1))
    return np.take_along_axis(top, np.lexsort((top, np.take_along_axis(near, top, 1)), axis=1), 1)


def spread(points: np.ndarray, size: int) -> np.ndarray:
    """Numbers of ``size`` points, each the farthest from those before it; the first is point 0."""
    size = min(size, len(points))
    out, far = [0], 1 - points @ points[0]
    while len(out) < size:
        out.append(int(far.argmax()))
        far = np.minimum(far, 1 - points @ points[out[-1]])
    return np.array(out)


def choose_pivots(points: np.ndarray, size: int) -> np.ndarray:
    """Up to ``size`` of the points; the first ORDER are spread out, for the orders.

    Of the rest, points that see the same three of those first are alike: two of them are
    taken at most, so that a dense cluster does not take up the nearest pivots of all
    vectors around it.
    """
    first = spread(points[: 4 * ORDER], min(ORDER, size))
    rest = np.setdiff1d(np.arange(len(points)), first)
    if len(rest) and size > len(first):
        seen = np.concatenate([nearest_pivots(points[rest[a : a + 4096]], points[first], 3) for a in range(0, len(rest), 4096)])
        kind = np.unique(seen, axis=0, return_inverse=True)[1].reshape(-1)
        by = np.argsort(kind, kind="stable")
        place = np.empty(len(kind), np.int64)
        place[by] = np.arange(len(kind)) - np.searchsorted(kind[by], kind[by], "left")
        rest = rest[place < 2][: size - len(first)]
    return points[np.concatenate([first, rest[: size - len(first)]])]


def ranks(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The rank of each of up to 256 pivots in each vector's order."""
    order = np.argsort((units @ -pivots.T).astype(np.float32), axis=1)
    out = np.empty(order.shape, np.int16)
    np.put_along_axis(out, order, np.arange(len(pivots), dtype=np.int16)[None], 1)
    return out


def footrule(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Footrule distances (queries, entries): sums over pivots of the difference in rank.

    A sum over 256 pivots of at most 255 fits 16 bits.
    """
    own, others = queries.T, np.ascontiguousarray(entries.T)[:, None]
    out = np.empty((len(queries), len(entries)), np.uint16)
    step = max(1, 1024 // max(1, len(entries)))
    far = np.empty((len(own), step, len(entries)), np.int16)
    for at in range(0, len(queries), step):
        part = own[:, at : at + step, None]
        view = far[:, : part.shape[1]]
        np.abs(np.subtract(others, part, out=view), out=view)
        np.add.reduce(view.view(np.uint16), axis=0, dtype=np.uint16, out=out[at : at + step])
    return out


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _post(share, dims: int, files: int, near: int | None):
    """Adds a vector's files and, with ``near``, how far its ``near`` + 1st of the sample is."""

    def run(batches):
        pivots, sample = share.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                u = unit(_vectors(piece.column(1), dims))
                chosen = nearest_pivots(u, pivots, files).astype(np.int32)
                upto = np.full(len(u), FAR)
                if near is not None and near < len(sample):
                    own = ranks(u, pivots[:ORDER])
                    for i in range(len(u)):
                        upto[i] = np.partition(footrule(own[i : i + 1], sample)[0], near)[near]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * chosen.shape[1]), pa.array(chosen.reshape(-1)))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), lists, pa.array(upto, pa.int64())], ["id", "vector", "files", "upto"])

    return run


def _best(q_ids, q_vectors, q_ranks, upto, ids, vectors, entry_ranks, k: int, rerank: int):
    """(query, entry, score): the ``k`` best of some entries for each query, by id where equal."""
    own, norms = np.sqrt((q_vectors * q_vectors).sum(1)), np.sqrt((vectors * vectors).sum(1))
    step = max(1, (1 << 20) // max(1, len(ids)))
    for at in range(0, len(q_ids), step):
        far = footrule(q_ranks[at : at + step], entry_ranks)
        keep = (far <= upto[at : at + step, None]) & (q_ids[at : at + step, None] != ids[None])
        for i in np.flatnonzero(keep.sum(1) > rerank):
            # Ties in the footrule go to smaller ids: entries are in that order.
            found = np.flatnonzero(keep[i])
            keep[i] = False
            keep[i, found[np.argsort(far[i, found], kind="stable")[:rerank]]] = True
        q, e = np.nonzero(keep)
        score = (vectors[e] * q_vectors[at + q]).sum(1) / (norms[e] * own[at + q])
        by = np.lexsort((ids[e], -score, q))
        q, e, score = q[by], e[by], score[by]
        first = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
        yield q_ids[at + q[first]], ids[e[first]], score[first]


def _search(share, dims: int, k: int, rerank: int):
    """Meets the queries of a block, which come first, with its entries, a batch at a time."""

    def run(batches):
        pivots = share.value[0][:ORDER]
        block, asked = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            ids, upto = batch.column(4).to_numpy(), batch.column(6).to_numpy()
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                at = tuple(keys[a, :3])
                if at != block:
                    block, asked = at, []
                if keys[a, 3] and not asked:
                    continue
                raw = scaled(_vectors(batch.column(5).slice(a, b - a), dims))
                order = np.concatenate([ranks(unit(raw[c : c + 2048]), pivots) for c in range(0, len(raw), 2048)])
                if not keys[a, 3]:
                    asked.append((ids[a:b], raw, order, upto[a:b]))
                    continue
                if len(asked) > 1:
                    asked = [tuple(np.concatenate(x) for x in zip(*asked, strict=True))]
                q_ids, q_raw, q_order, q_upto = asked[0]
                for c in range(0, b - a, PIECE):
                    own = slice(c, c + PIECE)
                    out += _best(q_ids, q_raw, q_order, q_upto, ids[a:b][own], raw[own], order[own], k, rerank)
            if out:
                columns = [np.concatenate(x) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None, visited: int | None = None, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found of each query, by cosine.

    Every usable row of ``vectors`` is indexed; a query's own id is no candidate.  Ties
    go to smaller ids; ids that repeat count once, with the best score.  Of equal vectors
    the k + 1 smallest ids stand for all: no query can return others.  Vectors that are
    null, zero or hold null or non-finite components take no part, on either side.  Vectors
    of each length are searched on their own, one index after the other.  With no usable
    vectors or queries the result is empty; a query with fewer than ``k`` candidates has
    them all as long as its files hold them.

    ``pivots`` and ``visited`` default to the rules above; ``rerank`` is about a quarter
    of what is scored exactly.  The exact search is ``visited`` = ``pivots`` with
    ``rerank`` no less than the number of vectors: then every pair is scored, in blocks.
    """
    spark = vectors.sparkSession
    box = Scratch(spark, "permutations")
    nothing = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    pick = lambda df: df.where(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.xxhash64(vector_col).alias("h1"), F.xxhash64(F.lit(1), vector_col).alias("h2"))
    # Partial limits before each shuffle keep a row or a vector that a third of all rows share small.
    first = lambda df, by, most: df.withColumn("copy", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("copy") <= most)
    once = lambda df: first(df, ["h1", "h2", "id"], 1).drop("copy")
    rows = box.keep(first(once(pick(vectors)), ["h1", "h2"], k + 1).drop("h1", "h2"), "rows")
    asked = once(pick(queries))
    found = None
    # One index for each length of vector.
    for dims, n in sorted(tuple(r) for r in rows.groupBy(F.size("vector")).count().collect()):
        fits = F.size("vector") == dims
        part = _nearest_of(rows.where(fits), asked.where(fits).select("id", "vector"), dims, n, k, pivots, visited, rerank, box)
        found = part if found is None else found.union(part)
    return nothing if found is None else found.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _nearest_of(rows: DataFrame, asked: DataFrame, dims: int, n: int, k: int, pivots: int | None, visited: int | None, rerank: int, box: Scratch) -> DataFrame:
    """``nearest`` among the ``n`` vectors of one length."""
    spark = rows.sparkSession
    m = pivots or min(MAX_PIVOTS, max(MIN_PIVOTS, min(int(PIVOT_RATE * math.sqrt(n)), n // 4)))
    # At most 1.5 * MAX_PIVOTS + 4 * ORDER vectors, no two equal, come to the driver, and SAMPLE to judge distances by.
    order = [F.xxhash64("id"), F.col("id")]
    chosen = rows.where("copy = 1").orderBy(*order).limit(m + m // 2 + 4 * ORDER).select("vector").toArrow()
    sample = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE).select("vector").toArrow()
    points = choose_pivots(unit(_vectors(chosen.column(0).combine_chunks(), dims)), m)
    judged = np.concatenate([ranks(unit(_vectors(c, dims)), points[:ORDER]) for c in sample.column(0).chunks if len(c)])
    share = spark.sparkContext.broadcast((points, judged))
    m = len(points)
    visited = min(m, visited or max(FEW, math.ceil(VISIT_RATE * m**0.6 / POSTED)))
    near = max(4, math.ceil(SLACK * rerank / n * len(judged)))
    # The sample only bounds: where it cannot, all entries of the files are ranked and the best scored.
    per_piece = max(PIECE_RERANK, rerank if SLACK * rerank >= n else 0)

    kind = f"id long, vector {rows.schema['vector'].dataType.simpleString()}, files array<int>, upto long"
    index = box.keep(rows.select("id", "vector").mapInArrow(_post(share, dims, min(POSTED, m), None), kind), f"index{dims}")
    looks = box.keep(asked.mapInArrow(_post(share, dims, visited, near), kind), f"looks{dims}")
    each = lambda df: df.withColumn("pivot", F.explode("files")).drop("files")
    cut = lambda df, size, name: each(df.select("files")).groupBy("pivot").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    # One row for each pivot, at most MAX_PIVOTS.
    cuts = F.broadcast(cut(index, PIECE, "pieces").join(cut(looks, QUERY_PIECE, "parts"), "pivot"))
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["pivot", "piece", "part", "kind", "id", "vector", "upto"]
    entries = each(index).join(cuts, "pivot").withColumn("piece", part("pieces")).withColumn("part", every("parts")).withColumn("kind", F.lit(1)).select(columns)
    looks = each(looks).join(cuts, "pivot").withColumn("part", part("parts")).withColumn("piece", every("pieces")).withColumn("kind", F.lit(0)).select(columns)
    block = ["pivot", "piece", "part"]
    met = looks.union(entries).repartition(*block).sortWithinPartitions(*block, "kind", "id")
    found = met.mapInArrow(_search(share, dims, k, per_piece), "query_id long, id long, score double")
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
