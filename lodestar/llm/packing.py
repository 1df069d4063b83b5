"""Packing texts into batches: optimal length buckets and a token budget."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.order import number_rows
from lodestar.llm.scratch import Scratch

BUCKETS, BUDGET = 8, 16_384
#: Sums that the dynamic program holds at once.
CHUNK = 1 << 22


def word_count(text: Column) -> Column:
    """Runs of other than blanks in a text; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0))


def _cheapest(best: np.ndarray, lengths: np.ndarray, rows: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least best[i - 1] + cost(i, j) over i in 1 to j, and the least such i.

    cost is concave: the i of a longer j is never smaller.  So j is solved for every
    2^k-th length first and then between them, within the bounds its neighbours give;
    each halving looks at about n sums in all, some for each j, all at once.
    """
    n = len(lengths)
    at, least = np.ones(n + 1, np.int64), best.copy()
    at[n] = n - 1
    stride = 1 << max(n - 1, 1).bit_length()
    while stride >= 1:
        js = np.arange(stride, n, 2 * stride)
        lo = at[js - stride] if stride <= n else at[:0]
        hi = np.minimum(np.where(js + stride < n, at[np.minimum(js + stride, n)], n - 1), js)
        for part in np.array_split(np.arange(len(js)), max(1, -(-int((hi - lo + 1).sum()) // CHUNK))):
            if not len(part):
                continue
            j, first, count = js[part], lo[part], hi[part] - lo[part] + 1
            starts = np.cumsum(count) - count
            i = np.arange(count.sum()) - np.repeat(starts - first, count)
            end = np.repeat(j, count)
            total = best[i - 1] + lengths[end] * (rows[end + 1] - rows[i]) - (real[end + 1] - real[i])
            low = np.minimum.reduceat(total, starts)
            hit = np.flatnonzero(total == np.repeat(low, count))
            own = np.searchsorted(starts, hit, "right") - 1
            at[j], least[j] = i[hit[np.unique(own, return_index=True)[1]]], low
        stride //= 2
    return least, at[:n]


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket bounds with the least padding, by dynamic programming over a histogram.

    ``lengths`` ascend and are all there are; ``counts`` are their rows.  cost(i, j) is the
    padding of lengths i to j when all are filled up to lengths[j]; best[k][j] = min over
    i of best[k-1][i-1] + cost(i, j).  Of equal sums the one with fewer buckets and lower
    bounds is taken.  Time grows as buckets * n * log(n), memory as n.
    """
    n = len(lengths)
    if not n:
        return []
    # Python's integers take over where sums could pass 64 bits.
    kind = object if int(lengths[-1]) * int(counts.sum()) >= 1 << 61 else np.int64
    lengths, counts = lengths.astype(kind), counts.astype(kind)
    rows, real = (np.concatenate([np.zeros(1, kind), np.cumsum(x)]) for x in (counts, lengths * counts))
    best = lengths * rows[1:] - real[1:]
    choice = []
    for _ in range(1, min(buckets, n)):
        total, i = _cheapest(best, lengths, rows, real)
        split = np.flatnonzero(total[1:] < best[1:]) + 1
        now, back = best.copy(), np.full(n, -1, np.int32)
        now[split], back[split] = total[split], i[split]
        choice.append(back)
        best = now
    bounds, j = [int(lengths[-1])], n - 1
    for back in reversed(choice):
        if back[j] > 0:
            j = int(back[j]) - 1
            bounds.append(int(lengths[j]))
    return bounds[::-1]


def length_histogram(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All distinct lengths and their rows.

    They come to the driver: d lengths stand for d * d / 2 words at least, so 10^13
    words have some millions of them, 16 bytes each.
    """
    found = rows.groupBy("length").agg(F.count("*").alias("n")).toArrow()
    lengths, n = found.column("length").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(lengths)
    return lengths[order], n[order]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, order: list[str] | None = None, length: Column | None = None) -> DataFrame:
    """(id, length, bucket, bucket_len, batch, slot, padding) for every row of ``docs``.

    Bucket bounds are true lengths and minimise the padding over the histogram of all
    lengths, however many there are.  In a bucket rows come by ``order``
    (by default the id) and fill batches of max(1, budget // bucket_len) rows, so that
    a padded batch is within the budget unless one row alone is longer.  A batch is
    (bucket, batch) and slot its place there.

    ``length`` defaults to the number of words.  Null and empty texts have length 0;
    repeated rows are packed each, null ids first; an empty table gives none; other
    columns are not read.
    """
    box = Scratch(docs.sparkSession, "packing")
    size = (word_count(F.col(text_col)) if length is None else length).cast("long")
    keys = [F.col(c).alias(f"o{i}") for i, c in enumerate(order or [])]
    # Rows of one id, or without any, are told apart and spread by their texts.
    rows = box.keep(docs.select(F.col(id_col).alias("id"), size.alias("length"), F.xxhash64(text_col).alias("tie"), *keys), "lengths")
    bounds = optimal_bounds(*length_histogram(rows), buckets) or [0]
    bucket, upper = F.lit(0), F.lit(bounds[0])
    for k, b in enumerate(bounds[1:], 1):
        above = F.col("length") > bounds[k - 1]
        bucket, upper = F.when(above, F.lit(k)).otherwise(bucket), F.when(above, F.lit(b)).otherwise(upper)
    placed = rows.withColumns({"bucket": bucket, "bucket_len": upper.cast("long")})
    by = [f"o{i}" for i in range(len(keys))] + ["id", "length", "tie"]
    placed = number_rows(placed, ["bucket"], by, "pos", box)
    per = F.greatest(F.lit(1).cast("long"), F.expr(f"{budget} div greatest(bucket_len, 1L)"))
    return placed.withColumn("_per", per).select(
        F.col("id").alias(id_col), "length", "bucket", "bucket_len",
        F.expr("pos div _per").alias("batch"), (F.col("pos") % F.col("_per")).cast("int").alias("slot"),
        (F.col("bucket_len") - F.col("length")).alias("padding"),
    )


#: DuckDB SQL for pack over documents by id: the same dynamic program, by all pairs of
#: lengths, one level of the recursion for each bucket more.
SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS length FROM documents
), counted AS (SELECT length, count(*) AS n FROM sized GROUP BY length
), hist AS (
  SELECT row_number() OVER (ORDER BY length) AS j, length, (sum(n) OVER (ORDER BY length))::BIGINT AS r, (sum(length * n) OVER (ORDER BY length))::BIGINT AS s FROM counted
), best AS (
  SELECT 1 AS k, j, length * r - s AS cost, [length] AS bounds, r, s FROM hist
  UNION ALL
  SELECT k, j, cost, bounds, r, s FROM (
    SELECT b.k + 1 AS k, h.j, min(CASE WHEN h.j = b.j THEN b.cost ELSE b.cost + h.length * (h.r - b.r) - (h.s - b.s) END) AS cost,
      arg_min(CASE WHEN h.j = b.j THEN b.bounds ELSE list_append(b.bounds, h.length) END, (CASE WHEN h.j = b.j THEN b.cost ELSE b.cost + h.length * (h.r - b.r) - (h.s - b.s) END) * 1000000 + CASE WHEN h.j = b.j THEN 0 ELSE b.j END) AS bounds,
      h.r, h.s
    FROM best b JOIN hist h ON h.j >= b.j WHERE b.k < {BUCKETS} GROUP BY b.k, h.j, h.r, h.s)
), chosen AS (SELECT bounds FROM best WHERE k = {BUCKETS} ORDER BY j DESC LIMIT 1
), placed AS (
  SELECT doc_id, length, len(list_filter(bounds, lambda b: b < length))::INTEGER AS bucket, bounds[len(list_filter(bounds, lambda b: b < length)) + 1] AS bucket_len FROM sized, chosen
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS FIRST, length) - 1 AS pos, greatest(1, {BUDGET} // greatest(bucket_len, 1)) AS per FROM placed
)
SELECT doc_id, length, bucket, bucket_len, pos // per AS batch, (pos % per)::INTEGER AS slot, bucket_len - length AS padding FROM numbered
"""
