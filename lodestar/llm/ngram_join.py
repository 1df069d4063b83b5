"""N-gram Jaccard self-join with rare-first prefix filtering.

A text is the set of its word shingles.  Texts of equal sets form a class; classes
are joined, documents are not.  All shingles are ordered rare first by counts over
all documents, and a class posts only the prefix of its ordered set that any partner
above the threshold must share.  Postings meet on the shingle; length, positional
and suffix filters prune them; each pair that is left is verified once on the two
texts.

Near copies by the thousand share postings, so pairs are made in two rounds: first
every posting with two leaders of its list, then, after the links found so far have
merged classes into components, all remaining pairs of classes in different
components.  A pair inside one component cannot change the components, so the
result equals that of all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import kernels as K
from lodestar.llm.scratch import Scratch
from lodestar.operators.components import connected_components

#: Buckets of the count sketch that orders shingles, and of the suffix filter.
SKETCH_BITS, BLOCKS = 18, 16
SUFFIX = 32
#: A shingle counted this often beyond the sketch's noise is hot: surely shared.  Its
#: postings are spread over this many salts.
HOT, SALTS = 50_000, 64


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _signature(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set, insensitive to order."""
    out = []
    for salt in (11, 12):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(K.mix(values, salt), out=sums[1:])
        out.append(K.mix((sums[sizes[1:]] - sums[sizes[:-1]]) + np.diff(sizes).astype(np.uint64), salt))
    return out[0], out[1]


def _summaries(width: int):
    """Per document: set size, set signature and suffix histogram; then counts."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for piece, texts in K.slices(batch, "text"):
                values, sizes = K.shingle_sets(texts, width)
                s1, s2 = _signature(values, sizes)
                counts += np.bincount((K.mix(values, 3) >> K.U64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(2), pa.array(np.diff(sizes)), _long(s1), _long(s2), pa.nulls(piece.num_rows, pa.int32()), pa.nulls(piece.num_rows, pa.binary())],
                    ["id", "h", "n", "c", "c2", "block", "counts"],
                )
        size = (1 << SKETCH_BITS) // BLOCKS
        none = pa.nulls(BLOCKS, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, none, none, pa.array(range(BLOCKS), pa.int32()), pa.array([counts[i * size : (i + 1) * size].tobytes() for i in range(BLOCKS)], pa.binary())],
            ["id", "h", "n", "c", "c2", "block", "counts"],
        )

    return run


def _add_blocks(batches):
    """Adds up the count blocks of a task; holds one array for each block."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(raw.as_buffer(), np.int64)
            total[block] = total[block] + part if block in total else part.copy()
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "counts"]
    )


def _sketch(parts: DataFrame) -> np.ndarray:
    """The counts over all documents, 8 * 2**SKETCH_BITS bytes whatever the input."""
    spread = parts.repartition(4 * BLOCKS, "block", F.pmod(F.xxhash64("counts"), F.lit(4)))
    summed = spread.mapInArrow(_add_blocks, "block int, counts binary").repartition(BLOCKS, "block")
    counts = np.zeros((BLOCKS, (1 << SKETCH_BITS) // BLOCKS), np.int64)
    for row in summed.mapInArrow(_add_blocks, "block int, counts binary").collect():
        counts[row.block] += np.frombuffer(row.counts, np.int64)
    return counts.reshape(-1)


def _postings(width: int, pct: int, sketch):
    """Prefix shingles of each class, once a task, rare first."""
    least = HOT

    def run(batches):
        counts = sketch.value
        mean = counts.mean()
        hot = least + mean + 8 * math.sqrt(mean)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, texts in K.slices(batch, "text"):
                values, sizes = K.shingle_sets(texts, width)
                s1, s2 = _signature(values, sizes)
                often = counts[(K.mix(values, 3) >> K.U64(64 - SKETCH_BITS)).astype(np.int64)]
                rows = []
                for i in range(len(texts)):
                    a, b = sizes[i], sizes[i + 1]
                    n, key = int(b - a), (int(s1[i]), int(s2[i]))
                    if not n or key in seen:
                        continue
                    seen.add(key)
                    v, f = values[a:b], often[a:b]
                    order = np.lexsort((v, f))[: n - -(-pct * n // 100) + 1]
                    rows.append((i, n, v[order], f[order] >= hot, np.bincount((v >> K.U64(59)).astype(np.int64), minlength=SUFFIX).astype("<u4").tobytes()))
                if not rows:
                    continue
                at = [r[0] for r in rows]
                lists = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        _long(s1[at]),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.ListArray.from_arrays(lists, _long(np.concatenate([r[2] for r in rows]))),
                        pa.ListArray.from_arrays(lists, pa.array(np.concatenate([r[3] for r in rows]))),
                        pa.array([r[4] for r in rows], pa.binary()),
                    ],
                    ["c", "n", "w", "hot", "hist"],
                )

    return run


def _suffix_filter(pct: int):
    """Keeps pairs whose counts by part of the hash space allow enough overlap.

    |X ^ Y| is at least the sum over parts of the difference in counts.
    """

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ha, hb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(-1, SUFFIX).astype(np.int64) for k in (2, 3))
                na, nb = ha.sum(1), hb.sum(1)
                differ = np.abs(ha - hb).sum(1)
                most = (na + nb - differ) // 2
                yield batch.filter(pa.array((100 + pct) * most >= pct * (na + nb))).select(["a", "b"])

    return run


def _verify(width: int, pct: int):
    """Links among pairs of texts, by the exact overlap of their shingle sets."""

    def run(batches):
        for batch in batches:
            found = np.zeros(batch.num_rows, bool)
            size = sum(pc.binary_length(batch.column(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            ends, at = np.cumsum(size), 0
            while at < batch.num_rows:  # about a million bytes at a time, one pair at least
                n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000, "right")) - at)
                piece = batch.slice(at, n)
                values, o = K.shingle_sets(piece.column(2).to_pylist() + piece.column(3).to_pylist(), width)
                for i in range(n):
                    x, y = values[o[i] : o[i + 1]], values[o[n + i] : o[n + i + 1]]
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    found[at + i] = 100 * both >= pct * (len(x) + len(y) - both)
                at += n
            yield batch.select(["a", "b"]).filter(pa.array(found))

    return run


def _meet(rows: DataFrame, table: DataFrame, keys: list[str], spread: list[str], box: Scratch, name: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each value of ``keys``.

    Any share of the rows may have one key: they are dealt over tasks by ranges of keys
    and ``spread``, and each task gets the rows of ``table`` for the keys that it holds.
    """
    dealt = box.keep(rows.repartitionByRange(*keys, *spread).withColumn("p", F.spark_partition_id()), name)
    held = dealt.select("p", *keys).distinct().join(table, keys)
    return dealt.join(held, ["p", *keys], how).drop("p")


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, pct: int = 80, keep_hash: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    With ``keep_hash`` also text_hash, xxhash64 of the text, which tells rows of one id apart.

    Two texts link when 100 * |intersection| >= ``pct`` * |union| of their sets of
    ``width``-word shingles.  component_id is the least id reachable by links.

    Null, empty and blank texts have the empty set and link with nothing; texts of
    fewer words than ``width`` have one shingle, the whole sequence; rows of equal sets
    are in one component; rows that share an id are documents of their own.  Rows
    without id link like all others; their component is null if no row of it has an id.
    Other columns of ``docs`` are not read.  An empty table gives none.
    """
    spark = docs.sparkSession
    box = Scratch(spark, "ngram")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    told = rows.mapInArrow(_summaries(width), "id long, h long, n long, c long, c2 long, block int, counts binary")
    told = box.keep(told.withColumn("r", F.monotonically_increasing_id()), "told")
    sketch = spark.sparkContext.broadcast(_sketch(told.where("block is not null").select("block", "counts")))
    told = told.where("block is null").select("id", "h", "n", "c", "c2", "r")
    # The row that stands for a class: that of the least id, if any has one.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h"))
    classes = told.where("n > 0").groupBy("c", "c2").agg(first.alias("f")).select("c", "c2", F.col("f.id").alias("rep"), "f.h")

    posted = box.keep(rows.select("id", "text").mapInArrow(_postings(width, pct, sketch), "c long, n long, w array<long>, hot array<boolean>, hist binary"), "posted")
    flat = posted.select("c", "n", F.posexplode(F.arrays_zip("w", "hot")).alias("pos", "x")).select("c", "n", "pos", "x.w", "x.hot")
    lists = box.keep(_shared(flat), "lists")
    hist = box.keep(posted.select("c", "hist").dropDuplicates(["c"]), "hist")
    box.drop("posted")

    # Everything below concerns only classes that share a prefix shingle.
    wanted = lists.select("c").distinct().join(classes, "c").select("c", "c2", "rep", F.col("h").alias("rep_h"))
    found = rows.join(wanted, F.col("id").eqNullSafe(F.col("rep")) & (F.col("h") == F.col("rep_h")))
    texts = box.keep(found.select("c", "c2", "rep", "text").dropDuplicates(["c"]), "texts")

    links, tested, parts = None, None, None
    for step in ("leaders", "all"):
        pairs = _pairs(lists, parts, step, pct)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = box.keep(pairs, f"pairs-{step}")
        tested = pairs if tested is None else tested.union(pairs)
        pairs = _meet(pairs, hist.toDF("a", "ha"), ["a"], ["b"], box, f"hist-a-{step}")
        pairs = _meet(pairs, hist.toDF("b", "hb"), ["b"], ["a"], box, f"hist-b-{step}")
        pairs = box.keep(pairs.select("a", "b", "ha", "hb").mapInArrow(_suffix_filter(pct), "a long, b long"), f"fit-{step}")
        box.drop(f"hist-a-{step}", f"hist-b-{step}")
        pairs = _meet(pairs, texts.select(F.col("c").alias("a"), F.col("text").alias("ta")), ["a"], ["b"], box, f"texts-a-{step}")
        pairs = _meet(pairs, texts.select(F.col("c").alias("b"), F.col("text").alias("tb")), ["b"], ["a"], box, f"texts-b-{step}")
        new = box.keep(pairs.select("a", "b", "ta", "tb").mapInArrow(_verify(width, pct), "a long, b long"), f"links-{step}")
        box.drop(f"texts-a-{step}", f"texts-b-{step}")
        links = new if links is None else links.union(new)
        parts = connected_components(links, lambda df, name, s=step: box.keep(df, f"{s}-{name}"))
        parts = box.keep(parts.toDF("c", "root"), f"parts-{step}")
    linked = texts.select("c", "c2", "rep").join(parts, "c")
    linked = _meet(linked, linked.groupBy("root").agg(F.min("rep").alias("least")), ["root"], ["c"], box, "linked").select("c", "c2", "least")
    # Classes without links keep their own least id.
    reps = classes.select("c", "c2", "rep").join(linked, ["c", "c2"], "left").select("c", "c2", F.coalesce("least", "rep").alias("found"))
    found = _meet(told.select("id", "n", "c", "c2", "r", *["h"] * keep_hash), reps, ["c", "c2"], ["r"], box, "dealt", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("found")).otherwise(F.col("id")).alias("component_id"),
        *[F.col("h").alias("text_hash")] * keep_hash,
    )
    return found


def _shared(flat: DataFrame) -> DataFrame:
    """Postings of shingles that more than one class posts, and a salt to spread hot ones.

    Hot shingles surely are shared and skip the test, so no list of theirs is sorted in
    one task; the others are tested beside their postings, with one shuffle.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("w")
    cool = flat.where("not hot").withColumns({"lo": F.min("c").over(by), "hi": F.max("c").over(by)}).where("lo <> hi")
    hot = flat.where("hot").select("w", "c", "n", "pos", F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int").alias("salt"))
    return cool.select("w", "c", "n", "pos", F.lit(-1).alias("salt")).union(hot)


def _pairs(lists: DataFrame, parts: DataFrame | None, step: str, pct: int) -> DataFrame:
    """Candidate pairs of classes, each once, after length and positional filters."""
    if parts is not None:
        lists = lists.join(parts, "c", "left").withColumn("part", F.coalesce("root", "c")).drop("root")
    else:
        lists = lists.withColumn("part", F.col("c"))
    mixed = lists.groupBy("w").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.max("salt").alias("salts"), *(_leaders() if step == "leaders" else [])).where("lo <> hi")
    # The postings of a hot shingle are spread by their salt; what they meet goes to each.
    every = F.explode(F.when(F.col("salts") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Overlap must reach pct * (n + m) / (100 + pct). All of it lies at or after the
    # first common shingle, which both prefixes hold, so a linked pair passes there.
    fits = (
        f"x.part <> y.part and 100 * least(x.n, y.n) >= {pct} * greatest(x.n, y.n)"
        f" and {100 + pct} * least(x.n - x.pos, y.n - y.pos) >= {pct} * (x.n + y.n)"
    )
    if step == "leaders":
        x = lists.alias("x")
        y = mixed.select("w", F.array_distinct(F.array("y1", F.struct("y2.pos", "y2.c", "y2.n", "y2.part"))).alias("ys"), every.alias("salt"))
        y = y.select("w", "salt", F.inline("ys")).alias("y")
    else:
        lists = lists.join(mixed.select("w"), "w", "left_semi")
        x, y = lists.alias("x"), lists.withColumn("salts", F.col("salt")).withColumn("salt", every).alias("y")
        fits += " and x.c < y.c"
    found = x.join(y, F.expr("x.w = y.w and x.salt = y.salt and " + fits))
    return found.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()


def _leaders() -> list:
    """Of a list the posting nearest to the front of its set, and one by a hash."""
    order = F.pmod(F.xxhash64("c"), F.lit(1 << 20)).cast("int")
    return [F.min(F.struct("pos", "c", "n", "part")).alias("y1"), F.min(F.struct(order.alias("o"), "pos", "c", "n", "part")).alias("y2")]
