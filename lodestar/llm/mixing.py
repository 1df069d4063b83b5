"""Mixing sources to target weights by proportionate-fair scheduling.

Rows of a source form blocks.  With target weight w, block i may not be used before
slot floor(i / w) and must be used before slot ceil((i + 1) / w).  Serving the released
block with the earliest deadline at each slot meets all deadlines, so after any number
of slots each source is less than one block from its target.

Weights are exact: the targets as they are, brought to integers over their sum.  All
blocks are scheduled in one pass, which holds a few numbers for each source and takes a
step for each block (16 rows), in one task that writes the plan as it goes.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from lodestar.llm.order import number_rows
from lodestar.llm.scratch import Scratch, quoted

BLOCK_ROWS = 16
#: Slots are 64-bit: blocks due beyond FAR (extreme weights) are released there, due by LAST.
FAR, LAST = 1 << 62, (1 << 63) - 1
#: Rows of the plan written at once.
PLAN_ROWS = 1 << 16
PLAN = "s string, block long, slot long, release long, due long, on boolean"
PLAN_NAMES = [c.split()[0] for c in PLAN.split(", ")]


def exact(values: list[float]) -> list[int]:
    """Integers in just the proportions of positive floats."""
    ratios = [float(v).as_integer_ratio() for v in values]
    over = max((d for _, d in ratios), default=1)
    whole = [a * (over // d) for a, d in ratios]
    by = math.gcd(*whole) or 1
    return [v // by for v in whole]


def serve(weights: list[int], blocks: list[int], total: int | None = None) -> Iterator[tuple[int, int, int, int, int, bool]]:
    """(source, block, slot, release, deadline, on target) of all blocks, by slot.

    Earliest deadline first, equal ones by the source's number; its weight is
    weights[k] / ``total`` (by default their sum), 1 at most in all.  A source that has
    run out keeps its place until its turn comes: from that slot on nothing is on target.
    Slots without a released block stay idle.
    """
    n, total = len(weights), total or sum(weights)
    if sum(weights) > total:
        raise ValueError("weights exceed one")
    done, left, t, on = [0] * n, sum(blocks), 0, True
    # Heaps of release * n + source and of deadline * n + source.
    waiting, ready = [k for k in range(n) if blocks[k]], []
    while left:
        if not ready:
            t = max(t, waiting[0] // n)
        while waiting and waiting[0] < (t + 1) * n:
            k = heapq.heappop(waiting) % n
            due = -(-(done[k] + 1) * total // weights[k])
            heapq.heappush(ready, (due if due <= FAR else LAST) * n + k)
        due, k = divmod(heapq.heappop(ready), n)
        i = done[k]
        if i == blocks[k]:
            on = False
            continue
        if t >= due:
            raise AssertionError("a deadline was missed")
        yield k, i, t, min(i * total // weights[k], FAR), due, on
        done[k] = i + 1
        left -= 1
        if on or i + 1 < blocks[k]:
            heapq.heappush(waiting, min((i + 1) * total // weights[k], FAR) * n + k)
        t += 1


def plan_rows(sizes: dict[str, int], weights: dict[str, float] | None, smoothing: float, block_rows: int) -> Iterator[tuple]:
    """PLAN rows of all blocks of sources with ``sizes`` rows; those without target last."""
    target = {k: (n**smoothing if weights is None else weights.get(k, 0)) for k, n in sizes.items()}
    names = sorted(k for k in sizes if target[k] > 0)
    end = 0
    for k, i, t, release, due, on in serve(exact([target[k] for k in names]), [-(-sizes[k] // block_rows) for k in names]):
        end = t + 1
        yield names[k], i, t, release, due, on
    for k in sorted(k for k in sizes if not target[k] > 0):
        for i in range(-(-sizes[k] // block_rows)):
            yield k, i, end, None, None, False
            end += 1


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, smoothing: float = 1.0, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows and columns of ``docs`` with their place in the mixture.

    Adds mix_block (number of the block in its source), mix_release, mix_deadline,
    mix_slot (when the block is served), mix_pos (place of the row in its block) and
    mix_on_target: false once some source with a target has run out, from where on
    the order still holds but the targets cannot.  Columns of these names are replaced.

    ``weights`` are the targets by source; else each source's share of the rows to the
    power ``smoothing`` (1: as they come, 0: all equal).  Rows of a source are taken by a
    hash of the id, then the id, then a hash of the row.  No row is dropped: sources without a target come
    after all others, in slots of their own.  A null source counts as ''; repeated
    rows and null ids are each placed; an empty table gives none.
    """
    box = Scratch(docs.sparkSession, "mixing")
    docs = docs.drop("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_pos", "mix_on_target")
    src = F.coalesce(F.col(source_col), F.lit(""))

    def plan(batches):
        sizes = {}
        for batch in batches:
            sizes.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        rows = plan_rows(sizes, weights, smoothing, block_rows)
        types = [pa.string(), *[pa.int64()] * 4, pa.bool_()]
        while piece := list(itertools.islice(rows, PLAN_ROWS)):
            columns = zip(*piece, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], PLAN_NAMES)

    # One row for each block.  It is stored, so its size is known: a small one is broadcast, a large one joined by shuffle.
    table = box.keep(docs.groupBy(src.alias("s")).count().repartition(1).mapInArrow(plan, PLAN), "plan")
    # Rows of one id, or without any, are told apart and spread by their other columns.
    tie = F.xxhash64(*[F.col(quoted(f.name)) for f in docs.schema if isinstance(f.dataType, AtomicType)])
    rows = docs.select(F.struct("*").alias("row"), src.alias("s"), F.xxhash64(id_col).alias("h"), F.col(id_col).alias("id"), tie.alias("tie"))
    rows = number_rows(rows, ["s"], ["h", "id", "tie"], "n", box, many=True)
    rows = rows.select("row", "s", F.expr(f"n div {block_rows}").alias("block"), F.expr(f"cast(n % {block_rows} as int)").alias("pos"))
    return rows.join(table, ["s", "block"]).select(
        "row.*",
        F.col("block").alias("mix_block"),
        F.col("release").alias("mix_release"),
        F.col("due").alias("mix_deadline"),
        F.col("slot").alias("mix_slot"),
        F.col("pos").alias("mix_pos"),
        F.col("on").alias("mix_on_target"),
    )


def in_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mixture's rows in its order: files by ranges of slots, each sorted."""
    by = ["mix_slot", "mix_block", "mix_pos", id_col]
    return mixed.repartitionByRange(*by).sortWithinPartitions(*by)
