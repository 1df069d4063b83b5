"""Exact deduplication by deterministic block naming, on DataFrame functions only.

A text is cut into blocks of fixed size.  The distinct blocks of the corpus are sorted
and numbered, and the number is a block's name.  Then adjacent pairs of names are sorted
and named in turn, which halves the names of a text each time, until each text has one.
Equal names on one level mean equal texts and nothing else does: a name is given to a
block or to a pair, never to a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.order import number_rows
from lodestar.llm.scratch import Scratch

#: Bytes of a block.
BLOCK = 16_384
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with one space for each run of blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _cut(text: Column, size: int) -> Column:
    """The bytes of a text in blocks of ``size``; an empty text is one empty block."""
    data = text.cast("binary")
    # The lambda holds the bytes: the text is normalised once, however many blocks it has.
    last = lambda b: F.floor((F.greatest(F.octet_length(b), F.lit(1)) - 1) / size)
    cut = F.transform(F.array(data), lambda b: F.transform(F.sequence(F.lit(0).cast("long"), last(b)), lambda i: F.substring(b, (i * size + 1).cast("int"), F.lit(size))))
    return cut[0]


def _keys(block: Column, seed: int) -> list[Column]:
    """Two 64-bit hashes that stand for a block on its way to its name."""
    return [F.xxhash64(F.lit(2 * seed), block).alias("h1"), F.xxhash64(F.lit(2 * seed + 1), block).alias("h2")]


def _first_names(texts: DataFrame, size: int, box: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, names): the texts with the keys of their blocks, and the name of each key.

    Blocks meet in full, once, after copies in one task are dropped; the rest works on
    keys.  If two distinct blocks have one key, which the count over all blocks shows,
    other hashes are taken: keys are proven to tell all blocks apart.
    """
    seed = 0
    while True:
        rows = texts.select("uid", "id", F.sha2("text", 256).alias("text_sha256"), F.transform(_cut(F.col("text"), size), lambda b: F.struct(*_keys(b, seed))).alias("keys"))
        blocks = texts.select(F.explode(_cut(F.col("text"), size)).alias("block")).distinct()
        keys = box.keep(blocks.select(*_keys(F.col("block"), seed)).groupBy("h1", "h2").agg(F.count("*").alias("n")), f"keys{seed}")
        if keys.where("n > 1").isEmpty():
            return box.keep(rows, "rows"), number_rows(keys.select("h1", "h2"), [], ["h1", "h2"], "name", box)
        seed += 1


def identities(rows: DataFrame, names: DataFrame, box: Scratch) -> DataFrame:
    """(uid, level, name): one name for each text, unique to it on its level.

    Level 0 has the names of blocks; a text of n blocks ends on level ceil(log2(n)).  All
    joins are on keys that copies share, so none broadcasts and all can be split.
    """
    places = rows.select("uid", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key")).select("uid", "n", "pos", "key.*")
    at = box.keep(places.join(names.hint("merge"), ["h1", "h2"]).select("uid", "n", "pos", "name"), "level0")
    most, level, found = rows.agg(F.max(F.size("keys"))).first()[0] or 1, 0, None
    while True:
        done = at.where("n = 1").select("uid", F.lit(level).alias("level"), "name")
        found = done if found is None else found.union(done)
        if most <= 1:
            return found
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = at.where("n > 1").groupBy("uid", F.expr("int(pos div 2)").alias("pos")).agg(F.expr("int((max(n) + 1) div 2)").alias("n"), side(0).alias("l"), F.coalesce(side(1), F.lit(-1)).alias("r"))
        level, most = level + 1, (most + 1) // 2
        pairs = box.keep(pairs, f"pairs{level}")
        distinct = box.keep(pairs.select("l", "r").distinct(), f"distinct{level}")
        named = number_rows(distinct, [], ["l", "r"], "name", box)
        at = box.keep(pairs.join(named.hint("merge"), ["l", "r"]).select("uid", "n", "pos", "name"), f"level{level}")
        box.drop(f"pairs{level}", f"distinct{level}")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, level, name) for every row of ``docs``.

    Rows are equal if their texts are, after one space took the place of each run of
    blanks; (level, name) is the identity of the text.  Of equal rows the one with the
    smallest id stays, rows without id only if there are no others, and of rows that
    share that id too, just one.  ``text_sha256`` is of the normalised text in UTF-8.

    Null and empty texts are equal to each other; blank ones are to a single space; texts
    of any length are read whole; an empty table gives none; other columns are not read.
    """
    box = Scratch(docs.sparkSession, "naming")
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
    rows, names = _first_names(texts, block, box)
    own = identities(rows, names, box).withColumnRenamed("uid", "of")
    # The rows are stored, so their numbers are the same in each job.
    placed = box.keep(rows.join(own.hint("merge"), F.col("uid") == F.col("of")).select("uid", "id", "text_sha256", "level", "name"), "placed")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first")
    groups = box.keep(placed.groupBy("level", "name").agg(first, F.count("*").alias("group_size")), "groups")
    box.leave("placed", "groups")
    return placed.join(groups.hint("merge"), ["level", "name"]).select(
        F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), "group_size",
        (F.col("uid") == F.col("first.uid")).alias("kept"), "text_sha256", "level", "name",
    )


#: DuckDB SQL for the columns of op13 over documents (ids are unique there).
SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), groups AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM texts JOIN groups USING (t)
"""
