"""Line deduplication by overlapping three-line windows, on DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.scratch import Scratch

WINDOW = 3


def _row_key(id_col: str, text_col: str) -> Column:
    """Tells rows of one id and different texts apart; always used beside the id."""
    return F.xxhash64(id_col, text_col)


def repeated_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, row_key, covered): the line numbers, from 0, that later occurrences cover.

    A window is ``window`` consecutive lines, compared by a 128-bit hash; windows of
    nothing but blanks do not count.  Of equal windows the first by (id, line) stays.
    Windows are counted before they meet, so a passage of any frequency is one row
    per task, and only hashes and places are shuffled, never texts.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _row_key(id_col, text_col).alias("row_key"))

    def bodies(lines: Column) -> Column:
        starts = F.when(F.size(lines) >= window, F.sequence(F.lit(0), F.size(lines) - window))
        return F.transform(starts, lambda i: F.concat_ws("\n", *[F.get(lines, i + k) for k in range(window)]))

    # The lambda holds the lines of a text: a text is split once, however many windows it has.
    split = F.transform(F.array(F.split("text", "\n", -1)), bodies)
    places = rows.select("id", "row_key", F.posexplode(split[0]).alias("line", "body")).where(F.col("body").rlike(r"[^\s]"))
    hashed = places.select(
        F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(1), "body").alias("h2"), F.struct("id", "row_key", "line").alias("at")
    )
    first = hashed.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Neither this table nor the covered lines have a size bound, so they never broadcast.
    later = hashed.join(first.hint("merge"), ["h1", "h2"]).where(~F.col("at").eqNullSafe(F.col("first")))
    return later.select("at.id", "at.row_key", "at.line").groupBy("id", "row_key").agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence("line", F.col("line") + (window - 1))))).alias("covered")
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with the lines of repeated windows taken out of the text.

    A line goes if any window over it, of ``window`` lines, stood earlier in the corpus,
    that is at a lower (id, line); overlapping windows merge.  Every line that goes
    equals one that stays.  Adds n_lines_removed (long).

    Null, empty and short texts (fewer lines than ``window``) are unchanged; a text all
    of whose lines go becomes empty and the row stays; repeated rows (equal id and
    text) are one document and each loses the same lines; null ids come first; other
    columns pass through; an empty table gives none.  A column named n_lines_removed
    is replaced.  Work in a text grows with its lines.
    """
    box = Scratch(docs.sparkSession, "lines")
    covered = box.keep(repeated_positions(docs, id_col, text_col, window), "covered")
    rows = docs.drop("n_lines_removed").select(F.col(id_col).alias("row_id"), _row_key(id_col, text_col).alias("row_key"), F.struct("*").alias("row"))
    text = F.col("row")[text_col]

    def left(lines: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("covered"))
        return F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")

    changed = F.when(F.col("covered").isNull(), text).otherwise(F.transform(F.array(F.split(text, "\n", -1)), left)[0])
    found = covered.toDF("covered_id", "covered_key", "covered").hint("merge")
    same = F.col("row_id").eqNullSafe(F.col("covered_id")) & (F.col("row_key") == F.col("covered_key"))
    return rows.join(found, same, "left").select(
        *[changed.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c != "n_lines_removed"],
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_lines_removed"),
    )


#: DuckDB SQL for line_dedup over documents (ids are unique there).
SQL = """
WITH lines AS (
  SELECT doc_id, CAST(i AS BIGINT) AS line, string_split(text, chr(10)) AS ls
  FROM documents, UNNEST(range(0, len(string_split(text, chr(10))))) AS u(i)
), windows AS (
  SELECT doc_id, line, ls[line + 1] || chr(10) || ls[line + 2] || chr(10) || ls[line + 3] AS body
  FROM lines WHERE line + 3 <= len(ls)
), ranked AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY body ORDER BY doc_id, line) AS rn
  FROM windows WHERE regexp_matches(body, '[^\\s]')
), covered AS (
  SELECT DISTINCT doc_id, line + k AS line FROM ranked, UNNEST(range(0, 3)) AS w(k) WHERE rn > 1
), kept AS (
  SELECT l.doc_id, string_agg(l.ls[l.line + 1], chr(10) ORDER BY l.line) AS text
  FROM lines l ANTI JOIN covered c ON l.doc_id = c.doc_id AND l.line = c.line GROUP BY l.doc_id
), gone AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN g.n IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
       coalesce(g.n, 0) AS n_lines_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN gone g ON d.doc_id = g.doc_id
"""
