"""Fields of objects: where they are read, set, taken apart and declared (SRCH-20, field and type mode)."""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.braces import pair, tokens

SCRIPTS = r"\.(ts|tsx|js|jsx|mjs|cjs)$"
_BEFORE_MEMBER = {"{", ";", ",", "}", "readonly", "public", "private", "protected", "static", "async", "get", "set", "abstract"}
#: Signs after which a member's type or value goes on, over lines too.
_GOES_ON = {":", "=", "|", "&", "<", "=>", "?", "(", "[", "+", "."}
MEMBERS = "path string, line int, kind string, name string, owner string"


def _kinds(words: list[str], pairs: dict[int, int]) -> dict[int, tuple[str, str | None]]:
    """What each brace opens: a declaration (of a type), a literal, a pattern or a block."""
    out = {}
    for i, end in pairs.items():
        if words[i] != "{":
            continue
        before, after = words[i - 1] if i else "", words[end + 1] if end + 1 < len(words) else ""
        # The words of the statement that the brace may end the head of.
        k = i - 1
        while k >= 0 and i - k < 60 and words[k] not in (";", "{", "}", "(", ","):
            k -= 1
        head = words[k + 1 : i]
        named = next((n for n, w in enumerate(head[:-1]) if w in ("interface", "class", "type") and re.match(r"[^\W\d]", head[n + 1])), None)
        if named is not None and (head[named] != "type" or "=" in head):
            out[i] = ("decl", head[named + 1])
        elif before in ("const", "let", "var") or (after == "=" and words[end + 2 : end + 3] != ["="] and before in (";", "{", "}", "(", "")) or (before in ("(", ",") and after in (":", ")", ",") and _parameters(words, pairs, i)):
            out[i] = ("pattern", None)
        elif before in ("=", "(", ",", "[", "?", "return", "...", "&", "|") or (before == ":" and "case" not in head and "default" not in head and _typed(words, i) is False):
            out[i] = ("literal", None)
        else:
            out[i] = ("block", None)
    return out


def _parameters(words: list[str], pairs: dict[int, int], i: int) -> bool:
    """Whether a brace lies in the parameters of a function."""
    opens = max((a for a, b in pairs.items() if words[a] == "(" and a < i < b), default=None)
    if opens is None:
        return False
    end = pairs[opens]
    after = words[end + 1 : end + 2]
    heads = words[max(0, opens - 2) : opens]
    return after == ["=>"] or "function" in heads or (after in (["{"], [":"]) and not set(heads) & {"if", "for", "while", "switch", "catch"})


def _typed(words: list[str], i: int) -> bool:
    """Whether the colon before a brace gives a name its type rather than a key its value."""
    return i >= 3 and words[i - 3] in ("const", "let", "var")


def member_rows(content: str, language: str = "js") -> list[tuple[int, str, str, str | None]]:
    """(line, kind, name, owner) of fields: read, key, destructure, decl.

    The owner of a declared field is its type, that of a key its literal, by number.
    """
    found = tokens(content, language)
    words = [t if k != "text" else '"' for k, t, _ in found]
    pairs = pair(found)
    kinds = _kinds(words, pairs)
    breaks = [m.start() for m in re.finditer("\n", content)]
    inner, held, out = [None] * len(words), [], []
    for i in range(len(words)):
        while held and pairs[held[-1]] < i:
            held.pop()
        inner[i] = held[-1] if held else None
        if i in pairs:
            held.append(i)
    for i, (kind, word, start) in enumerate(found):
        if kind != "name":
            continue
        line, before, after = bisect.bisect_left(breaks, start) + 1, words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""
        brace = inner[i]
        what, name = kinds.get(brace, ("", None)) if brace is not None else ("", None)
        if before in (".", "?."):
            out.append((line, "read", word.removeprefix("#"), None))
        elif what == "decl" and after in (":", "?", "(", "=", ";", "!") and (before in _BEFORE_MEMBER or (line > _line(breaks, found, i - 1) and before not in _GOES_ON)):
            out.append((line, "decl", word.removeprefix("#"), name))
        elif what == "literal" and before in ("{", ",") and after in (":", ",", "}", "("):
            out.append((line, "key", word, str(brace)))
        elif what == "pattern" and before in ("{", ",") and after in (":", ",", "}", "="):
            out.append((line, "destructure", word, None))
    return out


def _line(breaks: list[int], found: list[tuple[str, str, int]], i: int) -> int:
    return bisect.bisect_left(breaks, found[i][2]) + 1 if i >= 0 else 0


def members(files: DataFrame) -> DataFrame:
    """(path, line, kind, name, owner) of the fields in scripts (path, content)."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = [(p, *r) for p, c in zip(*(x.to_pylist() for x in batch.columns), strict=True) for r in member_rows(c)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["path", "line", "kind", "name", "owner"])

    scripts = files.where(F.col("path").rlike(SCRIPTS) & F.col("content").isNotNull())
    return scripts.select("path", "content").mapInArrow(run, MEMBERS)


def field_references(fields: DataFrame, name: str, closure: DataFrame | None = None) -> DataFrame:
    """SRCH-20, field mode: (path, line, kind) of a field, in files of a closure (path) if one is given."""
    rows = fields.where(F.col("name") == name)
    if closure is not None:
        rows = rows.join(closure.select("path").distinct(), "path", "left_semi")
    return rows.select("path", "line", "kind").distinct()


def constructions(fields: DataFrame, path: str, type_name: str, min_hit: int = 2, closure: DataFrame | None = None) -> DataFrame:
    """SRCH-20, type mode: (path, line, hits, keys) of literals that share ``min_hit`` keys with a type's members.

    The type is that of its name in the file ``path``; most shared keys come first.
    """
    wanted = fields.where((F.col("kind") == "decl") & (F.col("path") == path) & (F.col("owner") == type_name)).select("name").distinct()
    keys = fields.where("kind = 'key'")
    if closure is not None:
        keys = keys.join(closure.select("path").distinct(), "path", "left_semi")
    met = keys.join(wanted, "name").groupBy("path", "owner").agg(F.min("line").alias("line"), F.countDistinct("name").alias("hits"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("keys"))
    return met.where(F.col("hits") >= min_hit).select("path", "line", "hits", "keys").orderBy(F.desc("hits"), "path", "line")


def feature_tree(files: DataFrame, least: int = 5) -> DataFrame:
    """GRAPH-20: (feature, parent, files, own) of the folders that stand for features, from (path).

    A folder with fewer than ``least`` files below it, or with nothing but one folder in
    it, is part of the nearest folder above that is kept; the root, '', always is.
    ``own`` counts the files whose nearest kept folder it is.  Folders meet their files by
    their paths, each file once for each folder above it.
    """
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    up = files.select("path", F.posexplode(dirs).alias("depth", "dir"), F.size(parts).alias("n")).where("path is not null")
    last = F.col("depth") == F.col("n") - 1
    child = F.when(last, None).otherwise(F.element_at(parts, F.col("depth") + 1))
    stats = up.groupBy("dir", "depth").agg(F.count("*").alias("files"), F.count_if(last).alias("direct"), F.min(child).alias("c0"), F.max(child).alias("c1"))
    alone = (F.col("direct") == 0) & F.col("c0").eqNullSafe(F.col("c1"))
    kept = stats.where((F.col("dir") == "") | ((F.col("files") >= least) & ~alone)).select("dir", "depth", "files")
    own = up.join(kept.select("dir"), "dir").groupBy("path").agg(F.max_by("dir", "depth").alias("dir")).groupBy("dir").agg(F.count("*").alias("own"))
    above = kept.where("dir <> ''").select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.col("depth") - 1), lambda k: F.struct(k.alias("d"), F.array_join(F.slice(F.split("dir", "/"), F.lit(1), k), "/").alias("up")))).alias("a")).select("dir", "a.d", "a.up")
    parent = above.join(kept.select(F.col("dir").alias("up")), "up").groupBy("dir").agg(F.max_by("up", "d").alias("parent"))
    out = kept.join(parent, "dir", "left").join(own, "dir", "left")
    return out.select(F.col("dir").alias("feature"), "parent", "files", F.coalesce("own", F.lit(0).cast("long")).alias("own"))
