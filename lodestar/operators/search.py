"""Text, fuzzy and vector search (SRCH-1 to SRCH-23)."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scalars import common_prefix, name_tokens, strip_digits

SYMBOL_COLUMNS = ("id", "name", "qualified_name", "docstring", "signature")


#: Fixed constants of the bm25 rank.
BM25_K1, BM25_B = 1.2, 0.75


def search_symbols(nodes: DataFrame, query: str, limit: int | None = 20, columns: Iterable[str] = SYMBOL_COLUMNS) -> DataFrame:
    """SRCH-1: nodes, other than files, holding the phrase in one of the columns, best rank first.

    A phrase of trigrams is a case-insensitive substring; under 3 characters finds
    nothing.  rank is minus the bm25 score of the phrase over the columns' trigrams, with
    counts over all nodes, to 9 places; rows come by (rank, id).
    """
    q = query.strip().lower()
    if len(q) < 3:
        return nodes.limit(0).withColumn("rank", F.lit(0.0))
    texts = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    # The look-ahead also counts occurrences that overlap.
    hits = sum((F.when(F.contains(t, F.lit(q)), F.regexp_count(t, F.lit(f"(?={re.escape(q)})"))).otherwise(0) for t in texts), F.lit(0))
    size = sum((F.greatest(F.length(t) - 2, F.lit(0)) for t in texts), F.lit(0))
    counted = nodes.withColumns({"_hits": hits, "_size": size})
    total = counted.agg(F.count("*").alias("n"), F.count_if(F.col("_hits") > 0).alias("found"), F.avg("_size").alias("mean")).first()
    if not total["found"]:
        return nodes.limit(0).withColumn("rank", F.lit(0.0))
    weight = max(math.log((total["n"] - total["found"] + 0.5) / (total["found"] + 0.5)), 1e-6)
    f = F.col("_hits").cast("double")
    score = weight * f * (BM25_K1 + 1) / (f + BM25_K1 * (1 - BM25_B + BM25_B * F.col("_size") / total["mean"]))
    out = counted.where((F.col("kind") != "file") & (F.col("_hits") > 0)).withColumn("rank", F.round(-score, 9)).drop("_hits", "_size").orderBy("rank", "id")
    return out if limit is None else out.limit(limit)


_IDENTIFIER = re.compile(r"^[A-Za-z_$][\w$.]*$")


def semantic_search(nodes: DataFrame, query: str, vectors: DataFrame | None = None, query_vector: list[float] | None = None, limit: int = 20) -> DataFrame:
    """SRCH-2: exact hits for an identifier, else by vector, else by text, degraded.

    Columns id, score, provider, degraded.
    """
    from lodestar.sources.store import checkpoint

    # At most ``limit`` rows, searched once.
    text = checkpoint(search_symbols(nodes, query, limit))
    if _IDENTIFIER.match(query.strip()) and not text.isEmpty():
        return text.select("id", F.lit(1.0).alias("score"), F.lit("exact").alias("provider"), F.lit(False).alias("degraded"))
    if vectors is not None and query_vector is not None:
        found = vector_top_k(vectors, query_vector, limit)
        return found.select("id", "score", F.lit("vector").alias("provider"), F.lit(False).alias("degraded"))
    return text.select("id", F.lit(0.0).alias("score"), F.lit("text").alias("provider"), F.lit(True).alias("degraded"))


def cosine(a: Column, b: Column) -> Column:
    """SRCH-3: cosine over the first min(len) dimensions in doubles, 0 for a zero norm."""
    n = F.least(F.size(a), F.size(b))
    dot = lambda x, y: F.aggregate(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def vector_top_k(vectors: DataFrame, query: list[float], k: int = 20, min_score: float = 0.3) -> DataFrame:
    """SRCH-4: vectors (id, vector) scored against one query, best first, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("id", cosine(F.col("vector"), q).alias("score"))
    return scored.where(F.col("score") >= min_score).orderBy(F.desc("score"), "id").limit(k)


def cache_misses(texts: DataFrame, cache: DataFrame, model: str, dim: int, size: int = 128) -> DataFrame:
    """SRCH-5: texts whose key ``model:dim:sha256`` is not cached, each key once, with its batch.

    Batches hold up to ``size`` keys each and are cut where the keys lie, without a
    global order.
    """
    key = F.concat(F.lit(f"{model}:{dim}:"), F.sha2(F.col("text"), 256))
    missing = texts.select(key.alias("cache_key"), "text").groupBy("cache_key").agg(F.min("text").alias("text")).join(cache.select("cache_key"), "cache_key", "left_anti")
    # Ids ascend by one within a partition and start at multiples of 2**33.
    return missing.withColumn("batch", F.floor(F.monotonically_increasing_id() / size))


def score_bricks(bricks: DataFrame, words: list[str]) -> DataFrame:
    """SRCH-6: weighted keyword score of components.

    Per word, ignoring case: name equal 100, contains 60; a shape equal 50 or containing
    30, else its fields 20 each shape; emits 20, config 20, description 15.  Shapes are
    (name, fields).  Components with a positive score, best first, then by name.
    """
    def of(word: str) -> Column:
        w = F.lit(word)

        def has(c: Column) -> Column:
            return F.contains(F.lower(F.coalesce(c, F.lit(""))), w)

        def some(c: Column) -> Column:
            return F.coalesce(F.exists(c, has), F.lit(False))

        def shape(acc: Column, s: Column) -> Column:
            return acc + F.when(F.lower(s["name"]) == w, 50).when(has(s["name"]), 30).when(some(s["fields"]), 20).otherwise(0)

        name = F.when(F.lower("name") == w, 100).when(has(F.col("name")), 60).otherwise(0)
        lists = F.when(some(F.col("emits")), 20).otherwise(0) + F.when(some(F.col("config")), 20).otherwise(0)
        return name + F.aggregate("shapes", F.lit(0), shape) + lists + F.when(has(F.col("description")), 15).otherwise(0)

    total = sum((of(w.lower()) for w in words if w), F.lit(0))
    return bricks.withColumn("score", total).where("score > 0").orderBy(F.desc("score"), "name")


def best_candidates(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """SRCH-7: of candidates with one (qualified_name, file, line) the highest score wins; of
    equal scores the first source by priority.  Ordered by score, file, line."""
    key = ["qualified_name", "file", "line"]
    best = candidates.groupBy(*key).agg(F.max_by(F.struct("score", "source"), F.struct("score", (-F.col("priority")).alias("p"))).alias("b"))
    out = best.select(*key, "b.score", "b.source").orderBy(F.desc("score"), "file", "line", "qualified_name")
    return out if limit is None else out.limit(limit)


def symbol_candidates(nodes: DataFrame, words: list[str], per_word: int = 5, index=None) -> DataFrame:
    """SRCH-7: exact names score 1.0; phrase hits 0.8 for an equal name in any case, else 0.5.

    With ``index`` (a ``TextIndex`` of the nodes) all words are one search of their
    postings; without, each word is a scan.
    """
    at = [F.col("qualified_name"), F.col("file_path").alias("file"), F.col("start_line").alias("line")]
    out = nodes.where(F.col("name").isin(words)).select(*at, F.lit(1.0).alias("score"), F.lit("exact").alias("source"), F.lit(0).alias("priority"))
    long = [w for w in words if len(w) >= 3]
    if index is not None:
        hits = index.search(long, per_word)
        word = F.get(F.array(*[F.lit(w.lower()) for w in long]), F.col("query")) if long else F.lit("")
        found = nodes.join(F.broadcast(hits.select("id", "query")), "id")  # so many rows for each word
        return out.union(found.select(*at, F.when(F.lower("name") == word, 0.8).otherwise(0.5), F.lit("text"), F.lit(1)))
    for w in long:
        score = F.when(F.lower("name") == w.lower(), 0.8).otherwise(0.5)
        hit = search_symbols(nodes, w, per_word, [c for c in SYMBOL_COLUMNS if c in nodes.columns])
        out = out.union(hit.select(*at, score, F.lit("text"), F.lit(1)))
    return out


def suggest_names(wanted: DataFrame, known: DataFrame, most: int = 3, distance: int = 2) -> DataFrame:
    """SRCH-10: for each unknown name (name) the nearest known ones within ``distance`` edits.

    Names within d edits have lengths within d, and of d + 1 equal pieces of one at least
    one stands in the other, so names meet by (length, piece) keys, never all with all.
    Names of d characters or fewer have an empty piece and meet all of such lengths.
    """
    w, k = wanted.select(F.col("name").alias("wanted")).distinct(), known.select(F.col("name").alias("known")).distinct()
    met = _piece_keys(w, "wanted", distance, True).join(_piece_keys(k, "known", distance, False), "piece").select("wanted", "known").distinct()
    scored = met.withColumn("distance", F.levenshtein("wanted", "known", distance)).where("distance >= 0")
    by = Window.partitionBy("wanted").orderBy("distance", "known")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def near_names(names: DataFrame, distance: int = 2) -> DataFrame:
    """SRCH-9: pairs (scope, a, b, distance), a < b, of names of a scope within ``distance`` edits.

    Names meet by their pieces, as in ``suggest_names``, never all with all.
    """
    n = names.select("scope", "name").where("name is not null").distinct()
    a, b = n.withColumnRenamed("name", "a"), n.withColumnRenamed("name", "b")
    met = _piece_keys(a, "a", distance, True).join(_piece_keys(b, "b", distance, False), ["scope", "piece"]).where("a < b").select("scope", "a", "b").distinct()
    return met.withColumn("distance", F.levenshtein("a", "b", distance).cast("long")).where("distance >= 0")


def _piece_keys(df: DataFrame, name: str, distance: int, own: bool) -> DataFrame:
    """The rows with the keys of the name's own pieces, or of those that it may hold."""
    grams = _pieces(F.col(name), distance, F.length(name)) if own else F.flatten(F.transform(F.sequence(F.length(name) - distance, F.length(name) + distance), lambda n: _windows(F.col(name), distance, n)))
    return df.select("*", F.explode(F.array_distinct(grams)).alias("piece"))


def _pieces(s: Column, d: int, n: Column) -> Column:
    """(length, number, piece) keys of a name cut into d + 1 pieces."""
    return F.transform(F.sequence(F.lit(0), F.lit(d)), lambda i: F.struct(n.alias("n"), i.alias("i"), F.substr(s, (i * n / (d + 1)).cast("int") + 1, ((i + 1) * n / (d + 1)).cast("int") - (i * n / (d + 1)).cast("int")).alias("p")))


def _windows(s: Column, d: int, n: Column) -> Column:
    """The keys by which a name of length n cut into pieces can meet this one."""
    def at(i: Column) -> Column:
        start, size = (i * n / (d + 1)).cast("int"), ((i + 1) * n / (d + 1)).cast("int") - (i * n / (d + 1)).cast("int")
        return F.transform(F.sequence(F.lit(-d), F.lit(d)), lambda k: F.struct(n.alias("n"), i.alias("i"), F.substr(s, F.greatest(start + k + 1, F.lit(1)), size).alias("p")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(d)), at))


def plural_pair(a: Column, b: Column) -> Column:
    """Whether one name is the other with s or es, or y for ies."""
    one = lambda x, y: (y == F.concat(x, F.lit("s"))) | (y == F.concat(x, F.lit("es"))) | (F.endswith(x, F.lit("y")) & (y == F.concat(F.regexp_replace(x, "y$", ""), F.lit("ies"))))
    return one(a, b) | one(b, a)


def adjacent_swap(a: Column, b: Column) -> Column:
    """Whether two names of one length differ by one swap of neighbours."""
    n = F.length(a)
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    i, j = F.get(differ, 0), F.get(differ, 1)
    cross = (F.substr(a, i, F.lit(1)) == F.substr(b, j, F.lit(1))) & (F.substr(a, j, F.lit(1)) == F.substr(b, i, F.lit(1)))
    return (n == F.length(b)) & (F.size(differ) == 2) & (j == i + 1) & cross


def confusable(a: Column, b: Column) -> Column:
    """SRCH-11: whether two names are easily taken for each other; rules in order."""
    la, lb = F.lower(a), F.lower(b)
    base = strip_digits(a)
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when((a != b) & (la == lb), True)
        .when(plural_pair(la, lb), False)
        .when((a != b) & (base == strip_digits(b)) & (F.length(base) >= 2), True)
        .when(F.least(F.length(a), F.length(b)) < 3, False)
        .when((F.length(a) >= 4) & adjacent_swap(a, b), True)
        .when(common_prefix(a, b) < 2, False)
        .otherwise((a != b) & (F.levenshtein(a, b) <= F.when(longest >= 6, 2).otherwise(1)))
    )


def _cuts(text: Column) -> Column:
    """A text without each one of its characters."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def confusable_pairs(names: DataFrame) -> DataFrame:
    """SRCH-11 over (scope, name): the pairs (scope, a, b), a < b, of confusable names of a scope.

    Names meet only where a rule can hold: on equal lower case, on equal text before the
    last digits, on equal letters, or on two first characters and a rest that is equal
    after leaving out up to two characters, as all names within two edits are.
    """
    n = names.select("scope", "name").where("scope is not null and name is not null").distinct()
    rest = F.substring("name", F.lit(3), F.length("name"))
    one = F.when(F.length("rest") > 0, _cuts(F.col("rest"))).otherwise(F.array().cast("array<string>"))
    two = F.flatten(F.transform("one", lambda t: F.when(F.length(t) > 0, _cuts(t)).otherwise(F.array().cast("array<string>"))))
    near = F.transform(F.array_distinct(F.concat(F.array("rest"), "one", two)), lambda t: F.concat(F.lit("n"), F.substring("name", 1, 2), t))
    keys = F.concat(
        F.array(F.concat(F.lit("l"), F.lower("name")), F.concat(F.lit("d"), strip_digits(F.col("name"))), F.concat(F.lit("s"), F.array_join(F.array_sort(F.split("name", "")), ""))),
        F.when(F.length("name") >= 2, near).otherwise(F.array().cast("array<string>")),
    )
    n = n.withColumn("rest", rest).withColumn("one", one).select("scope", "name", F.explode(F.array_distinct(keys)).alias("key"))
    met = n.toDF("scope", "a", "key").join(n.toDF("scope", "b", "key"), ["scope", "key"]).where(F.col("a") < F.col("b"))
    return met.select("scope", "a", "b").distinct().where(confusable(F.col("a"), F.col("b")))


def similar_names(names: DataFrame) -> DataFrame:
    """SRCH-12: greedy clusters of confusable names in each scope (scope, name, ordinal, refs).

    The first name not yet taken opens a cluster and takes all later ones that are
    confusable with it.  basis prefers no trailing digit, then length, then references.
    A scope is one function's names, which fit one task.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal").drop_duplicates("name")
        rows, left = [], list(pdf[["name", "refs"]].itertuples(index=False))
        while left:
            head, rest = left[0], left[1:]
            same = [r for r in rest if py_confusable(head.name, r.name)]
            left = [r for r in rest if r not in same]
            if same:
                group = [head, *same]
                basis = max(group, key=lambda r: (not r.name[-1:].isdigit(), len(r.name), r.refs))
                rows.append((pdf["scope"].iloc[0], basis.name, sorted(r.name for r in group)))
        return pd.DataFrame(rows, columns=["scope", "basis", "names"])

    return names.select("scope", "name", "ordinal", "refs").groupBy("scope").applyInPandas(run, "scope string, basis string, names array<string>")


def edit_distance(a: str, b: str) -> int:
    """SRCH-9 outside Spark."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def py_confusable(a: str, b: str) -> bool:
    """SRCH-11 outside Spark, for grouped functions."""
    if a == b:
        return False
    la, lb = a.lower(), b.lower()
    if la == lb:
        return True
    for x, y in ((la, lb), (lb, la)):
        if y in (x + "s", x + "es") or (x.endswith("y") and y == x[:-1] + "ies"):
            return False
    base = re.sub(r"[0-9]+$", "", a)
    if len(base) >= 2 and base == re.sub(r"[0-9]+$", "", b):
        return True
    if min(len(a), len(b)) < 3:
        return False
    if len(a) == len(b) >= 4:
        d = [i for i in range(len(a)) if a[i] != b[i]]
        if len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]:
            return True
    if a[:2] != b[:2]:
        return False
    return edit_distance(a, b) <= (2 if max(len(a), len(b)) >= 6 else 1)


def import_index(sources: DataFrame, pattern: str) -> DataFrame:
    """SRCH-13: per imported key (group 1 of ``pattern``) the files that import it."""
    hits = sources.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))).alias("key"))
    return hits.groupBy("key").agg(F.sort_array(F.collect_set("path")).alias("files"))


def text_mentions(sources: DataFrame, name: str, per_file: int | None = None, max_files: int | None = None) -> DataFrame:
    """SRCH-14: (path, line, text) of lines that mention a name as a word, from line 1.

    At most ``per_file`` lines of a file, and those of the first ``max_files`` files by path.
    """
    word = rf"\b{re.escape(name)}\b"
    held = sources.where(F.col("content").rlike(word))
    if max_files is not None:
        # The file cap bounds what is broadcast.
        held = held.join(F.broadcast(held.select("path").distinct().orderBy("path").limit(max_files)), "path", "left_semi")
    lines = held.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    hits = lines.where(F.col("text").rlike(word)).select("path", (F.col("at") + 1).alias("line"), "text")
    if per_file is None:
        return hits
    by = Window.partitionBy("path").orderBy("line")
    return hits.withColumn("r", F.row_number().over(by)).where(F.col("r") <= per_file).drop("r")


LEVELS = ("exact", "blanks", "indent", "ellipsis")


def locate_block(content: str, block: str) -> tuple[str | None, list[tuple[int, int]]]:
    """SRCH-15: (level, line spans from 1) of a block of lines in a text.

    Levels in order: exact, blanks folded, indent-free, and ``...`` lines that stand for
    any lines.  The first level with a match ends the search, be it unique or not.
    """
    have, want = content.split("\n"), block.strip("\n").split("\n")
    fold = lambda s: re.sub(r"\s+", " ", s).strip()
    for level, form in (("exact", lambda s: s), ("blanks", fold), ("indent", lambda s: re.sub(r"\s+", "", s))):
        h, w = [form(x) for x in have], [form(x) for x in want]
        found = [(i + 1, i + len(w)) for i in range(len(h) - len(w) + 1) if h[i : i + len(w)] == w]
        if found:
            return level, found
    if any(fold(x) == "..." for x in want):
        parts: list[list[str]] = [[]]
        for x in want:
            if fold(x) == "...":
                parts.append([])
            else:
                parts[-1].append(fold(x))
        parts = [p for p in parts if p]
        h, found = [fold(x) for x in have], []
        for i in range(len(h)):
            at = i
            for k, p in enumerate(parts):
                spot = next((j for j in range(at, len(h) - len(p) + 1) if h[j : j + len(p)] == p and (k or j == i)), None)
                if spot is None:
                    break
                at = spot + len(p)
            else:
                if parts:
                    found.append((i + 1, at))
        if found:
            return "ellipsis", found
    return None, []


def locate_blocks(sources: DataFrame, block: str) -> DataFrame:
    """SRCH-15 over files: (path, level, spans, unique)."""
    def run(batches):
        for pdf in batches:
            found = [locate_block(c or "", block) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "level": [f[0] for f in found], "spans": [[{"start": a, "end": b} for a, b in f[1]] for f in found], "unique": [len(f[1]) == 1 for f in found]})

    return sources.select("path", "content").mapInPandas(run, "path string, level string, spans array<struct<start:int,end:int>>, unique boolean")


def rule_regex(pattern: str) -> str:
    """SRCH-16: a pattern with $holes and ... as a regular expression.

    Blanks match any blanks; a hole is the shortest text in one line and must be the
    same wherever its name repeats; ... is the shortest text over lines.
    """
    out, seen = [], set()
    for part in re.split(r"(\$[A-Za-z_]\w*|\.\.\.|\s+)", pattern.strip()):
        if not part:
            continue
        if part.startswith("$") and len(part) > 1:
            name = part[1:]
            out.append(f"(?P={name})" if name in seen else f"(?P<{name}>[^\\n]+?)")
            seen.add(name)
        elif part == "...":
            out.append(r"[\s\S]*?")
        elif part.isspace():
            out.append(r"\s+")
        else:
            out.append(re.escape(part))
    return "".join(out)


def match_rules(sources: DataFrame, rules: dict[str, str]) -> DataFrame:
    """SRCH-16 on text: (rule, path, line, text) of every non-overlapping match; ``rules.match_rules`` works on tokens."""
    compiled = {k: rule_regex(v) for k, v in rules.items()}

    def run(batches):
        tests = {k: re.compile(v) for k, v in compiled.items()}
        for pdf in batches:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                for k, t in tests.items():
                    line, at = 1, 0
                    for m in t.finditer(c or ""):
                        line, at = line + c.count("\n", at, m.start()), m.start()
                        rows.append((k, p, line, m.group()))
            yield pd.DataFrame(rows, columns=["rule", "path", "line", "text"])

    return sources.select("path", "content").mapInPandas(run, "rule string, path string, line int, text string")


def ratchet(hits: DataFrame, baseline: DataFrame) -> DataFrame:
    """SRCH-17: (rule, file) whose hits exceed the baseline (none: 0), by rule and file."""
    total = hits.groupBy("rule", "file").agg(F.sum("hits").alias("hits"))
    out = total.join(baseline.select("rule", "file", F.col("hits").alias("base")), ["rule", "file"], "left").withColumn("base", F.coalesce("base", F.lit(0)))
    return out.where("hits > base").orderBy("rule", "file")


def dictionary_hits(texts: DataFrame, terms: list[str]) -> DataFrame:
    """SRCH-18: (id, term, n) of dictionary terms in texts, as substrings in any case.

    ``terms`` are a dictionary given by the caller, held in the plan.
    """
    low = F.lower("text")
    counts = F.array(*[F.struct(F.lit(t).alias("term"), ((F.length(low) - F.length(F.replace(low, F.lit(t.lower()), F.lit("")))) / len(t)).cast("long").alias("n")) for t in terms])
    return texts.select("id", F.inline(F.filter(counts, lambda x: x["n"] > 0)))


def highlight(text: str, terms: Iterable[str]) -> list[tuple[str, str | None]]:
    """SRCH-18: a text cut at non-overlapping hits, longest term first: (piece, term or None)."""
    ordered = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not ordered:
        return [(text, None)]
    low, out, at = {t.lower(): t for t in reversed(ordered)}, [], 0
    for m in re.finditer("|".join(re.escape(t) for t in ordered), text, re.I):
        if m.start() > at:
            out.append((text[at : m.start()], None))
        out.append((m.group(), low.get(m.group().lower(), m.group())))
        at = m.end()
    return out + ([(text[at:], None)] if at < len(text) or not out else [])


def version_rules(sources: DataFrame, rules: list[tuple[str, str, float]], declared: float, removed: bool = False) -> DataFrame:
    """SRCH-19: (path, line, rule) of lines that match a rule (id, pattern, since).

    New features count when since exceeds the least version supported (all if that is
    below 0); removed ones when the declared version is at or beyond since.
    """
    active = [r for r in rules if (declared >= r[2] if removed else declared < 0 or r[2] > declared)]
    lines = sources.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    marks = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(i)) for i, p, _ in active])) if active else F.array().cast("array<string>")
    return lines.select("path", (F.col("at") + 1).alias("line"), F.explode(marks).alias("rule")).distinct()


def find_references(sources: DataFrame, name: str, closure: DataFrame, confirm: Callable[[Column], Column] | None = None) -> DataFrame:
    """SRCH-20: mentions of a name in files of an import closure (path), and if each is confirmed.

    ``confirm`` tests a line; by default a line that is no comment and no string.
    """
    confirm = confirm or (lambda text: ~F.trim(text).rlike(r"^(//|#|\*|/\*)") & ~text.rlike(rf"""["'][^"']*\b{re.escape(name)}\b[^"']*["']"""))
    hits = text_mentions(sources, name).join(closure.select("path").distinct(), "path", "left_semi")
    return hits.withColumn("confirmed", confirm(F.col("text")))


def match_documents(docs: DataFrame, targets: list[str], limit: int = 20) -> DataFrame:
    """SRCH-21: documents for targets: by a tag, else, if untagged, by a word of the file name.

    Substrings in any case; words of 2 characters or more; tag matches come first.
    """
    wants = [t.lower() for t in targets]
    low = lambda c: F.lower(c)
    tag = F.exists("tags", lambda x: sum((F.contains(low(x), F.lit(t)).cast("int") for t in wants), F.lit(0)) > 0)
    words = F.filter(name_tokens(F.regexp_replace("path", r"\.[^.]*$", "")), lambda w: F.length(w) >= 2)
    name = F.exists(words, lambda w: sum((F.contains(F.lit(t), w).cast("int") for t in wants), F.lit(0)) > 0)
    tagged = F.coalesce(F.size("tags"), F.lit(0)) > 0
    via = F.when(tagged & tag, "tag").when(~tagged & name, "name")
    return docs.withColumn("via", via).where("via is not null").orderBy(F.desc("via"), "path").limit(limit)


def parse_symptoms(reports: DataFrame, stop_words: list[str]) -> DataFrame:
    """SRCH-22: per report (id, text): locations file:line, symbols and keywords, each once, in order."""
    t = F.col("text")
    spots = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"([\w./-]+\.[a-z]{1,4}:\d+)"), F.lit(1)), lambda x: x))
    symbols = F.array_distinct(F.filter(F.concat(F.regexp_extract_all(t, F.lit(r"`([^`]+)`"), F.lit(1)), F.regexp_extract_all(t, F.lit(r"\b([A-Za-z_]\w*)\("), F.lit(1))), lambda s: F.length(s) >= 2))
    stop = F.array(*[F.lit(w) for w in stop_words]).cast("array<string>")
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(t), F.lit(r"([a-z_]\w{2,})"), F.lit(1)), lambda w: ~F.array_contains(stop, w)))
    kind = F.regexp_extract(t, r"\b(\w*(?:Error|Exception))\b", 1)
    return reports.select("id", spots.alias("locations"), symbols.alias("symbols"), words.alias("keywords"), F.nullif(kind, F.lit("")).alias("error_kind"))


def root_causes(candidates: DataFrame, file: str, line: int) -> DataFrame:
    """SRCH-23: candidates (name, file, start, end, score, on_chain, direct) with their final score and kind.

    +0.2 in the first location's file, +0.1 if its line is inside, +0.15 on the chain,
    +0.05 directly affected; clamped to 0..1; best first, then by line.
    """
    same = F.col("file") == file
    inside = same & F.lit(line).between(F.col("start"), F.col("end"))
    add = lambda c, v: F.when(c, v).otherwise(0.0)
    raw = F.col("score") + add(same, 0.2) + add(inside, 0.1) + add(F.col("on_chain"), 0.15) + add(F.col("direct"), 0.05)
    kind = F.when(inside, "error_direct").when(F.col("on_chain") & F.col("direct"), "caller").when(F.col("on_chain"), "callee").otherwise("inferred")
    out = candidates.withColumns({"final": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 6), "cause": kind})
    return out.orderBy(F.desc("final"), "start", "name")
