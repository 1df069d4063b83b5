"""Rules on tokens and dictionaries on texts (SRCH-16, SRCH-18)."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of dictionary forms that one automaton takes; a larger dictionary is dealt over several.
PART_CHARS = 4 << 20

_TOKEN = re.compile(r"""\s+|(?P<t>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[^\W\d]\w*|\d[\w.]*|\.\.\.|[^\s\w]|_\w*)""")
_HOLE = re.compile(r"\$[A-Za-z_]\w*|\.\.\.")
_CLOSERS = {")": "(", "]": "[", "}": "{"}
#: What tells how tokens before it are read: brackets, and quotes that may hide some.
_SHAPES = re.compile(r"""[()\[\]{}"'`]""")


@dataclass(frozen=True)
class Match:
    """A match: its place in the text, the text, and what its holes hold."""

    start: int
    end: int
    text: str
    holes: dict[str, str]


def _tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m["t"], m.start(), m.end()) for m in _TOKEN.finditer(text) if m["t"]]


def _parts(pattern: str) -> list[tuple[str, str]]:
    """(kind, value) of a pattern's tokens: word, hole or rest."""
    out, at = [], 0
    for m in _HOLE.finditer(pattern):
        out += [("word", t) for t, _, _ in _tokens(pattern[at : m.start()])]
        out.append(("rest", "") if m[0] == "..." else ("hole", m[0][1:]))
        at = m.end()
    return out + [("word", t) for t, _, _ in _tokens(pattern[at:])]


def windows(rules: dict[str, str]) -> dict[str, list[str]]:
    """The words that a text must hold for a rule to match anywhere."""
    return {name: sorted({v for kind, v in _parts(pattern) if kind == "word"}) for name, pattern in rules.items()}


def _bound(text: str, pattern: str) -> int:
    """Where the last match can end: after the last place of the pattern's last word."""
    want = _parts(pattern)
    return text.rfind(want[-1][1]) + len(want[-1][1]) if want and want[-1][0] == "word" else len(text)


class _Tokens:
    """A text's tokens, at least those that begin before ``upto``, and its brackets.

    The rest is left out only if it has nothing that brackets depend on.
    """

    def __init__(self, text: str, upto: int):
        self.have = have = []
        for m in _TOKEN.finditer(text):
            if m.start() >= upto:
                if not _SHAPES.search(text, m.start()):
                    break
                upto = len(text)
            if m["t"]:
                have.append((m["t"], m.start(), m.end()))
        self.words = words = [t for t, _, _ in have]
        closes, held = {}, []
        for i, w in enumerate(words):
            if w in ("(", "[", "{"):
                held.append(i)
            elif w in _CLOSERS and held and words[held[-1]] == _CLOSERS[w]:
                closes[held.pop()] = i
            elif w in _CLOSERS:
                held.clear()  # brackets around a stray one are no pairs
        # Runs of tokens that steps can pass: what lies within one pair of brackets, cut at stray ones.
        run, places, ends, around, ended, last_run = [-1] * len(words), {}, {}, [0], set(closes.values()), 0
        for i, w in enumerate(words):
            if i in ended:
                ends[around.pop()] = i
            elif w in ("(", "[", "{") and i not in closes or w in _CLOSERS:
                ends[around[-1]] = i
                last_run += 1
                around[-1] = last_run
            else:
                run[i] = around[-1]
                places.setdefault((run[i], w), []).append(i)
                if i in closes:
                    last_run += 1
                    around.append(last_run)
        self.closes, self.run, self.places, self.ends = closes, run, places, ends
        self.last = {w: i for i, w in enumerate(words)}


def match_tokens(text: str, pattern: str, tokens: _Tokens | None = None) -> list[Match]:
    """SRCH-16: matches of a pattern with $holes and ..., on tokens: blanks and lines do not count.

    A hole is one token or more, ... any number; both hold whole brackets only.  A hole
    whose name repeats holds the same tokens each time.  Of the matches from one token
    the longest counts, and the next one begins after it.
    """
    want = _parts(pattern)
    if not want:
        return []
    tokens = tokens or _Tokens(text, _bound(text, pattern))
    have, words, closes, run, places, ends = tokens.have, tokens.words, tokens.closes, tokens.run, tokens.places, tokens.ends

    def step(i: int) -> int | None:
        """The token after the one at ``i``, with its brackets; none at a bracket's end."""
        if i >= len(words) or run[i] < 0:
            return None
        return closes[i] + 1 if i in closes else i + 1

    def reach(i: int, word: str, least: int) -> Iterator[int]:
        """Where ``word`` stands, ``least`` tokens or more from ``i`` on, with whole brackets between."""
        if not least and i < len(words) and words[i] == word and run[i] < 0:
            yield i
        if i < len(words) and run[i] >= 0:
            found = places.get((run[i], word), ())
            yield from found[bisect.bisect_left(found, i + least) :]
            end = ends.get(run[i])
            if end is not None and words[end] == word:
                yield end

    def longest(start: int) -> tuple[int, dict[str, tuple[int, int]]] | None:
        # States are (token, place in the pattern, holes); each is tried once.
        best, seen, todo = None, set(), [(start, 0, ())]
        while todo:
            state = todo.pop()
            if state in seen:
                continue
            seen.add(state)
            i, k, holes = state
            if k == len(want):
                if best is None or i > best[0]:
                    best = (i, dict(holes))
                continue
            kind, value = want[k]
            if kind == "word":
                if i < len(words) and words[i] == value:
                    todo.append((i + 1, k + 1, holes))
                continue
            known = dict(holes).get(value) if kind == "hole" else None
            if known:
                n = known[1] - known[0]
                if words[i : i + n] == words[known[0] : known[1]]:
                    todo.append((i + n, k + 1, holes))
                continue
            put = lambda at: todo.append((at, k + 1, holes if kind == "rest" else (*holes, (value, (i, at)))))  # noqa: B023, E731
            if k + 1 < len(want) and want[k + 1][0] == "word":
                # Only places where the next word stands can go on.
                for at in reach(i, want[k + 1][1], int(kind == "hole")):
                    put(at)
                continue
            at = i if kind == "rest" else step(i)
            while at is not None:
                put(at)
                if k + 1 == len(want) and kind == "hole":
                    break  # nothing ends a last hole: it takes one token
                at = step(at)
        return best

    out, at = [], 0
    begins = want[0][1] if want[0][0] == "word" else None
    # No match begins after the last place of any of its words.
    past = min((tokens.last.get(v, -1) + 1 for kind, v in want if kind == "word"), default=len(words))
    while at < past:
        found = longest(at) if begins is None or words[at] == begins else None
        if found and found[0] > at:
            a, b = have[at][1], have[found[0] - 1][2]
            out.append(Match(a, b, text[a:b], {n: text[have[i][1] : have[j - 1][2]] for n, (i, j) in found[1].items()}))
            at = found[0]
        else:
            at += 1
    return out


def match_rules(sources: DataFrame, rules: dict[str, str]) -> DataFrame:
    """SRCH-16 over files (path, content): (rule, path, line, end_line, text, holes) of every match.

    Texts without all words of any rule are left out before they are cut into tokens.
    That is looked up in the task: as conditions on a computed content, it would be
    computed again for each word.
    """
    need = windows(rules)
    kind = pa.schema([("rule", pa.string()), ("path", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("text", pa.string()), ("holes", pa.map_(pa.string(), pa.string()))])

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                here = {rule: pattern for rule, pattern in rules.items() if content is not None and all(w in content for w in need[rule])}
                tokens = _Tokens(content, max(_bound(content, p) for p in here.values())) if here else None
                for rule, pattern in here.items():
                    line, at = 1, 0
                    for m in match_tokens(content, pattern, tokens):
                        line += content.count("\n", at, m.start)
                        at = m.start
                        rows.append((rule, path, line, line + m.text.count("\n"), m.text, list(m.holes.items())))
            columns = list(zip(*rows, strict=True)) or [()] * len(kind)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    schema = "rule string, path string, line int, end_line int, text string, holes map<string,string>"
    return sources.select("path", "content").mapInArrow(run, schema)


def _folded(text: str) -> str:
    """Lower case, sign by sign, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def dictionary_splits(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """SRCH-18: (id, start, end, term) of the pieces of texts (id, text) that a dictionary names.

    ``terms`` are (term, form): the forms of a term, found anywhere and in any case.  Of
    hits that begin at one place the longest counts, and of terms the first by name; hits
    that overlap are one piece of the first one's term.  Forms are searched all at once
    by an automaton, built once in a task; a dictionary of more than PART_CHARS
    characters is dealt over several, each a pass of its own.  Null texts have no pieces.
    """
    forms = terms.where(F.length("form") > 0).select("term", "form").distinct()
    size = forms.agg(F.sum(F.length("form"))).first()[0] or 0
    parts = max(1, -(-size // PART_CHARS))
    spark = texts.sparkSession

    def finder(share):
        def run(batches):
            import ahocorasick

            machine = ahocorasick.Automaton()
            for term, form in share.value:
                low = _folded(form)
                if low not in machine or term < machine.get(low)[0]:
                    machine.add_word(low, (term, len(low)))
            if len(machine):
                machine.make_automaton()
            for batch in batches:
                rows = []
                for own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    hits = sorted((end - n + 1, -(end + 1), term) for end, (term, n) in machine.iter(_folded(text))) if len(machine) and text else []
                    merged: list[list] = []
                    for start, end, term in hits:
                        if merged and start < merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], -end)
                        else:
                            merged.append([start, -end, term, -end])
                    rows += [(own, *m) for m in merged] if parts == 1 else [(own, s, -e, t, -e) for s, e, t in hits]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32()), strict=True)], ["id", "start", "end", "term", "first"])

        return run

    rows, found = texts.select(F.col("id").cast("long").alias("id"), "text").where("text is not null"), None
    for k in range(parts):
        # At most about PART_CHARS characters, by a hash of the form.
        mine = [tuple(r) for r in forms.where(F.pmod(F.xxhash64("form"), F.lit(parts)) == k).collect()]
        part = rows.mapInArrow(finder(spark.sparkContext.broadcast(mine)), "id long, start int, end int, term string, first int")
        found = part if found is None else found.union(part)
    if parts > 1:
        # Hits of all automata are merged by a sweep over each text.
        order = Window.partitionBy("id").orderBy("start", F.desc("end"), "term")
        reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        piece = F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
        swept = found.withColumn("reach", reach).withColumn("piece", piece)
        head = F.min_by("term", F.struct("start", (-F.col("end")).alias("e"), "term")).alias("term")
        found = swept.groupBy("id", "piece").agg(F.min("start").alias("start"), F.max("end").alias("end"), head)
    return found.select("id", "start", "end", "term")
