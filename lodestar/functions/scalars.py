"""Scalar functions on columns, all inside whole-stage code generation."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_path(path: Column) -> Column:
    """Backslashes become slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def dirname(path: Column) -> Column:
    """The folder of a path, '.' for one without a slash."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_of(node_id: Column) -> Column:
    """The file part of a node id ``file#name``."""
    return F.substring_index(node_id, "#", 1)


def strip_scope(probe: Column) -> Column:
    """A probe name without its .enter, .exit or .catch."""
    return F.regexp_replace(probe, r"\.(enter|exit|catch)$", "")


def strip_digits(name: Column) -> Column:
    return F.regexp_replace(name, "[0-9]+$", "")


def fold_blanks(text: Column) -> Column:
    """Runs of blanks become one; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def name_tokens(name: Column) -> Column:
    """Lower-case words of a camelCase, snake_case or dotted name."""
    cut = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(F.trim(cut)), " "), lambda w: w != "")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    upto = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.array_max(F.filter(upto, lambda n: F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n)))


def log2_bucket(us: Column, buckets: int = 20) -> Column:
    """floor(log2(max(us, 1))), the last bucket open; exact at powers of two."""
    return F.least(F.lit(buckets - 1), F.length(F.bin(F.greatest(us.cast("long"), F.lit(1)))) - 1)


def half_up(x: Column) -> Column:
    """Rounds .5 towards plus infinity."""
    return F.floor(x + 0.5)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def risk_by_degree(n: Column) -> Column:
    return F.when(n >= 8, "high").when(n >= 3, "medium").otherwise("low")


def word_rlike(text: Column, word: str) -> Column:
    """Whether a word stands in a text between word boundaries."""
    return text.rlike(rf"\b{re.escape(word)}\b")


def parse_time(text: Column) -> Column:
    """Milliseconds of an RFC 3339 time, 0 if it cannot be read."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(text)), F.lit(0))


def is_hot(time: Column, now: Column) -> Column:
    """Changed within the last day."""
    return (now.cast("timestamp").cast("double") - time.cast("timestamp").cast("double")) < 86400


#: Fixed shapes of files that are products of tools, not sources.
NOISE = r"(\.min\.js|\.d\.ts|\.gen\.[tj]sx?|\.tmp|\.temp|\.crswap|\.crdownload|\.swp|\.swo|\.swx|\.bak|\.orig|\.rej|\.timestamp-\d+-\w+\.mjs|~)$"


def file_kind(path: Column) -> Column:
    """main, test, noise or excluded, by path."""
    p = F.lower(norm_path(path))
    return (
        F.when(p.rlike(r"(^|/)(node_modules|vendor|dist|build|out|\.git)/"), "excluded")
        .when(p.rlike(r"(^|/)(tests?|__tests__|spec)/|[._](test|spec)\.[a-z]+$|_test\.go$"), "test")
        .when(p.rlike(NOISE), "noise")
        .otherwise("main")
    )


def size_status(lines: Column) -> Column:
    """ok below 500 lines, warn from 500, large from 1000."""
    return F.when(lines >= 1000, "large").when(lines >= 500, "warn").otherwise("ok")


def regex_complexity(body: Column) -> Column:
    """1 plus the branches that a regular expression finds."""
    return F.lit(1) + F.size(F.regexp_extract_all(body, F.lit(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?"), F.lit(0)))


def version_at_least(version: Column, major: int, minor: int) -> Column:
    """Compares the first two numbers of a version; unreadable ones are not."""
    part = lambda i: F.coalesce(F.regexp_extract(version, r"(\d+)\.?(\d*)", i).try_cast("int"), F.lit(0))
    known = version.rlike(r"\d")
    return known & ((part(1) > major) | ((part(1) == major) & (part(2) >= minor)))


def span_hash(lines: Column, start: Column, end: Column) -> Column:
    """SHA-1 of lines start..end (from 1) without any white space."""
    text = F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "\n")
    return F.sha1(F.regexp_replace(text, r"(?U)[\s﻿]+", "").cast("binary"))


def usage_weight(calls: Column, most: Column) -> Column:
    """log1p(calls) / log1p(most), at most 1; 0 where nothing was called."""
    return F.least(F.lit(1.0), ratio(F.log1p(calls), F.log1p(most)))


_COND = re.compile(r"^\s*([A-Za-z_]\w*)\s*(==|!=|<=|>=|<|>)\s*('[^']*'|-?\d+(?:\.\d+)?|true|false)\s*$")


def condition(text: str, scope: dict[str, Column]) -> Column:
    """A condition of comparisons joined by && or ||, over named columns.

    && binds tighter; a name outside ``scope`` or any other syntax is an error, never a
    null, and no text is evaluated.
    """
    ors = None
    for alternative in text.split("||"):
        ands = None
        for term in alternative.split("&&"):
            m = _COND.match(term)
            if not m:
                raise ValueError(f"not a comparison: {term!r}")
            name, op, raw = m.groups()
            if name not in scope:
                raise KeyError(name)
            value = raw[1:-1] if raw[0] == "'" else raw == "true" if raw in ("true", "false") else float(raw)
            c = scope[name]
            test = {"==": c == value, "!=": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]
            ands = test if ands is None else ands & test
        ors = ands if ors is None else ors | ands
    return ors


def fits_schema(text: Column, schema: str) -> Column:
    """Whether a JSON text is an object whose fields have the types of a schema; absent fields may be."""
    parsed = F.from_json(text, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return text.isNotNull() & F.coalesce(parsed["_bad"].isNull(), F.lit(False)) & F.startswith(F.trim(text), F.lit("{"))


def json_path(text: Column, path: str) -> Column:
    """The value at a path a.b[0].c of a JSON text, as text; null where there is none."""
    return F.get_json_object(text, "$." + path)


def first_json_object(text: Column) -> Column:
    """The first JSON object in a text, as it stands there; null where there is none."""
    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        read = json.JSONDecoder()

        def one(t):
            at = t.find("{") if isinstance(t, str) else -1
            while at >= 0:
                try:
                    return t[at : read.raw_decode(t, at)[1]]
                except (ValueError, RecursionError):
                    at = t.find("{", at + 1)
            return None

        return texts.map(one)

    return find(text)


def json_set(text: Column, path: str, value: Column) -> Column:
    """The JSON text with ``value`` (JSON text) at a path a.b.c; objects on the way are made.

    Null where the text is no object, or where something else stands on the way.
    """
    @F.pandas_udf("string")
    def put(texts: pd.Series, values: pd.Series) -> pd.Series:
        def one(t, v):
            try:
                doc, new = json.loads(t), json.loads(v)
                at, keys = doc, path.split(".")
                for k in keys[:-1]:
                    at = at.setdefault(k, {})
                at[keys[-1]] = new
                return json.dumps(doc, separators=(",", ":"), ensure_ascii=False) if isinstance(doc, dict) else None
            except (ValueError, TypeError, AttributeError):
                return None

        return pd.Series([one(t, v) for t, v in zip(texts, values, strict=True)], dtype=object)

    return put(text, value)


def flatten_map(nested: Column) -> Column:
    """A map of maps as one map with keys outer.inner."""
    inner = F.transform(F.map_entries(nested), lambda e: F.transform(F.map_entries(e["value"]), lambda x: F.struct(F.concat_ws(".", e["key"], x["key"]).alias("key"), x["value"].alias("value"))))
    return F.map_from_entries(F.flatten(F.filter(inner, lambda x: x.isNotNull())))
