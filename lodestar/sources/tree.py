"""Source trees as tables: walk, parse, dependency manifests (SRC-1, SRC-2, SRC-7)."""

from __future__ import annotations

import ast
import hashlib
import json
import re
import tomllib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.scalars import file_kind, norm_path
from lodestar.sources.braces import parse_braces
from lodestar.sources.store import _files, get_text

SOURCE_NAMES = r"\.(py|ts|tsx|js|jsx|go|rs|java)$"


def ignore_pattern(line: str, folder: str = "") -> tuple[str, bool] | None:
    """(regular expression on paths, whether it ignores) of a line of an ignore file in ``folder``.

    A slash before the end ties a pattern to its folder; one at the end means folders
    only; ``*``, ``**``, ``?``, classes and a leading ``!`` are read.  None for blank lines
    and comments.
    """
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    keeps, line = line.startswith("!"), line.removeprefix("!")
    below, line = line.endswith("/"), line.rstrip("/")
    tied, line = "/" in line, line.lstrip("/")
    out, at = "", 0
    while at < len(line):
        c = line[at]
        if line.startswith("**/", at):
            out, at = out + "(?:[^/]+/)*", at + 3
        elif line.startswith("/**", at) and at + 3 == len(line):
            out, at = out + "/.+", at + 3
        elif c == "*":
            out, at = out + "[^/]*", at + 1
        elif c == "?":
            out, at = out + "[^/]", at + 1
        elif c == "[" and "]" in line[at + 2 :]:
            end = line.index("]", at + 2)
            out, at = out + "[" + ("^" if line[at + 1] in "!^" else "") + line[at + (2 if line[at + 1] in "!^" else 1) : end].replace("\\", "\\\\") + "]", end + 1
        else:
            if c == "\\" and at + 1 < len(line):
                at += 1
                c = line[at]
            out, at = out + re.escape(c), at + 1
    start = re.escape(folder.strip("/") + "/") if folder.strip("/") else ""
    return f"^{start}{'' if tied else '(?:.*/)?'}{out}{'/' if below else '(?:/|$)'}", not keeps


def ignore_rules(spark: SparkSession, root: str) -> list[tuple[str, bool]]:
    """Patterns of all .gitignore files below a folder, outer ones first; as many as they have lines."""
    fs, top, _ = _files(spark, root)
    found, folders = [], [(top, "")]
    while folders:
        at, name = folders.pop()
        for s in fs.listStatus(at) if fs.exists(at) else []:
            own = s.getPath().getName()
            if s.isDirectory() and not own.startswith(".") and own not in EXCLUDED:
                folders.append((s.getPath(), f"{name}{own}/"))
            elif own == ".gitignore":
                found.append((name, get_text(spark, s.getPath().toString()) or ""))
    lines = [ignore_pattern(line, name) for name, text in sorted(found) for line in text.split("\n")]
    return [x for x in lines if x]


def ignored_by(rules: list[tuple[str, bool]], path: str) -> bool:
    """Whether ignore rules take a file out: a folder on its way that is ignored, or the file itself.

    The last rule that fits decides; what lies in an ignored folder is never taken back in.
    """
    at = 0
    while at >= 0:
        at = path.find("/", at + 1)
        own, ignores = path if at < 0 else path[:at], False
        for pattern, says in rules:
            if re.fullmatch(pattern, own) or (at >= 0 and pattern.endswith("/") and re.fullmatch(pattern, own + "/")):
                ignores = says
        if ignores:
            return True
    return False


EXCLUDED = {"node_modules", "vendor", "dist", "build", "out"}


def walk(spark: SparkSession, root: str, ignored: list[str] | None = None, tests: bool = False) -> DataFrame:
    """SRC-1: source files below a folder (path, content, size, modified_at).

    Leaves out excluded and noise files, tests unless asked for, what .gitignore files
    name (the last rule that fits a path decides), and paths that one of the ``ignored``
    regular expressions finds.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # The file source gives full paths; what follows the root names the file.
    tail = F.regexp_replace(F.col("path"), f"^.*?{re.escape(root.rstrip('/').split('://')[-1])}/", "")
    files = raw.select(norm_path(tail).alias("path"), F.col("content").cast("string").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    kept = files.where(F.col("path").rlike(SOURCE_NAMES)).withColumn("kind", file_kind(F.col("path")))
    kept = kept.where(F.col("kind").isin("main", "test") if tests else F.col("kind") == "main")
    if rules := ignore_rules(spark, root):
        kept = kept.where(~_ignored(rules)(F.col("path")))
    for pattern in ignored or []:
        kept = kept.where(~F.col("path").rlike(pattern))
    return kept.drop("kind")


def _ignored(rules: list[tuple[str, bool]]):
    """Tests paths against all rules at once, however many they are."""

    @F.pandas_udf("boolean")
    def test(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: ignored_by(rules, p))

    return test


def changed_files(spark: SparkSession, root: str, since: str = "HEAD") -> DataFrame:
    """SRC-9: (path) of files that git says differ from ``since``, untracked ones too; none outside a repository."""
    import subprocess

    def git(*args: str) -> list[str]:
        try:
            done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60, check=False)
        except (OSError, subprocess.TimeoutExpired):
            return []
        return [x for x in done.stdout.split("\0") if x] if done.returncode == 0 else []

    if since.startswith("-"):
        raise ValueError("not a revision")
    names = {*git("diff", "--name-only", "-z", since, "--"), *git("ls-files", "--others", "--exclude-standard", "-z")}
    return spark.createDataFrame([(x,) for x in sorted(names)], "path string")


def blob_hash(content: Column) -> Column:
    """The name that git gives a file's content."""
    data = content.cast("binary")
    head = F.concat(F.lit("blob "), F.octet_length(data).cast("string"))
    return F.sha1(F.concat(F.encode(head, "UTF-8"), F.unhex(F.lit("00")), data))


def tree_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """SRC-9 on tables (path, content): (path, change) of files that are added, deleted or modified, by their hashes."""
    a, b = (x.select("path", blob_hash(F.col("content")).alias("hash")) for x in (before, after))
    both = a.withColumnRenamed("hash", "was").join(b.withColumnRenamed("hash", "is"), "path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("was") != F.col("is"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def parse_python(path: str, content: str) -> list[dict]:
    """Symbols, imports and calls of Python source; nothing for what does not parse."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return [{"row": "error", "name": "syntax"}]
    lines, rows = content.split("\n"), []

    def visit(node, scope: list[str], owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if scope and isinstance(node, ast.ClassDef) else "function"
                name = ".".join([*scope, child.name])
                body = "".join("".join(lines[child.lineno - 1 : child.end_lineno]).split())
                rows.append({"row": "symbol", "kind": kind, "name": child.name, "qualified_name": name, "line": child.lineno, "end_line": child.end_lineno, "hash": hashlib.sha1(body.encode()).hexdigest(), "closure": bool(scope) and kind == "function"})
                visit(child, [*scope, child.name], name)
                continue
            if isinstance(child, ast.Import):
                rows.extend({"row": "import", "name": a.name, "kind": "package", "line": child.lineno} for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                rows.append({"row": "import", "name": "." * child.level + (child.module or ""), "kind": "relative" if child.level else "package", "line": child.lineno})
            elif isinstance(child, ast.Call):
                f = child.func
                called = f.id if isinstance(f, ast.Name) else f"{f.value.id}.{f.attr}" if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) else None
                if called:
                    rows.append({"row": "call", "name": called, "qualified_name": owner, "line": child.lineno})
            visit(child, scope, owner)

    visit(tree, [], "")
    return rows


PARSERS = {"py": parse_python}  # all others by their braces
PARSED = "path string, row string, kind string, name string, qualified_name string, line int, end_line int, hash string, closure boolean"


def parse(files: DataFrame, parsers=None) -> DataFrame:
    """SRC-2: rows of symbols, imports, calls and type references of (path, content).

    Parsers are pluggable by extension: name -> function(path, content) -> rows.
    """
    table = parsers or PARSERS

    kinds = pa.schema([(n, {"int": pa.int32(), "boolean": pa.bool_()}.get(t, pa.string())) for n, t in (c.split() for c in PARSED.split(", "))])

    def run(batches):
        for batch in batches:
            rows = [{"path": p, **r} for p, c in zip(*(x.to_pylist() for x in batch.columns), strict=True) for r in table.get(p.rsplit(".", 1)[-1], parse_braces)(p, c or "")]
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select("path", "content").mapInArrow(run, PARSED)


def parse_manifest(name: str, content: str) -> list[tuple[str, str, str]]:
    """(package, version, group) of a dependency manifest; none if it is corrupt."""
    try:
        if name == "package.json":
            doc = json.loads(content)
            return [(k, v, g) for g in ("dependencies", "devDependencies", "peerDependencies") for k, v in (doc.get(g) or {}).items()]
        if name == "go.mod":
            return [(m[1], m[2], "require") for m in re.finditer(r"^\s*(?:require\s+)?([\w./-]+\.[\w./-]+)\s+(v[\w.+-]+)", content, re.M)]
        if name == "pyproject.toml":
            items = tomllib.loads(content).get("project", {}).get("dependencies", [])
        elif name == "requirements.txt":
            items = [x.split("#")[0].strip() for x in content.split("\n")]
        else:
            return []
        found = [re.match(r"([A-Za-z0-9._-]+)\s*(?:\[[^]]*\])?\s*(.*)", x) for x in items if x and not x.startswith("-")]
        return [(m[1], m[2].strip(), "dependencies") for m in found if m]
    except (ValueError, AttributeError):
        return []


def dependencies(files: DataFrame) -> DataFrame:
    """SRC-7: (path, package, version, grp) of the dependency manifests among (path, content)."""
    def run(batches):
        for pdf in batches:
            rows = [(p, *r) for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in parse_manifest(p.rsplit("/", 1)[-1], c or "")]
            yield pd.DataFrame(rows, columns=["path", "package", "version", "grp"])

    known = files.where(F.substring_index("path", "/", -1).isin("package.json", "go.mod", "pyproject.toml", "requirements.txt"))
    return known.select("path", "content").mapInPandas(run, "path string, package string, version string, grp string")
