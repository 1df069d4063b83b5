"""The query surface on one source tree or one event log: what a user asks, by name.

``Project`` indexes a tree into the symbol store and answers questions about code;
``Observations`` answers those about probe events; ``Designs`` those about documents.
Every answer is a DataFrame.
"""

from __future__ import annotations

import posixpath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.scalars import regex_complexity, size_status
from lodestar.operators import aggregates as A
from lodestar.operators import diffs as D
from lodestar.operators import filters as P
from lodestar.operators import graph as G
from lodestar.operators import joins as J
from lodestar.operators import members as M
from lodestar.operators import observe as O
from lodestar.operators import points as N
from lodestar.operators import rules as U
from lodestar.operators import search as R
from lodestar.operators import windows as W
from lodestar.sources import events as EV
from lodestar.sources import store
from lodestar.sources import tree as T

SUFFIXES = (".py", "/__init__.py", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js", "")
#: Names that calls may use without a definition in the project.
BUILTINS = "print len range str int float list dict set tuple open isinstance super sorted enumerate zip map filter min max sum any all".split()


def import_targets(path: str, name: str) -> list[str]:
    """Paths that a relative import may mean, in the order in which they are tried."""
    here = posixpath.dirname(path)
    if path.endswith(".py") and name.startswith("."):
        ups = len(name) - len(name.lstrip("."))
        for _ in range(ups - 1):
            here = posixpath.dirname(here)
        base = posixpath.join(here, name.lstrip(".").replace(".", "/")) if name.lstrip(".") else here
    elif name.startswith("."):
        base = posixpath.normpath(posixpath.join(here, name))
    else:
        return []
    return [base + s for s in SUFFIXES]


class Project:
    """The symbol store of a source tree: files, nodes, imports, import edges and calls."""

    def __init__(self, spark: SparkSession, root: str, tests: bool = False, parsers=None):
        self.spark = spark
        hashed = F.sha1(F.col("content").cast("binary"))
        self.files = store.checkpoint(T.walk(spark, root, tests=tests).withColumn("content_hash", hashed))
        rows = store.checkpoint(T.parse(self.files, parsers))
        ids = F.concat_ws("#", "path", "qualified_name")
        sym = rows.where("row = 'symbol'")
        self.nodes = sym.select(ids.alias("id"), "kind", "name", "qualified_name", F.col("path").alias("file_path"), F.col("line").alias("start_line"), F.coalesce("end_line", "line").alias("end_line"), F.col("hash").alias("sym_hash"), F.col("closure").alias("is_closure"), F.lit(None).cast("string").alias("docstring"), F.lit(None).cast("string").alias("signature"))
        self.imports = rows.where("row = 'import'").select(F.col("path").alias("file_path"), "line", F.col("name").alias("source"), "kind")
        self.errors = rows.where("row = 'error'").select("path", "name")
        self.file_edges = store.checkpoint(self._file_edges())
        self.refs = store.checkpoint(self._calls(rows.where("row = 'call'")))
        self.calls = self.refs.where("target is not null").select("source", "target", F.lit("call").alias("kind")).distinct()

    def _file_edges(self) -> DataFrame:
        """Import edges between files, with the line of the first import."""
        kinds = pa.schema([("source", pa.string()), ("line", pa.int32()), ("ordinal", pa.int32()), ("target", pa.string())])

        def run(batches):
            for batch in batches:
                rows = [{"source": p, "line": n, "ordinal": i, "target": t} for p, n, s in zip(*(x.to_pylist() for x in batch.columns), strict=True) for i, t in enumerate(import_targets(p, s))]
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

        tried = self.imports.where("kind = 'relative'").select("file_path", "line", "source").mapInArrow(run, "source string, line int, ordinal int, target string")
        real = tried.join(self.files.select(F.col("path").alias("target")), "target", "left_semi")
        # Of one import's candidates the first that is a file counts.
        first = real.groupBy("source", "line").agg(F.min_by("target", "ordinal").alias("target"))
        return first.groupBy("source", "target").agg(F.min("line").alias("line"))

    def _calls(self, calls: DataFrame) -> DataFrame:
        """Calls as references: resolved in the file first, by the last name of a chain, then over its imports."""
        named = calls.select("path", "name", "line", F.concat_ws("#", "path", F.nullif("qualified_name", F.lit(""))).alias("source"), F.substring_index("name", ".", -1).alias("tail"))
        local = self.nodes.groupBy(F.col("file_path").alias("path"), F.col("name").alias("tail")).agg(F.min("id").alias("own"))
        refs = named.join(local, ["path", "tail"], "left").drop("tail").withColumn("ref_id", F.xxhash64("source", "name", "line"))
        open_ = refs.where("own is null").select("ref_id", F.col("path").alias("file_path"), "name", F.lit("call").alias("kind")).distinct()
        imports = self.file_edges.select(F.col("source").alias("file_path"), F.col("line").alias("ordinal"), F.col("target").alias("target_file"))
        found = J.resolve_in_order(open_, imports, self.nodes, BUILTINS).select("ref_id", "target", "status")
        joined = refs.join(found, "ref_id", "left")
        return joined.select("ref_id", "path", "source", "name", "line", F.coalesce("own", "target").alias("target"), F.when(F.col("own").isNotNull(), "resolved").otherwise(F.col("status")).alias("status"))

    # -- questions about code --------------------------------------------------

    def search(self, query: str, limit: int = 20) -> DataFrame:
        return R.semantic_search(self.nodes, query, limit=limit)

    def outline(self) -> DataFrame:
        return G.function_outline(self.nodes, self.calls)

    def impact(self, changed: list[str], max_depth: int = 5, symbols: bool = False) -> DataFrame:
        """What depends on changed files (or symbols): node, depth, risk."""
        edges = self.calls if symbols else self.file_edges
        seeds = self.spark.createDataFrame([(c,) for c in changed], "node string")
        n = G.degrees(edges).select("node", F.col("dependents").alias("dep_count"))
        reach = G.bfs(edges, seeds, max_depth, "in").join(n, "node", "left").na.fill(0, ["dep_count"])
        return G.change_risk(reach, F.col("dep_count"))

    def hubs(self, top: int = 20) -> DataFrame:
        return G.hubs(self.file_edges, top)

    def closure(self, files: list[str], max_depth: int = 20, callers: bool = False) -> DataFrame:
        seeds = self.spark.createDataFrame([(f,) for f in files], "node string")
        return G.bfs(self.file_edges, seeds, max_depth, "both" if callers else "out")

    def references(self, name: str) -> DataFrame:
        """Lines that mention a name in files that define it or can reach one that does."""
        homes = self.nodes.where(F.col("name") == name).select(F.col("file_path").alias("node")).distinct()
        near = G.bfs(self.file_edges, homes, 1, "in").select(F.col("node").alias("path"))
        return R.find_references(self.files, name, near)

    def field_references(self, field: str, within: list[str] | None = None) -> DataFrame:
        """Where scripts read, set, take apart and declare a field, in the import closure of files if given."""
        return M.field_references(M.members(self.files), field, self._near(within))

    def constructions(self, path: str, type_name: str, min_hit: int = 2, within: list[str] | None = None) -> DataFrame:
        """Object literals that could be of the type that a file declares, by the keys they share."""
        return M.constructions(M.members(self.files), path, type_name, min_hit, self._near(within))

    def _near(self, within: list[str] | None) -> DataFrame | None:
        return None if within is None else self.closure(within, callers=True).select(F.col("node").alias("path"))

    def rules(self, rules: dict[str, str]) -> DataFrame:
        """Matches of patterns with holes in all files."""
        return U.match_rules(self.files, rules)

    def feature_tree(self, least: int = 5) -> DataFrame:
        """The folders that stand for features, small and pass-through ones merged into those above."""
        return M.feature_tree(self.files, least)

    def similar_names(self) -> DataFrame:
        n = self.nodes.select(F.col("file_path").alias("scope"), "name", F.col("start_line").alias("ordinal"), F.lit(1).alias("refs"))
        return R.similar_names(n)

    def integrity(self, on_disk: DataFrame) -> DataFrame:
        """References by state and files against (path, hash) of what is on disk now."""
        return A.integrity_counts(self.refs.select("status"), self.files.select("path", F.col("content_hash").alias("hash")), on_disk)

    def health(self, complexity: int = 50) -> DataFrame:
        """Score and counts: cycles, complex files, orphans, and their weights."""
        cycles = G.scc(self.file_edges).select(F.lit("cycle").alias("kind"))
        hard = self.files.where(regex_complexity(F.col("content")) > complexity).select(F.lit("complexity"))
        linked = self.file_edges.select(F.col("source").alias("path")).union(self.file_edges.select("target"))
        orphans = self.files.select("path").join(linked, "path", "left_anti").select(F.lit("orphan"))
        return A.health_score(cycles.union(hard).union(orphans), self.files)

    def sizes(self) -> DataFrame:
        n = F.size(F.split("content", "\n"))
        return self.files.select("path", n.alias("lines"), size_status(n).alias("status"))

    def layers(self, rules: list[tuple[str, str]], allowed: dict[str, list[str]]) -> DataFrame:
        return G.layer_violations(self.file_edges, G.assign_layers(self.files.select("path"), rules), allowed)

    def communities(self) -> DataFrame:
        return G.communities(self.file_edges)

    def diagnose(self, text: str, stop_words: list[str] | None = None) -> DataFrame:
        """Likely causes of a reported symptom, best first."""
        told = R.parse_symptoms(self.spark.createDataFrame([(1, text)], "id int, text string"), stop_words or []).first()
        words = [*told.symbols, *told.keywords]
        found = R.best_candidates(R.symbol_candidates(self.nodes, words))
        file, line = (told.locations[0].rsplit(":", 1) if told.locations else ("", "0"))
        at = found.join(self.nodes.select("qualified_name", F.col("file_path").alias("file"), F.col("start_line").alias("line"), "id", "name", "end_line"), ["qualified_name", "file", "line"])
        chain = G.diagnosis_chain(self.calls, self.file_edges, at.select(F.col("id").alias("node"), "score", (F.col("source") != "exact").alias("text_hit")))
        on = chain.select(F.col("node").alias("id"), (F.col("depth") == 1).alias("direct")).withColumn("on_chain", F.lit(True))
        rows = at.join(on, "id", "left").select("id", "name", "file", F.col("line").alias("start"), F.col("end_line").alias("end"), "score", F.coalesce("on_chain", F.lit(False)).alias("on_chain"), F.coalesce("direct", F.lit(False)).alias("direct"))
        return R.root_causes(rows, file, int(line))

    def compare(self, other: Project) -> DataFrame:
        """Symbols of two projects: shared, in conflict, or in one only."""
        pick = lambda p: p.nodes.select("name", "kind", F.col("sym_hash").alias("signature"))
        return J.compare_symbols(pick(self), pick(other))

    def changes(self, earlier: Project) -> DataFrame:
        """Symbols added, changed and removed since an earlier state."""
        pick = lambda p: p.nodes.select("file_path", "qualified_name", "sym_hash")
        return D.symbol_cdc(pick(earlier), pick(self))

    def observe_points(self, focus: list[str] | None = None, most: int = 20, changed: DataFrame | None = None, now_ms: int | None = None) -> DataFrame:
        """Functions worth observing, with evidence: focused files first, spread over files.

        ``changed`` (qualified_name) are symbols that changed on record; ``now_ms`` tells which
        files are hot, by default none.
        """
        none = self.spark.createDataFrame([], "qualified_name string")
        files = self.files.select("path", "content", F.unix_millis("modified_at").alias("modified_at"))
        points = N.observe_points(self.nodes, self.calls, files, none if changed is None else changed, now_ms or 1 << 62, focus_paths=focus)
        return N.recommend(points, most)


class Observations:
    """Questions about probe events in JSON-lines files."""

    def __init__(self, spark: SparkSession, paths: list[str]):
        self.events, self.skipped = EV.load_events(spark, paths)
        # Lines are numbered as they lie in their files, and stored, so that numbers stay.
        self.events = store.checkpoint(self.events.withColumn("seq", F.monotonically_increasing_id()))

    def log(self, files: list[str] | None = None, show_all: bool = False) -> tuple[DataFrame, DataFrame]:
        return P.log_pool(self.events, O.silent_error(), files, show_all)

    def profile(self) -> DataFrame:
        return A.probe_profile(self.events)

    def traces(self) -> DataFrame:
        return W.chain_budget(W.trace_sequences(self.events), F.col("events"))

    def tree(self) -> DataFrame:
        return G.call_tree(self.events)

    def judge(self, rules: dict | None = None) -> DataFrame:
        none = F.lit(None).cast("int")
        return O.judge(self.events.withColumns({"unexpected": F.lit(None).cast("array<string>"), "direct": none, "indirect": none}), rules)

    def chains(self, want: list[str]) -> DataFrame:
        return O.chain_matches(W.trace_sequences(self.events), want)


class Designs:
    """Questions about design documents: states over baseline, design and live."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def list_nodes(self, layer: str | None = None, kind: str | None = None) -> DataFrame:
        return P.list_nodes(self.nodes, layer, kind)

    def list_edges(self, layer: str | None = None) -> DataFrame:
        return P.list_edges(self.edges, layer)

    def states(self, design: Designs | None, live: Designs | None, value: str = "label") -> DataFrame:
        """Each node's state, this document being the baseline."""
        pick = lambda d: None if d is None else d.nodes.select("id", F.col(value).alias("value"))
        return D.three_way(pick(self), pick(design), pick(live))

    def diff(self, other: Designs) -> DataFrame:
        return D.keyed_diff(self.nodes, other.nodes, "id", ["label", "type"])

    def ranks(self) -> DataFrame:
        return G.longest_rank(self.edges, self.nodes.select(F.col("id").alias("node")))
