"""Graph operators (GRAPH-1 to GRAPH-21) on edge tables (source, target).

Traversals advance a frontier by joins; each round's table is stored by ``keep``, which
cuts the lineage and survives lost executors.  Algorithms whose result depends on the
order of visits run inside one task for each graph of bounded size (a file's), never on
the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scalars import file_of, risk_by_degree
from lodestar.operators.components import connected_components

Keep = Callable[[DataFrame, str], DataFrame]


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """The default ``keep``: a reliable checkpoint in the shared folder."""
    from lodestar.sources.store import checkpoint

    return checkpoint(df)


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as (a, b) steps: out, in or both ways."""
    out = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    back = edges.select(F.col("target").alias("a"), F.col("source").alias("b"))
    return {"out": out, "in": back, "both": out.union(back)}[direction].distinct()


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, direction: str = "out", keep: Keep = checkpointed) -> DataFrame:
    """GRAPH-1: (node, depth, parent) within ``max_depth`` steps of the seeds (node).

    The least depth is kept; of parents at it the least.  Seeds have depth 0 and no
    parent.  Stops early when a round finds nothing.
    """
    steps = directed(edges, direction)
    seen = keep(seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(dict(seeds.dtypes)["node"]).alias("parent")), "bfs0")
    frontier = seen
    for d in range(1, max_depth + 1):
        new = frontier.select(F.col("node").alias("a")).join(steps, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        new = keep(new.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("depth"), "parent"), f"bfs{d}")
        if new.isEmpty():
            break
        seen, frontier = seen.union(new), new
    return seen


def symbol_impact(calls: DataFrame, imports: DataFrame, changes: DataFrame, nodes: DataFrame, max_depth: int = 5, direction: str = "in", keep: Keep = checkpointed) -> DataFrame:
    """GRAPH-2: (node, depth, via) that a diff may affect.

    changes (file, symbol, state): removed affects the whole file, changed the symbol,
    added nothing, norm or const the files importing it.
    """
    whole = changes.where("state = 'removed'").select("file").distinct().join(nodes, F.col("file") == F.col("file_path")).select(F.col("id").alias("node"))
    named = changes.where("state = 'changed'").select(F.concat_ws("#", "file", "symbol").alias("node"))
    first = bfs(calls, whole.union(named), max_depth, direction, lambda df, n: keep(df, f"call-{n}"))
    files = changes.where("state in ('norm', 'const')").select(F.col("file").alias("node"))
    second = bfs(imports, files, max_depth, direction, lambda df, n: keep(df, f"import-{n}"))
    return first.select("node", "depth", F.lit("call").alias("via")).union(second.select("node", "depth", F.lit("import")))


def change_risk(impact: DataFrame, dep_count: Column) -> DataFrame:
    """GRAPH-3: high with 8 dependents, or 3 within depth 2; medium within depth 3; else low."""
    risk = F.when((dep_count >= 8) | ((F.col("depth") <= 2) & (dep_count >= 3)), "high").when(F.col("depth") <= 3, "medium").otherwise("low")
    order = F.when(F.col("risk") == "high", 0).when(F.col("risk") == "medium", 1).otherwise(2)
    return impact.withColumns({"risk": risk}).withColumn("risk_order", order)


def diagnosis_chain(calls: DataFrame, imports: DataFrame, seeds: DataFrame, keep: Keep = checkpointed) -> DataFrame:
    """GRAPH-4: nodes within 3 calls either way of at most 5 seeds (node, score, text_hit).

    Seeds not from text come first.  If no call leads on, the files one import away.
    """
    top = seeds.orderBy("text_hit", F.desc("score"), "node").limit(5).select("node")
    found = bfs(calls, top, 3, "both", keep)
    if not found.where("depth > 0").isEmpty():
        return found
    files = top.select(file_of(F.col("node")).alias("node")).distinct()
    return bfs(imports, files, 1, "both", lambda df, n: keep(df, f"files-{n}"))


def degrees(edges: DataFrame) -> DataFrame:
    """GRAPH-5: per node distinct dependents and dependencies, and risk by dependents."""
    ins = edges.groupBy(F.col("target").alias("node")).agg(F.count_distinct("source").alias("dependents"))
    outs = edges.groupBy(F.col("source").alias("node")).agg(F.count_distinct("target").alias("dependencies"))
    both = ins.join(outs, "node", "full_outer").select("node", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("dependents", "dependencies")])
    return both.withColumn("risk", risk_by_degree(F.col("dependents")))


def hubs(edges: DataFrame, n: int) -> DataFrame:
    """TOPK-1: the nodes with most dependents, then most dependencies, then by name."""
    return degrees(edges).orderBy(F.desc("dependents"), F.desc("dependencies"), "node").limit(n)


#: Graphs of so many edges at most are finished in one task; larger ones by rounds.
LOCAL_EDGES = 500_000


def _strong(edges: list[tuple]) -> dict:
    """The least node of each node's strongly connected set, in memory."""
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    number, low, held, stack, found = {}, {}, set(), [], {}
    for root in out:
        if root in number:
            continue
        work = [(root, iter(out[root]))]
        number[root] = low[root] = len(number)
        stack.append(root)
        held.add(root)
        while work:
            at, rest = work[-1]
            for to in rest:
                if to not in number:
                    number[to] = low[to] = len(number)
                    stack.append(to)
                    held.add(to)
                    work.append((to, iter(out[to])))
                    break
                if to in held:
                    low[at] = min(low[at], number[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[at])
                if low[at] == number[at]:
                    members = []
                    while not members or members[-1] != at:
                        members.append(stack.pop())
                    held.difference_update(members)
                    found |= dict.fromkeys(members, min(members))
    return found


def _strong_frame(parts):
    rows = [r for part in parts for r in part.itertuples(index=False, name=None)]
    yield pd.DataFrame(list(_strong(rows).items()), columns=["node", "scc"])


def scc(edges: DataFrame, keep: Keep = checkpointed, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """GRAPH-6: (node, scc, size) of strongly connected sets that hold a cycle.

    Nodes without an edge in or out are trimmed round by round.  Then every node takes
    the least colour that reaches it; a colour's root and all in its colour that reach
    the root are one set and leave.  Each loop ends by itself, as edges shrink and colours
    fall.  As soon as ``local_edges`` edges or fewer are left, one task ends the work in
    memory.  scc is the least node of the set.
    """
    e = keep(edges.select("source", "target").where("source is not null and target is not null").distinct(), "scc-edges")
    loops = e.where("source = target").select(F.col("source").alias("node"))
    e = e.where("source <> target")
    kind = e.schema["source"].dataType.simpleString()
    done, step, count = None, 0, e.count()
    while count:
        if count <= local_edges:
            part = keep(e.repartition(1).mapInPandas(_strong_frame, f"node {kind}, scc {kind}"), f"scc-l{step}")
            done = part if done is None else done.union(part)
            break
        while True:  # trimming
            step += 1
            ends = e.select(F.col("source").alias("n")).intersect(e.select(F.col("target").alias("n")))
            e = keep(e.join(ends.toDF("source"), "source", "left_semi").join(ends.toDF("target"), "target", "left_semi").select("source", "target"), f"scc-{step}")
            left, count = count, e.count()
            if count == left or count <= local_edges:
                break
        if count <= local_edges:
            continue
        color = keep(e.select(F.col("source").alias("node")).union(e.select("target")).distinct().withColumn("color", F.col("node")), f"scc-c{step}")
        while True:  # the least colour flows along the edges
            step += 1
            came = e.join(color, F.col("source") == F.col("node")).groupBy(F.col("target").alias("node")).agg(F.min("color").alias("new"))
            color = keep(color.join(came, "node", "left").select("node", F.least("color", F.coalesce("new", "color")).alias("color"), F.coalesce(F.col("new") < F.col("color"), F.lit(False)).alias("moved")), f"scc-{step}")
            moved = not color.where("moved").isEmpty()
            color = color.drop("moved")
            if not moved:
                break
        inside = e.join(color.toDF("source", "cs"), "source").join(color.toDF("target", "ct"), "target").where("cs = ct").select("source", "target")
        found = bfs(inside, color.where("node = color").select("node"), count, "in", lambda df, n, s=step: keep(df, f"scc-{s}-{n}"))
        part = keep(color.join(found.select("node"), "node", "left_semi").select("node", F.col("color").alias("scc")), f"scc-p{step}")
        done = part if done is None else done.union(part)
        gone = part.select("node")
        e = keep(e.join(gone.toDF("source"), "source", "left_anti").join(gone.toDF("target"), "target", "left_anti").select("source", "target"), f"scc-e{step}")
        count = e.count()
    empty = loops.select("node", F.col("node").alias("scc"))
    sets = empty.limit(0) if done is None else done
    size = sets.groupBy("scc").agg(F.count("*").alias("size"))
    big = sets.join(size, "scc").where("size > 1").select("node", "scc", "size")
    single = empty.join(big.select("node"), "node", "left_anti").select("node", "scc", F.lit(1).cast("long").alias("size"))
    return big.union(single)


def communities(edges: DataFrame, keep: Keep = checkpointed) -> DataFrame:
    """GRAPH-7: components with members, internal edges and cohesion (1 without edges)."""
    e = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    parts = keep(connected_components(e, keep), "parts")
    own = lambda c, name: parts.select(F.col("node").alias(c), F.col("component").alias(name))
    met = e.join(own("a", "ca"), "a").join(own("b", "cb"), "b")
    inner = met.where("ca = cb").groupBy(F.col("ca").alias("component")).agg(F.count("*").alias("internal"))
    outer = met.where("ca <> cb").select(F.explode(F.array("ca", "cb")).alias("component")).groupBy("component").agg(F.count("*").alias("external"))
    size = parts.groupBy("component").agg(F.count("*").alias("members"))
    out = size.join(inner, "component", "left").join(outer, "component", "left").na.fill(0, ["internal", "external"])
    total = F.col("internal") + F.col("external")
    return out.withColumn("cohesion", F.when(total == 0, 1.0).otherwise(F.round(F.col("internal") / total, 3)))


def label_propagation(edges: DataFrame, nodes: DataFrame, rounds: int = 12) -> DataFrame:
    """GRAPH-8: anchored, asynchronous label propagation inside each graph.

    edges (graph, source, target, weight), nodes (graph, node, ordinal, anchor).  Nodes are
    visited by ordinal; each takes the label of greatest weight among its neighbours, a
    tie keeps its own; anchored nodes keep theirs.  One graph is one task.
    """
    def run(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        near: dict = defaultdict(lambda: defaultdict(float))
        for s, t, w in zip(e["source"], e["target"], e["weight"], strict=True):
            if s != t:
                near[s][t] += w
                near[t][s] += w
        n = n.sort_values("ordinal")
        label = {x: (a if isinstance(a, str) else x) for x, a in zip(n["node"], n["anchor"], strict=True)}
        fixed = {x for x, a in zip(n["node"], n["anchor"], strict=True) if isinstance(a, str)}
        for _ in range(rounds):
            moved = False
            for x in n["node"]:
                if x in fixed or not near[x]:
                    continue
                votes: dict = defaultdict(float)
                for y, w in near[x].items():
                    votes[label.get(y, y)] += w
                top = max(votes.values())
                if votes.get(label[x], 0.0) < top:
                    label[x] = min(k for k, v in votes.items() if v == top)
                    moved = True
            if not moved:
                break
        return pd.DataFrame({"graph": [key[0]] * len(n), "node": list(n["node"]), "label": [label[x] for x in n["node"]]})

    return nodes.groupBy("graph").cogroup(edges.groupBy("graph")).applyInPandas(run, "graph string, node string, label string")


def louvain(edges: DataFrame, eps: float = 1e-7, sweeps: int = 100, levels: int = 20) -> DataFrame:
    """GRAPH-9: Louvain communities of each graph (graph, source, target, weight), nodes in order of name.

    A move must gain more than ``eps`` in modularity; of equal gains the first in order.
    community is the least node's name.  One graph (a file's) is one task.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["source"]) | set(pdf["target"]))
        index = {x: i for i, x in enumerate(names)}
        adj: list[dict[int, float]] = [defaultdict(float) for _ in names]
        for s, t, w in zip(pdf["source"], pdf["target"], pdf["weight"], strict=True):
            a, b = index[s], index[t]
            adj[a][b] += w
            adj[b][a] += w  # a loop counts twice in its degree
        member = list(range(len(names)))
        for _ in range(levels):
            n = len(adj)
            degree = [sum(x.values()) for x in adj]
            m2 = sum(degree) or 1.0
            comm, total, any_move = list(range(n)), degree[:], False
            for _ in range(sweeps):
                moved = False
                for v in range(n):
                    own, links = comm[v], defaultdict(float)
                    for u, w in adj[v].items():
                        if u != v:
                            links[comm[u]] += w
                    total[own] -= degree[v]
                    best, gain = own, links[own] - total[own] * degree[v] / m2
                    for c in sorted(links):
                        g = links[c] - total[c] * degree[v] / m2
                        if g > gain + eps:
                            best, gain = c, g
                    total[best] += degree[v]
                    if best != own:
                        comm[v], moved, any_move = best, True, True
                if not moved:
                    break
            if not any_move:
                break
            new = {c: i for i, c in enumerate(dict.fromkeys(comm))}
            member = [new[comm[x]] for x in member]
            nxt: list[dict[int, float]] = [defaultdict(float) for _ in new]
            for v in range(n):
                for u, w in adj[v].items():
                    nxt[new[comm[v]]][new[comm[u]]] += w
            adj = nxt
        least: dict[int, str] = {}
        for x, c in zip(names, member, strict=True):
            least.setdefault(c, x)
        return pd.DataFrame({"graph": [pdf["graph"].iloc[0]] * len(names), "node": names, "community": [least[c] for c in member]})

    return edges.select("graph", "source", "target", F.col("weight").cast("double").alias("weight")).groupBy("graph").applyInPandas(run, "graph string, node string, community string")


def reference_weights(declarations: DataFrame) -> DataFrame:
    """GRAPH-10: per file, how often each declaration's body names another one.

    declarations (file, name, body); names of 3 characters and more.  Bodies are cut into
    words once and meet names by equality, so no pairs of declarations are made.
    """
    words = declarations.select("file", F.col("name").alias("source"), F.explode(F.regexp_extract_all("body", F.lit(r"(\w{3,})"), F.lit(1))).alias("target"))
    known = declarations.where(F.length("name") >= 3).select("file", F.col("name").alias("target")).distinct()
    return words.where("source <> target").groupBy("file", "source", "target").agg(F.count("*").alias("weight")).join(known, ["file", "target"], "left_semi")


def symmetrize(edges: DataFrame) -> DataFrame:
    """GRAPH-10: undirected weights, the lesser name first."""
    return edges.groupBy("file", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("weight").alias("weight"))


def community_links(edges: DataFrame, members: DataFrame, most_cross: float = 0.4, least_size: int = 3) -> DataFrame:
    """GRAPH-11: per community its size, inner and crossing weight, and if it may be split.

    A group may be split off if it has ``least_size`` members and at most ``most_cross`` of
    its weight crosses.
    """
    own = lambda c, n: members.select(F.col("node").alias(c), F.col("community").alias(n))
    met = edges.join(own("source", "cs"), "source").join(own("target", "ct"), "target")
    ends = met.select(F.explode(F.array_distinct(F.array("cs", "ct"))).alias("community"), (F.col("cs") == F.col("ct")).alias("inner"), "weight")
    sums = ends.groupBy("community").agg(F.sum(F.when(F.col("inner"), F.col("weight")).otherwise(0)).alias("inside"), F.sum(F.when(~F.col("inner"), F.col("weight")).otherwise(0)).alias("crossing"))
    out = members.groupBy("community").agg(F.count("*").alias("size")).join(sums, "community", "left").na.fill(0, ["inside", "crossing"])
    share = F.coalesce(F.col("crossing") / F.nullif(F.col("inside") + F.col("crossing"), F.lit(0)), F.lit(0.0))
    return out.withColumn("splittable", (F.col("size") >= least_size) & (share <= most_cross))


def longest_rank(edges: DataFrame, nodes: DataFrame, keep: Keep = checkpointed) -> DataFrame:
    """GRAPH-12: (node, rank): the longest path from a node without edges in.

    Nodes are peeled by rounds; those left in or behind cycles get the greatest rank + 1.
    """
    e = edges.select("source", "target").where("source <> target").distinct()
    left, out, r = nodes.select("node").distinct(), None, 0
    while True:
        e = keep(e, f"rank-e{r}")
        ready = keep(left.join(e.select(F.col("target").alias("node")), "node", "left_anti").withColumn("rank", F.lit(r)), f"rank-{r}")
        if ready.isEmpty():
            break
        out = ready if out is None else out.union(ready)
        gone = ready.select("node")
        left = keep(left.join(gone, "node", "left_anti"), f"rank-l{r}")
        e = e.join(gone.toDF("source"), "source", "left_anti")
        r += 1
    rest = left.select("node", F.lit(r).alias("rank"))
    return rest if out is None else out.union(rest)


def function_outline(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """GRAPH-13: per node what it calls, what calls it, and if it calls itself."""
    outs = calls.groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_set("target")).alias("calls"), F.bool_or(F.col("source") == F.col("target")).alias("recursive"))
    ins = calls.groupBy(F.col("target").alias("id")).agg(F.sort_array(F.collect_set("source")).alias("called_by"))
    out = nodes.select("id").join(outs, "id", "left").join(ins, "id", "left")
    none = F.array().cast("array<string>")
    return out.select("id", F.coalesce("calls", none).alias("calls"), F.coalesce("called_by", none).alias("called_by"), F.coalesce("recursive", F.lit(False)).alias("recursive"))


def assign_layers(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """GRAPH-14: a path's layer: the first rule (layer, word) that a segment equals, also in the plural."""
    parts = F.split(F.lower("path"), "/")
    hit = F.lit(None).cast("string")
    for layer, word in reversed(rules):
        hit = F.when(F.array_contains(parts, word) | F.array_contains(parts, word + "s"), layer).otherwise(hit)
    return files.withColumn("layer", hit)


def layer_violations(edges: DataFrame, layers: DataFrame, allowed: dict[str, list[str]], exempt: str = "core") -> DataFrame:
    """GRAPH-14: edges into a layer that the source's layer may not use."""
    own = lambda c: layers.select(F.col("path").alias(c), F.col("layer").alias(f"{c}_layer"))
    met = edges.join(own("source"), "source").join(own("target"), "target").where("source_layer <> target_layer")
    ok = F.col("target_layer") == exempt
    for layer, may in allowed.items():
        ok = ok | ((F.col("source_layer") == layer) & F.col("target_layer").isin(may))
    return met.where(~ok)


def call_tree(events: DataFrame) -> DataFrame:
    """GRAPH-15: frames of traces from .enter and .exit events.

    events (probe, time, trace_id, frame_id, parent_id).  Per frame: name, start, end,
    what half is missing, and role: the first frame without a parent is the root, frames
    whose parent is unknown are orphans.
    """
    entered, left = F.endswith("probe", F.lit(".enter")), F.endswith("probe", F.lit(".exit"))
    frames = events.groupBy("trace_id", "frame_id").agg(
        F.min(F.regexp_replace("probe", r"\.(enter|exit|catch)$", "")).alias("name"),
        F.min(F.when(entered, F.col("time"))).alias("start"),
        F.max(F.when(left, F.col("time"))).alias("end"),
        F.max("parent_id").alias("parent_id"),
    )
    known = frames.select("trace_id", F.col("frame_id").alias("parent_id"), F.lit(True).alias("has_parent"))
    by = Window.partitionBy("trace_id").orderBy(F.col("parent_id").isNotNull() & (F.col("parent_id") != 0), "start", "frame_id")
    out = frames.join(known, ["trace_id", "parent_id"], "left").withColumn("r", F.row_number().over(by))
    top = F.col("parent_id").isNull() | (F.col("parent_id") == 0)
    role = F.when(top & (F.col("r") == 1), "root").when(F.col("has_parent"), "child").otherwise("orphan")
    return out.select("trace_id", "frame_id", "parent_id", "name", "start", "end", F.col("start").isNull().alias("missing_in"), F.col("end").isNull().alias("missing_out"), role.alias("role"))


def entry_walks(calls: DataFrame, nodes: DataFrame, most: int = 24) -> DataFrame:
    """GRAPH-16: per file (file, step, node): the entry and then, again and again, the first unseen local callee.

    nodes (file, node, ordinal, hint), calls (file, source, target, ordinal).  The entry has
    the most of 20 if not called locally + 5 if hinted + min(calls, 10), the first on a tie.
    """
    def run(key, n: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        n, c = n.sort_values("ordinal"), c.sort_values("ordinal")
        local, out = set(n["node"]), defaultdict(list)
        for s, t in zip(c["source"], c["target"], strict=True):
            out[s].append(t)
        called = {t for s, t in zip(c["source"], c["target"], strict=True) if s != t}
        score = [20 * (x not in called) + 5 * bool(h) + min(len(out[x]), 10) for x, h in zip(n["node"], n["hint"], strict=True)]
        at = n["node"].iloc[max(range(len(score)), key=lambda i: (score[i], -i))] if len(n) else None
        path: list[str] = []
        while at is not None and len(path) < most:
            path.append(at)
            at = next((t for t in out[at] if t in local and t not in path), None)
        return pd.DataFrame({"file": [key[0]] * len(path), "step": range(1, len(path) + 1), "node": path})

    return nodes.groupBy("file").cogroup(calls.groupBy("file")).applyInPandas(run, "file string, step int, node string")


def dead_dependencies(imports: DataFrame, edges: DataFrame, entries: DataFrame, packages: DataFrame, max_depth: int = 20, keep: Keep = checkpointed) -> DataFrame:
    """GRAPH-17: packages that no file reachable from the entries imports."""
    reached = bfs(edges, entries, max_depth, "out", keep)
    used = imports.join(reached.select(F.col("node").alias("file_path")), "file_path", "left_semi").select(F.col("source").alias("package")).distinct()
    return packages.join(used, "package", "left_anti")


def guided_tour(nodes: DataFrame, ranks: DataFrame) -> DataFrame:
    """GRAPH-20: nodes in order of rank, most dependents first, with their place."""
    joined = nodes.join(ranks, "node")
    by = Window.partitionBy("rank").orderBy(F.desc("dependents"), "node")
    return joined.withColumn("place", F.row_number().over(by))


def structure_gaps(files: DataFrame, domains: DataFrame, allowed: list[str], flat: list[str]) -> DataFrame:
    """GRAPH-21: (kind, path): domains without files are missing; loose files beside domains
    misplaced, or unlisted if ``allowed``; folders in ``flat`` ones unlisted.

    domains (parent, domain): folders parent/domain; files (path).
    """
    parts = files.select("path", F.regexp_extract("path", "^(.*)/([^/]+)$", 1).alias("dir"), F.substring_index("path", "/", -1).alias("base"))
    exploded = parts.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("dir", "/")), F.lit(1))), lambda n: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), n), "/"))).alias("folder")).distinct()
    full = domains.select(F.concat_ws("/", "parent", "domain").alias("folder"))
    missing = full.join(exploded.select("folder").distinct(), "folder", "left_anti").select(F.lit("missing").alias("kind"), F.col("folder").alias("path"))
    loose = parts.join(domains.select(F.col("parent").alias("dir")).distinct(), "dir", "left_semi").where(~F.col("base").rlike(r"^index\.") & ~F.col("dir").isin(flat))
    misplaced = loose.select(F.when(F.col("path").isin(allowed), "unlisted").otherwise("misplaced").alias("kind"), "path")
    under = exploded.select("folder").distinct().withColumn("up", F.regexp_extract("folder", "^(.*)/[^/]+$", 1)).where(F.col("up").isin(flat)).join(full, "folder", "left_anti")
    return missing.union(misplaced).union(under.select(F.lit("unlisted"), F.col("folder")))


def demand_tile(edges: DataFrame, seeds: DataFrame, max_depth: int, max_files: int, keep: Keep = checkpointed) -> tuple[DataFrame, str]:
    """STR-6: files to index around the seeds, and why the walk stopped.

    Breadth first, by name within a depth, until ``max_files`` are taken ("files"), the
    depth is spent with files left beyond it ("depth"), or nothing is left ("complete").
    """
    found = keep(bfs(edges, seeds, max_depth + 1, "out", keep).select("node", "depth"), "tile")
    within = found.where(F.col("depth") <= max_depth)
    counts = {bool(r.inside): r["count"] for r in found.groupBy((F.col("depth") <= max_depth).alias("inside")).count().collect()}
    if counts.get(True, 0) > max_files:
        return within.orderBy("depth", "node").limit(max_files), "files"
    return within, "depth" if counts.get(False) else "complete"
