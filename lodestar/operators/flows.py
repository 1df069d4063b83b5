"""Control flow of functions and data traces along chains (GRAPH-18, GRAPH-19)."""

from __future__ import annotations

import ast
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOW = "path string, function string, source string, target string, label string, kind string"


class _Flow:
    """Edges of one function's statements; a block is entered by ends (node, label)."""

    def __init__(self, max_depth: int):
        self.edges: list[tuple[str, str, str, str]] = []
        self.max_depth, self.n, self.loops = max_depth, 0, []

    def node(self, kind: str, stmt: ast.stmt) -> str:
        self.n += 1
        return f"{kind}:{stmt.lineno}:{self.n}"

    def link(self, ends: list[tuple[str, str]], to: str, kind: str) -> None:
        self.edges += [(a, to, label, kind) for a, label in ends]

    def block(self, body: list[ast.stmt], ends: list[tuple[str, str]], depth: int) -> list[tuple[str, str]]:
        for s in body:
            if not ends:
                break  # what follows a return or break is never reached
            ends = self.statement(s, ends, depth)
        return ends

    def statement(self, s: ast.stmt, ends: list[tuple[str, str]], depth: int) -> list[tuple[str, str]]:
        deep = depth >= self.max_depth
        if isinstance(s, ast.If) and not deep:
            at = self.node("branch", s)
            self.link(ends, at, "branch")
            return self.block(s.body, [(at, "yes")], depth + 1) + (self.block(s.orelse, [(at, "no")], depth + 1) if s.orelse else [(at, "no")])
        if isinstance(s, ast.For | ast.AsyncFor | ast.While) and not deep:
            at = self.node("loop", s)
            self.link(ends, at, "loop")
            self.loops.append((at, []))
            back = self.block(s.body, [(at, "enter")], depth + 1)
            self.link([(a, "repeat") for a, _ in back], at, "loop")
            _, breaks = self.loops.pop()
            return self.block(s.orelse, [(at, "done")], depth + 1) + breaks if s.orelse else [(at, "done"), *breaks]
        if isinstance(s, ast.Try) and not deep:
            at = self.node("try", s)
            self.link(ends, at, "try")
            out = self.block(s.body + s.orelse, [(at, "")], depth + 1)
            for h in s.handlers:
                out = out + self.block(h.body, [(at, "error")], depth + 1)
            return self.block(s.finalbody, out, depth + 1)
        if isinstance(s, ast.With | ast.AsyncWith) and not deep:
            at = self.node("with", s)
            self.link(ends, at, "with")
            return self.block(s.body, [(at, "")], depth + 1)
        if isinstance(s, ast.Return | ast.Raise):
            at = self.node("return" if isinstance(s, ast.Return) else "raise", s)
            self.link(ends, at, "end")
            self.edges.append((at, "exit", "", "exit"))
            return []
        if isinstance(s, ast.Break | ast.Continue) and self.loops:
            at = self.node(type(s).__name__.lower(), s)
            self.link(ends, at, "jump")
            if isinstance(s, ast.Break):
                self.loops[-1][1].append((at, ""))
            else:
                self.edges.append((at, self.loops[-1][0], "repeat", "loop"))
            return []
        at = self.node("step", s)
        self.link(ends, at, "step")
        return [(at, "")]


def control_flow(path: str, content: str, function: str | None = None, max_depth: int = 3) -> list[dict]:
    """GRAPH-18: edges of the control flow of Python functions, all or those of one name.

    Nodes are kind:line:number, with entry and exit.  Blocks nested deeper than
    ``max_depth`` are one step.  Source that does not parse has none.
    """
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return []
    rows = []
    for f in ast.walk(tree):
        if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef) and function in (None, f.name):
            flow = _Flow(max_depth)
            flow.link(flow.block(f.body, [("entry", "")], 0), "exit", "exit")
            rows += [{"path": path, "function": f.name, "source": a, "target": b, "label": x, "kind": k} for a, b, x, k in flow.edges]
    return rows


def control_flows(files: DataFrame, function: str | None = None, max_depth: int = 3) -> DataFrame:
    """GRAPH-18 over files (path, content)."""
    kinds = pa.schema([(c.split()[0], pa.string()) for c in FLOW.split(", ")])

    def run(batches):
        for batch in batches:
            rows = [r for p, c in zip(*(x.to_pylist() for x in batch.columns), strict=True) for r in control_flow(p, c or "", function, max_depth)]
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select("path", "content").mapInArrow(run, FLOW)


def data_traces(nodes: DataFrame, edges: DataFrame, entry: str, value: str, most: int = 200) -> DataFrame:
    """GRAPH-19: (graph, step, node, in_value, out_value, note): a value passed along each graph's chain.

    nodes (graph, node, out): ``out`` is the JSON that a node emits, null passes its input
    on.  edges (graph, edge, source, target, kind): chain edges are followed, the first by
    edge name, until a node repeats; branch edges add no step but a note.  One graph is one task.
    """
    def run(batches):
        for batch in batches:
            rows = []
            for graph, n, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                outs, chain, jumps = {x["node"]: x["out"] for x in n}, {}, {}
                for x in e or ():  # by edge name
                    if x["kind"] == "chain":
                        chain.setdefault(x["source"], x["target"])
                    elif x["kind"] == "branch":
                        jumps.setdefault(x["source"], []).append(x["target"])
                at, held, seen = entry, value, set()
                while at in outs and at not in seen and len(seen) < most:
                    seen.add(at)
                    given = held if outs[at] is None else outs[at]
                    note = "to " + ", ".join(sorted(jumps[at])) if at in jumps else None
                    rows.append((graph, len(seen), at, held, given, note))
                    at, held = chain.get(at), given
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int32(), *[pa.string()] * 4], strict=True)], ["graph", "step", "node", "in_value", "out_value", "note"])

    n = nodes.groupBy("graph").agg(F.collect_list(F.struct("node", "out")).alias("n"))
    e = edges.groupBy("graph").agg(F.sort_array(F.collect_list(F.struct("edge", "source", "target", "kind"))).alias("e"))
    return n.join(e, "graph", "left").select("graph", "n", "e").mapInArrow(run, "graph string, step int, node string, in_value string, out_value string, note string")


def choose_branch(judgements: list[dict], scope: dict) -> list[dict]:
    """GRAPH-19: each judgement (cond, branches) with the branch that its condition takes.

    Conditions are comparisons of a name of the scope with a constant; an unknown name or
    other syntax leaves the choice open and says why.
    """
    import operator
    import re

    ops = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
    out = []
    for j in judgements:
        m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*(==|!=|<=|>=|<|>)\s*(.+?)\s*", j["cond"])
        taken, why = None, None
        if not m:
            why = "not a comparison"
        elif m[1] not in scope:
            why = f"unknown {m[1]}"
        else:
            try:
                taken = "yes" if ops[m[2]](scope[m[1]], json.loads(m[3].replace("'", '"'))) else "no"
            except (ValueError, TypeError):
                why = "not comparable"
        out.append({**j, "taken": taken, "why": why})
    return out
