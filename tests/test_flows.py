from lodestar.operators import flows

SOURCE = """
def f(items):
    total = 0
    for x in items:
        if x < 0:
            break
        elif x == 0:
            continue
        total += x
    if total > 3:
        return total
    try:
        g()
    except ValueError:
        raise
    return None
"""


def test_control_flow(spark):
    rows = flows.control_flow("a.py", SOURCE, "f")
    kinds = {(r["source"].split(":")[0], r["target"].split(":")[0], r["label"]) for r in rows}
    assert {("entry", "step", ""), ("step", "loop", ""), ("loop", "branch", "enter"), ("branch", "break", "yes"), ("branch", "branch", "no"), ("branch", "continue", "yes"), ("continue", "loop", "repeat"), ("step", "loop", "repeat"), ("loop", "branch", "done"), ("break", "branch", ""), ("branch", "return", "yes"), ("branch", "try", "no"), ("try", "raise", "error"), ("raise", "exit", ""), ("return", "exit", "")} <= kinds
    files = spark.createDataFrame([("a.py", SOURCE), ("b.py", "def ("), ("c.py", None)], "path string, content string")
    assert flows.control_flows(files).count() == len(rows)
    assert flows.control_flow("a.py", SOURCE, "none") == []


def test_data_trace(spark):
    nodes = spark.createDataFrame([("g", "a", None), ("g", "b", '{"n": 1}'), ("g", "c", None), ("h", "z", None)], "graph string, node string, out string")
    edges = spark.createDataFrame([("g", "1", "a", "b", "chain"), ("g", "2", "b", "c", "chain"), ("g", "3", "c", "a", "chain"), ("g", "4", "b", "z", "branch")], "graph string, edge string, source string, target string, kind string")
    got = [tuple(r) for r in flows.data_traces(nodes, edges, "a", "7").orderBy("step").collect()]
    assert got == [("g", 1, "a", "7", "7", None), ("g", 2, "b", "7", '{"n": 1}', "to z"), ("g", 3, "c", '{"n": 1}', '{"n": 1}', None)]


def test_choose_branch():
    got = flows.choose_branch([{"cond": "n > 3"}, {"cond": "s == 'x'"}, {"cond": "q < 1"}, {"cond": "f(n)"}], {"n": 5, "s": "y"})
    assert [(g["taken"], g["why"]) for g in got] == [("yes", None), ("no", None), (None, "unknown q"), (None, "not a comparison")]
