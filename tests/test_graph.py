"""Closures on hand graphs and random ones, registries, persistence, command line."""

import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from symreach import cli
from symreach.functions.names import path_glob_regex
from symreach.graph import SymbolGraph, read_meta
from symreach.operators import closure, filters
from symreach.registry import FlagRegistry, TopicRegistry
from symreach.streaming.incremental import follow, full_rebuild_needed

EDGES = "src long, dst long, flags int"


def naive(edges, seeds, skip=0):
    seen, work = set(seeds), list(seeds)
    while work:
        x = work.pop()
        for a, b, f in edges:
            if a == x and not f & skip and b not in seen:
                seen.add(b)
                work.append(b)
    return seen


def run(spark, edges, seeds, **how):
    e = spark.createDataFrame(edges, EDGES)
    return {r[0] for r in closure.reach(e, spark.createDataFrame([(s,) for s in seeds], "node_id long"), **how).collect()}


@pytest.mark.parametrize("local", [0, 1000])
@pytest.mark.parametrize(
    "edges, seeds, how, want",
    [
        ([(0, 1, 0), (1, 2, 0), (0, 3, 0)], [0], {}, {0, 1, 2, 3}),
        ([(0, 1, 0), (1, 2, 0), (3, 2, 0)], [2], {"reverse": True}, {0, 1, 2, 3}),
        ([(0, 1, 1), (0, 2, 0)], [0], {"skip": 1}, {0, 2}),
        ([(0, 1, 3)], [0], {"skip": 2}, {0}),
        ([(0, 1, 3)], [0], {"skip": 4}, {0, 1}),
        ([(0, 1, 0), (1, 2, 0), (2, 0, 0)], [1], {}, {0, 1, 2}),
        ([(0, 1, 0)], [], {}, set()),
        ([(0, 1, 0), (2, 3, 0)], [0, 2], {}, {0, 1, 2, 3}),
    ],
)
def test_hand_graphs(spark, edges, seeds, how, want, local):
    assert run(spark, edges, seeds, local_edges=local, **how) == want


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_both_ways(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(30), r.randrange(30), r.randrange(3)) for _ in range(40)]
    want = naive(edges, [0, 5], 1)
    assert run(spark, edges, [0, 5], skip=1) == want == run(spark, edges, [0, 5], skip=1, local_edges=0)


def test_registry_rules():
    r = FlagRegistry()
    assert r.default_seed_mask() == 50
    assert [r.nodes.declare("a/x"), r.nodes.declare("a/y", True, True), r.nodes.declare("a/x"), r.edges.declare("a/e")] == [256, 512, 256, 8]
    assert r.default_seed_mask() == 562
    for bad in (lambda: r.nodes.declare("a/x", True), lambda: r.nodes.declare("engine/q"), lambda: r.nodes.declare("plain")):
        with pytest.raises(ValueError):
            bad()
    for i in range(4):
        r.edges.declare(f"a/e{i}")
    with pytest.raises(ValueError):
        r.edges.declare("a/last")
    assert FlagRegistry.from_rows(r.to_rows()).default_seed_mask() == 562
    t = TopicRegistry()
    assert [t.declare("a"), t.declare("b"), t.declare("a")] == [0, 1, 0]


def small(spark):
    nodes = [(i, f"m.n{i}", k, "/w/m.py", i + 1, 0, i + 1, 3, f) for i, (k, f) in enumerate([("module", 0), ("function", 2), ("function", 0), ("class", 0), ("function", 256)])]
    n = spark.createDataFrame(nodes, "node_id long, fqname string, kind string, path string, start_line int, start_column int, end_line int, end_column int, flags long").withColumn("import", F.lit(None).cast("struct<module:string,decl:string,star:boolean>"))
    r = FlagRegistry()
    r.nodes.declare("test/testcase", True, True, "")
    return SymbolGraph(n, spark.createDataFrame([(1, 2, 1), (4, 3, 0), (1, 0, 0)], EDGES), r)


def ids(df):
    return {r["node_id"] for r in df.collect()}


def test_differences(spark):
    g = small(spark)
    assert ids(g.kept_alive_by_dead_branches()) == {2} and ids(g.test_only()) == {3, 4} and ids(g.dead_tests()) == {3, 4}
    assert ids(g.dead(2)) == {3, 4} and ids(g.dead_all(2)) == {3, 4} and ids(g.direct_predecessors(2)) == {1}
    with pytest.raises(IndexError):
        g.descendants(99)


def test_write_and_read(spark, tmp_path):
    g = small(spark)
    path = str(tmp_path / "graph")
    g.write(path, {"k": "v"})
    back = SymbolGraph.read(spark, path)
    meta = read_meta(spark, path)
    assert (meta["node_count"], meta["edge_count"], meta["file_count"], meta["line_count"], meta["user_meta"]) == (5, 3, 1, 5, {"k": "v"})
    assert ids(back.test_only()) == {3, 4} and back.registry.default_seed_mask() == 306


def test_errors_come_at_once(spark):
    g = small(spark)
    with pytest.raises(ValueError):
        filters.where(g.nodes, kinds=["thing"])
    with pytest.raises(ValueError):
        filters.where(g.nodes, path_regex="(")
    with pytest.raises(IndexError):
        filters.nodes_at(g.nodes, [1, 77])


def test_path_globs(spark):
    d = spark.createDataFrame([("/w/a/b.py",), ("/w/a/x/b.py",), ("b.py",)], "p string")
    hits = lambda g: {r[0] for r in d.where(F.col("p").rlike(path_glob_regex(g))).collect()}
    assert hits("a/*.py") == {"/w/a/b.py"} and hits("b.py") == {"/w/a/b.py", "/w/a/x/b.py", "b.py"} and hits("/w/*/[a-c].py") == {"/w/a/b.py"}


def test_change_events_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/e.json").write_text('{"kind": "changed", "path": "a.py"}\n{"kind": "created", "path": "b.py"}\n')
    seen = []
    known = spark.createDataFrame([("a.py",)], "path string")
    q = follow(spark, str(tmp_path / "in"), "kind string, path string", lambda e, n: seen.append((e.count(), full_rebuild_needed(e, known))), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert seen == [(2, True)]


def test_command_line(spark, tmp_path, capsys):
    root = tmp_path / "src"
    root.mkdir()
    (root / "app.py").write_text("import lib\nfrom lib import a, b\n\n\ndef main():\n    a()\n\n\ndef gone():\n    b()\n")
    (root / "lib.py").write_text("def a():\n    pass\n\n\ndef b():\n    pass\n")
    graph = str(tmp_path / "g")
    assert cli.main(["build", str(root), "-o", graph, "-e", "app.main", "--meta", "a=b=c"], spark) == 0
    assert read_meta(spark, graph)["user_meta"] == {"a": "b=c"}
    assert cli.main(["analyze", "--graph", graph, "--format", "json"], spark) == 1
    report = json.loads(capsys.readouterr().out)
    assert {x["fqname"] for x in report["dead_symbols"]} == {"app.gone", "app.lib", "app.b", "lib.b"}
    assert cli.main(["analyze", "--graph", graph, "--exit-zero"], spark) == 0
    capsys.readouterr()
    assert cli.main(["remove", str(root), "-e", "app.main"], spark) == 0
    diff = capsys.readouterr().out
    subprocess.run(["git", "apply", "-"], input=diff, text=True, cwd=root, check=True)
    assert (root / "app.py").read_text() == "from lib import a\n\n\ndef main():\n    a()\n\n\n"
    with pytest.raises(SystemExit):
        cli.main(["analyze", "--graph", graph, "--venv", "x"], spark)
