"""Built-in plug-ins on small trees."""

import threading

import pytest

from symreach.plans import builtin as B
from symreach.plans.builtin import builtin
from symreach.plans.plugins import Explicit, GraphView, Ops, Plugin, ServerConfig, run_plugins
from symreach.plans.resolve import build
from symreach.sources.files import from_dict

TREE = {
    "conftest.py": "import pytest\n@pytest.fixture\ndef db(): pass\n@pytest.fixture(name='net')\ndef make(): pass\n",
    "test_a.py": "import unittest\nfrom lib import used\ndef test_one(db): used()\nclass TestTwo:\n  def test_x(self, net): pass\nclass Case(unittest.TestCase):\n  pass\nclass Sub(Case):\n  pass\n",
    "lib.py": "def used(): pass\ndef unused(): pass\n",
    "base.py": "class Base:\n  def __init_subclass__(cls): pass\nclass Child(Base): pass\nclass Grand(Child): pass\n",
    "cli.py": "import typer\napp = typer.Typer()\n@app.command()\ndef run(): pass\ndef main(): app()\n",
    "job.py": "from celery import Celery, shared_task\nfrom unittest import mock\napp = Celery()\n@app.task\ndef t(): pass\n@shared_task\ndef u(): pass\n__all__ = ['t', 'nope']\nNAMES = ['a', 'b']\ndef p(): mock.patch('lib.unused.x')\nif '__main__' == __name__:\n  z = 1\n",
    "srv.py": "from fastmcp import FastMCP as F\nclass Own(F): pass\nmcp = Own()\n@mcp.tool\ndef t(): pass\n",
}


@pytest.fixture(scope="module")
def graph(spark):
    return build(from_dict(spark, TREE), ["/w"])


def reached(g, mask=None):
    return {r["fqname"] for r in g.nodes.join(g.reachable(mask), "node_id", "left_semi").collect()}


def test_pytest_and_unittest(graph):
    g = run_plugins(graph, [builtin("pytest"), builtin("unittest")], graph.facts)
    names = {r["fqname"]: r["flags"] for r in g.nodes.collect()}
    case, fixture = g.node_flag("test/testcase"), g.node_flag("test/fixture")
    assert {n for n, f in names.items() if f & case} == {"test_a.test_one", "test_a.TestTwo", "test_a.Case", "test_a.Sub"}
    assert {n for n, f in names.items() if f & fixture} == {"conftest.db", "conftest.make"}
    ids = {r["node_id"]: r["fqname"] for r in g.nodes.collect()}
    pairs = {(ids[r["src"]], ids[r["dst"]]) for r in g.edges.collect()}
    assert {("test_a.test_one", "conftest.db"), ("test_a.TestTwo", "conftest.make")} <= pairs
    assert "lib.used" in {r["fqname"] for r in g.test_only().collect()}


def test_unittest_module_hooks(spark):
    hooks = "def setUpModule(): helper()\ndef tearDownModule(): pass\ndef load_tests(a, b, c): pass\ndef helper(): pass\ndef other(): pass\n"
    tree = {"a.py": f"import unittest\n{hooks}", "b.py": f"from unittest.case import TestCase as T\n{hooks}", "c.py": f"from unittest import *\n{hooks}", "d.py": f"import unittestx\n{hooks}"}
    g = build(from_dict(spark, tree), ["/w"])
    g = run_plugins(g, [builtin("unittest"), Explicit(exact=["a", "b", "c", "d"])], g.facts, "/w")
    ids = {r["node_id"]: r["fqname"] for r in g.nodes.collect()}
    found = {(ids[r["src"]], ids[r["dst"]]) for r in g.edges.collect()}
    wanted = {(m, f"{m}.{h}") for m in "abc" for h in ("setUpModule", "tearDownModule", "load_tests")}
    assert wanted <= found and not any(a == "d" and b.startswith("d.") and b != "d.unittestx" for a, b in found)
    assert {"a.setUpModule", "a.helper", "b.load_tests"} <= reached(g) and not {"a.other", "d.setUpModule"} & reached(g)


def test_frameworks_scripts_and_hooks(graph):
    g = run_plugins(graph, [builtin("typer"), builtin("fastmcp"), builtin("init_subclass"), builtin("project_scripts", targets=["cli.main"])], graph.facts)
    live = reached(g)
    assert {"cli.main", "cli.app", "cli.run", "srv.mcp", "srv.t"} <= live and "lib.unused" not in live
    ids = {r["node_id"]: r["fqname"] for r in g.nodes.collect()}
    assert {(ids[r["src"]], ids[r["dst"]]) for r in g.edges.where("flags = 4").collect()} == {("base.Base", "base.Child"), ("base.Base", "base.Grand")}


def test_explicit_and_server_config(graph):
    g = run_plugins(graph, [Explicit(regexes=["li"], exact=["cli.app"]), ServerConfig(["srv.py"])], graph.facts, "/w")
    assert {"lib.unused", "cli.app", "srv.t"} <= reached(g)


def test_ids_that_are_no_nodes_stop_all(graph, spark):
    class Bad(Plugin):
        name = "bad"

        def run(self, view):
            return Ops(flags=spark.createDataFrame([(10**9, 2)], "node_id long, bits long"))

    with pytest.raises(IndexError):
        run_plugins(graph, [Bad()], graph.facts)
    with pytest.raises(KeyError):
        builtin("nothing")


def test_plugins_run_side_by_side(graph, spark):
    both = threading.Barrier(2)

    class Meets(Plugin):
        def run(self, view):
            # Neither comes past this before the other has begun; what both ask for is made once.
            both.wait(30)
            view.once("shared", lambda: (made.append(1), view.nodes.select("node_id"))[1])
            return Ops()

    made = []
    run_plugins(graph, [Meets(), Meets()], graph.facts)
    assert made == [1]


def test_all_plugins_ids_are_checked_at_once(graph, spark, monkeypatch):
    class Odd(Plugin):
        def __init__(self, name, node):
            self.name, self.node = name, node

        def run(self, view):
            return Ops(edges=spark.createDataFrame([(self.node, 0, 0)], "src long, dst long, flags int"))

    with pytest.raises(IndexError, match=f"plug-in second: no node {10**9}"):
        run_plugins(graph, [Odd("first", 1), Odd("second", 10**9), Odd("third", 10**8)], graph.facts)
    asked, collect = [], type(graph.nodes).collect
    monkeypatch.setattr(type(graph.nodes), "collect", lambda self: (asked.append(1), collect(self))[1])
    run_plugins(graph, [Odd("first", 1), Odd("second", 2), Explicit(exact=["cli.app"])], graph.facts)
    assert len(asked) == 1


def test_main_block_mock_and_tasks(graph):
    g = run_plugins(graph, [builtin("main_block"), builtin("mock_patch"), builtin("celery")], graph.facts)
    assert {"job", "job.z", "job.app", "job.t", "job.u"} <= reached(g)
    ids = {r["node_id"]: r["fqname"] for r in g.nodes.collect()}
    assert ("job.p", "lib.unused") in {(ids[r["src"]], ids[r["dst"]]) for r in g.edges.collect()}


def test_fact_lookups(graph):
    view = GraphView(graph, graph.facts)
    ids = {r["node_id"]: r["fqname"] for r in graph.nodes.collect()}
    named = lambda d: {ids[r["node_id"]] for r in d.collect()}
    assert named(B.constructions(view, ["typer.Typer"])) == {"cli.app"} and named(B.classes_defining(view, "__init_subclass__")) == {"base.Base"}
    assert [(ids[r["node_id"]], r["value"]) for r in B.calls_to(view, ["unittest.mock.patch"]).collect()] == [("job.p", "lib.unused.x")]
    assert {(ids[r["node_id"]], r["owner"]) for r in B.handler_decorators(view, ["command"]).collect()} == {("cli.run", "app")}
    assert named(B.decorated_decls(view, ["pytest.fixture"])) == {"conftest.db", "conftest.make"} and "cli.main" in named(B.factories(view, ["cli.app"]))
    got = {r["path"]: [ids[x] for x in r["exports"]] for r in B.dunder_all(view).collect()}
    assert got == {"/w/job.py": ["job.t"]}
    assert [r["entries"] for r in B.literal_entries(view, "NAMES").collect()] == [["a", "b"]]
    one = graph.nodes.where("fqname = 'test_a.test_one' OR fqname = 'lib'").select("node_id")
    assert {ids[r["node_id"]]: r["parameters"] for r in B.parameters(view, one).collect()} == {"test_a.test_one": ["db"], "lib": []}


def test_no_plan_holds_the_joins_of_several_parts(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    joins, write = [], DataFrameWriter.parquet

    def counted(self, *a, **b):
        joins.append(self._df._jdf.queryExecution().analyzed().toString().count("Join "))
        return write(self, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    g = build(from_dict(spark, TREE), ["/w"])
    g = run_plugins(g, [builtin(p) for p in ("pytest", "unittest", "init_subclass", "mock_patch", "flask")], g.facts)
    g.edges.write.mode("overwrite").format("noop").save()
    assert max(joins) <= 8


def test_small_files_in_one_partition_are_parsed_by_several_tasks(spark):
    from symreach.plans.resolve import parse

    files = from_dict(spark, {f"m{i}.py": "x = 1\n" for i in range(64)}).coalesce(1)
    assert len(parse(files, ["/w"]).inputFiles()) > 1


def test_dynamic_fanout_of_one_large_file(spark):
    from symreach.plans.plugins import dynamic_fanout

    nodes = spark.createDataFrame([(i, f"m.n{i}", "function", "/w/m.py") for i in range(50)] + [(7, "k.n7", "function", "/w/k.py"), (99, "k", "module", "/w/k.py"), (98, "k._x", "function", "/w/k.py")], "node_id long, fqname string, kind string, path string")
    imports = spark.createDataFrame([(i, 3) for i in range(1000, 1100)] + [(1000, 3), (1000, 99), (5, 4)], "src long, dst long")
    got = dynamic_fanout(imports, nodes)
    rows = sorted((r["src"], r["dst"]) for r in got.collect())
    # 7 stands in both files of 1000's imports and is met once.
    assert rows == sorted({(s, d) for s in [*range(1000, 1100), 5] for d in range(50) if s != d})
    # Pairs of names of one file are not shuffled again to be told apart.
    assert got._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_dynamic_fanout_meets_each_pair_of_blocks_once(spark, monkeypatch):
    from symreach.plans import plugins

    monkeypatch.setattr(plugins, "BLOCK", 16)
    monkeypatch.setattr(plugins, "RUN", 5)
    # A large and a small file, one of many names, one of many importers; ten names stand in two files.
    files = {"/w/a.py": (range(60), range(40, 140)), "/w/b.py": (range(200, 203), range(2)), "/w/c.py": (range(50, 150), [7]), "/w/d.py": ([300], range(290, 380))}
    nodes = spark.createDataFrame([(i, f"m.n{i}", "class", path) for path, (names, _) in files.items() for i in names], "node_id long, fqname string, kind string, path string")
    # Of each file a name that stands in no other is imported.
    imports = spark.createDataFrame([(s, own) for own, (_, srcs) in zip((0, 202, 149, 300), files.values()) for s in srcs] + [(None, 0)], "src long, dst long")
    at = {i: {p for p, (names, _) in files.items() if i in names} for names, _ in files.values() for i in names}
    want = {(r["src"], i) for r in imports.collect() if r["src"] is not None for p in at[r["dst"]] for i in files[p][0] if i != r["src"]}
    assert sorted(tuple(r) for r in plugins.dynamic_fanout(imports, nodes).collect()) == sorted((s, d, 0) for s, d in want)


def test_dynamic_fanout_shuffles_no_row_for_each_name_and_part_and_writes_small_files(spark, tmp_path):
    from pathlib import Path

    from symreach.plans.plugins import dynamic_fanout

    nodes = spark.range(9000).selectExpr("id AS node_id", "concat('m.n', id) AS fqname", "'function' AS kind", "'/w/m.py' AS path")
    got = dynamic_fanout(spark.range(300).selectExpr("id * 20 AS src", "id % 7 AS dst"), nodes)
    got.write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    # 300 importers, in the file themselves, and 9,000 names, which are more than a block.
    n = 300 * 8999
    assert out.where("src % 20 = 0 AND src < 6000 AND dst BETWEEN 0 AND 8999 AND src <> dst").count() == out.distinct().count() == out.count() == n
    # Half a byte a pair; two where all names of an importer stand together.
    assert sum(x.stat().st_size for x in Path(tmp_path / "out").glob("*.parquet")) < n / 2
    # Names meet importers as arrays: it was a row for each name in each of 64 parts.
    run = got._jdf.queryExecution()
    assert run.toRdd().count() == n
    assert shuffled_rows(run.executedPlan()) < 30_000


def shuffled_rows(plan) -> int:
    """Rows that the exchanges of a plan that has run have written."""
    found, todo = 0, [plan]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            found += p.metrics().apply("shuffleRecordsWritten").value()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            c = p.children()
            todo += [c.apply(i) for i in range(c.size())]
    return found
