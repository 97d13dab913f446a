"""Python sources to graphs. Whole trees, with exact edge sets, are queries of symreach.views.trees, which test_oracle.py runs."""

import ast
import json
import textwrap

import duckdb
import pytest

from symreach import schema as S
from symreach.plans.resolve import build, parse
from symreach.sources import files as src
from symreach.sources.extract import constants, extract
from symreach.views.trees import ORACLES, QUERIES


def names(source, module="mod"):
    """Local edges of one module by name."""
    f = extract(textwrap.dedent(source), module, False)
    assert f.error is None
    found = {(f.nodes[r.src].name, f.nodes[r.target].name) for r in f.refs if r.kind == "local"}
    found |= {(n.name, module) for n in f.nodes[1:]}
    return {f"{a} -> {b}" for a, b in found}


def to_module(*decls):
    return {f"mod.{d} -> mod" for d in decls}


@pytest.mark.parametrize(
    "source, decls, more",
    [
        ("def a(): pass\ndef b(): a()\nb()", "ab", {"mod.b -> mod.a", "mod -> mod.b"}),
        ("def late(): return early\nearly = 1", ["late", "early"], {"mod.late -> mod.early"}),
        ("def d(f): return f\nP = 1\n@d\ndef g(x=P): pass", ["d", "P", "g"], {"mod.g -> mod.d", "mod.g -> mod.P"}),
        ("class A: pass\nclass B(A):\n  def m(self): return C\nC = 2", "ABC", {"mod.B -> mod.A", "mod.B -> mod.C"}),
        ("x = 1\nx = x\ny = x", "xy", {"mod.y -> mod.x", "mod.x -> mod.x"}),
        ("a = 1\nb = 2\nc, d = a, b", "abcd", {"mod.c -> mod.a", "mod.d -> mod.b"}),
        ("def f(x: 'T') -> 'T': pass\nclass T: pass", ["f", "T"], {"mod.f -> mod.T"}),
        ("__version__ = '1'", ["__version__"], {"mod -> mod.__version__"}),
        ("def f(): pass\n__all__ = ['f', 'gone']", ["f", "__all__"], {"mod -> mod.__all__", "mod.__all__ -> mod.f"}),
        ("if c():\n  def f(): pass\nelse:\n  f = None\ndef c(): pass\nf", ["f", "c"], {"mod -> mod.f"}),
        ("def f(a):\n  a\n  b = g\n  return [g for g in b]\ng = 1", "fg", {"mod.f -> mod.g"}),
        ("def f():\n  def inner(): return g\n  return inner\ng = 1", "fg", {"mod.f -> mod.g"}),
        ("for i in r: i\nr = 1", "r", set()),
        ("r = 1\nfor i in r: pass", "r", {"mod -> mod.r"}),
        ("type A = B\nB = int", "AB", set()),
        ("import os\nos.path", ["os"], {"mod -> mod.os"}),
    ],
)
def test_one_module(source, decls, more):
    got = names(source)
    assert got - {"mod.x -> mod.x"} == (to_module(*decls) | more) - {"mod.x -> mod.x"}


def test_positions_shadowing_and_flags():
    f = extract("def f(): pass\ndef f(): pass\nif False:\n  z = f\nimport a  # noqa: F401\nimport b  # noqa: E501\n", "m", False)
    assert [(n.name, n.line, n.column, n.end_column) for n in f.nodes[1:3]] == [("m.f", 1, 0, 5), ("m.f", 2, 0, 5)]
    by = {n.name: n for n in f.nodes}
    assert by["m.z"].flags & S.DEAD_BRANCH and by["m.a"].flags & S.NOQA and not by["m.b"].flags & S.NOQA
    assert [r.flags for r in f.refs if f.nodes[r.src].name == "m.z"] == [S.EDGE_DEAD_BRANCH]


def test_dead_after_terminator_and_constant_names():
    f = extract("DEBUG = False\ndef f():\n  return 1\n  g()\nif DEBUG:\n  x = 1\ndef g(): pass\n", "m", False)
    by = {n.name: n for n in f.nodes}
    assert by["m.x"].flags & S.DEAD_BRANCH
    assert [r.flags for r in f.refs if r.kind == "local" and f.nodes[r.target].name == "m.g"] == [S.EDGE_DEAD_BRANCH]


def test_overloads_hang_on_the_implementation():
    f = extract("from typing import overload\n@overload\ndef f(a: int): ...\n@overload\ndef f(a: str): ...\ndef f(a): pass\n", "m", False)
    impl = max(i for i, n in enumerate(f.nodes) if n.name == "m.f")
    assert {r.target for r in f.refs if r.src == impl and r.kind == "local" and f.nodes[r.target].name == "m.f"} == {2, 3}
    assert f.exports["f"] == {impl}


def test_a_bad_file_is_its_module_alone():
    f = extract("def (:", "m", False)
    assert f.error and len(f.nodes) == 1 and not f.refs


def test_dead_code_of_a_tree(spark):
    tree = {
        "app.py": "from lib import used\nused()\nif __name__ == '__main__':\n  used()\n",
        "lib.py": "import requests\nimport nowhere\ndef used(): helper()\ndef helper(): pass\ndef unused(): helper()\n",
        "nb.ipynb": json.dumps({"cells": [{"cell_type": "code", "source": ["%matplotlib\n", "from lib import helper\n"]}, {"cell_type": "markdown", "source": "x"}]}),
        "s.pyi": "def a() -> int: ...\ndef only() -> int: ...\n",
        "s.py": "def a(): pass\n",
        "broken.py": "def (",
    }
    dists = spark.createDataFrame([("requests", "requests")], "top string, dist string")
    g = build(src.from_dict(spark, tree), ["/w"], dists=dists)
    nodes = {r["fqname"]: r for r in g.nodes.collect()}
    assert nodes["lib.nowhere"]["flags"] & S.UNRESOLVED and not nodes["lib.requests"]["flags"] & S.UNRESOLVED
    assert nodes["[external dist] requests"]["kind"] == "external"
    assert nodes["nb.helper"]["flags"] & S.NOTEBOOK and nodes["s.only"]["flags"] & S.ENTRYPOINT
    assert [r["path"] for r in g.errors.collect()] == ["/w/broken.py"]
    dead = {r["fqname"] for r in g.dead(S.NOTEBOOK).collect()}
    assert "lib.unused" in dead and "lib.helper" not in dead


def test_module_names_take_the_deepest_path(spark):
    d = src.named_modules(src.from_dict(spark, {"src/pkg/a.py": "", "src/pkg/__init__.py": "", "b.py": ""}), ["/w", "/w/src"])
    assert {r["path"]: (r["module"], r["package"]) for r in d.collect()} == {"/w/src/pkg/a.py": ("pkg.a", False), "/w/src/pkg/__init__.py": ("pkg", True), "/w/b.py": ("b", False)}


def test_installed_distributions_and_listing(spark, tmp_path):
    info = tmp_path / "venv" / "lib" / "python3.13" / "site-packages" / "Some_Thing-1.0.dist-info"
    info.mkdir(parents=True)
    (info / "RECORD").write_text("thing/__init__.py,,\nlone.py,,\n")
    (info / "METADATA").write_text("Name: Some_Thing\nVersion: 1.0\n")
    assert {(r["top"], r["dist"]) for r in src.installed(spark, str(tmp_path / "venv")).collect()} == {("thing", "some-thing"), ("lone", "some-thing")}
    assert src.installed(spark, None) is None and src.installed(spark, str(tmp_path)) is None
    for name in ("a.py", "b.pyi", "c.ipynb", "d.txt"):
        (tmp_path / name).write_text("x")
    assert {r["path"].rsplit("/", 1)[1] for r in src.read_tree(spark, str(tmp_path)).collect()} == {"a.py", "b.pyi", "c.ipynb"}


@pytest.mark.parametrize("name", ["tree_pinned_nodes", "tree_notes_nodes"])
def test_tree_columns_of_long_keys(spark, tmp_path_factory, name):
    d = wide_suppliers(spark, tmp_path_factory)
    names, rows = duckdb_rows(ORACLES[name].replace("FROM supplier", f"FROM read_parquet('{d}/supplier.parquet/*.parquet')"))
    assert sorted(map(tuple, QUERIES[name](spark, d).select(*names).collect())) == sorted(rows)


_wide: list[str] = []


def wide_suppliers(spark, tmp_path_factory) -> str:
    """A folder with suppliers whose keys are of several lengths."""
    if not _wide:
        _wide.append(str(tmp_path_factory.mktemp("wide")))
        spark.createDataFrame([(7,), (10,), (60_000_123,)], "s_suppkey long").write.parquet(f"{_wide[0]}/supplier.parquet")
    return _wide[0]


def duckdb_rows(sql: str):
    rel = duckdb.connect().execute(sql)
    return [x[0] for x in rel.description], rel.fetchall()


def test_a_tag_of_the_parsed_rows_is_read_alone(spark):
    rows = parse(src.from_dict(spark, {"m.py": "import os\ndef f(): return os\n"}), ["/w"])
    facts = rows.where("row = 'fact'")
    assert "PartitionFilters: [isnotnull(row" in facts._jdf.queryExecution().executedPlan().toString()
    assert {r["name"] for r in rows.where("row = 'export'").collect()} == {"os", "f"}
    assert {r["row"] for r in rows.select("row").distinct().collect()} == {"node", "ref", "export", "fact"}


def test_scopes_without_plain_truths_are_not_walked(monkeypatch):
    walked = []
    walk = ast.walk
    monkeypatch.setattr(ast, "walk", lambda x: (walked.append(x), walk(x))[1])
    assert constants(ast.parse("x = f()\ndef g(): pass\ny = x\n").body) == {} and not walked
    # A name by another name, and one that is bound again elsewhere.
    assert constants(ast.parse("b = a\na = 0\nc = 1\nfor c in z: pass\n").body) == {"a": False, "b": False} and walked
