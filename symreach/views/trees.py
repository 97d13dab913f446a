"""Source trees made from a table's rows: each supplier gets a copy of each small package below, and the whole tree is built once.

A package's name is its own with the supplier's key; § stands for the key. tree_answers.py states the known answers, columns
among them, for keys of any length: in a package asked for nodes, no key stands before a node on its line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.closure import cut
from ..plans.builtin import builtin
from ..plans.plugins import Explicit, run_plugins
from ..plans.resolve import build
from . import tree_answers as answers

ROOT = "/w"
PLUGINS = ("main_block", "pytest", "unittest", "init_subclass", "mock_patch", "flask")
NOTEBOOK = '{"cells": [{"cell_type": "code", "source": ["%matplotlib inline\\n", "from .lib       import draw\\n", "draw()"]}, {"cell_type": "markdown", "source": "text"}]}'

PACKAGES: dict[str, dict[str, str]] = {
    "plain": {"m.py": "import os\nLIMIT = 3\nclass Base: pass\nclass Child(Base):\n    size = LIMIT\n    def area(self): return helper(self)\ndef helper(x): return LIMIT\ndef late(): return Child()\nlate()\n"},
    "rebound": {"m.py": "def f(): pass\nf()\ndef f(): pass\nif f():\n    value = 1\nelse:\n    value = 2\ndef g(): return value\n"},
    "scopes": {"m.py": "item = 1\nother = 2\ndef f(item):\n    def inner(): return other\n    return [item for other in inner()]\nclass C:\n    other = item\n    def m(self): return other\nh = lambda item: item + other\n"},
    "targets": {"m.py": "a = 1\nb = 2\nx, (y, *z) = a, b\nbox = {}\nbox[a] = b\nx += y\n"},
    "quoted": {"m.py": "def f(x: 'Later') -> 'list[Later]': pass\nclass Later: pass\nname: 'Later' = None\n"},
    "exported": {"m.py": "__all__ = ['shown', 'missing']\n__author__ = 'x'\ndef shown(): pass\ndef hidden(): pass\n"},
    "overloaded": {"m.py": "from typing import overload\n@overload\ndef pick(a: int): ...\n@overload\ndef pick(a: str): ...\ndef pick(a): return a\n"},
    "branches": {"m.py": "from typing import TYPE_CHECKING\nOFF = False\ndef used(): pass\nif OFF:\n    used()\nif TYPE_CHECKING:\n    kind = used\ndef f():\n    return 1\n    used()\n"},
    "pinned": {"m.py": "import pinned§.a  # noqa: F401\nimport pinned§.b  # noqa: E501\nfrom .a        import x  # noqa\n", "a.py": "x = 1\n", "b.py": ""},
    "aliases": {"tools.py": "def make(): pass\n", "m.py": "from . import tools as t\nimport aliases§.tools as u\nimport aliases§.tools\ndef one(): return t.make()\ndef two(): return u.make()\ndef three(): return aliases§.tools.make()\n"},
    "nested": {"tools.py": "def make(): pass\n", "m.py": "def f():\n    from .tools import make as build\n    return build()\ndef g():\n    import nested§.tools as t\n    return t.make()\n"},
    "stars": {"low.py": "def open_(): pass\ndef _shut(): pass\n", "mid.py": "from .low import *\ndef twice(): return open_()\n", "top.py": "from .mid import *\nWIDE = twice\n", "user.py": "from . import top\nfrom .top import open_, WIDE\nclass Door:\n    way = open_\n    def shut(self): return top.twice()\n"},
    "circles": {"a.py": "try:\n    from .b import name\nexcept ImportError:\n    spare = None\n", "b.py": "from .c import *\n", "c.py": "from .d import *\n", "d.py": "from .a import *\n"},
    "ring": {"left.py": "from .right import *\ndef one(): return TWO\n", "right.py": "from .far import *\nTWO = 2\n", "far.py": "from .left import *\nclass Three: pass\n"},
    "itself": {"__init__.py": "x = 1\nfrom itself§ import x as y\n"},
    "dynamic": {"lib.py": "def run(): pass\nsub = 1\n", "m.py": "import importlib\nimportlib.import_module('dynamic§.lib')\ndef f(): return __import__('dynamic§.lib', fromlist=['run'])\n"},
    "values": {"lib.py": "def run(): pass\n", "m.py": "from importlib import import_module\nlib = import_module('values§.lib')\ndef go(): return lib.run()\n", "far.py": "from .m import lib as other\ndef come(): return other.run()\n"},
    "stubs": {"s.py": "def both(): pass\n", "s.pyi": "def both() -> int: ...\ndef only() -> int: ...\n"},
    "outside": {"m.py": "import json\nimport nowhere§\nfrom plainly.absent import thing\n"},
    "notes": {"lib.py": "def draw(): pass\n", "book.ipynb": NOTEBOOK},
    "script": {"m.py": "def main(): pass\ndef other(): pass\nif __name__ == '__main__':\n    started = main()\n"},
    "tested": {"conftest.py": "import pytest\n@pytest.fixture\ndef store§(): pass\n@pytest.fixture(name='link§')\ndef _link(): pass\n", "test_m.py": "def test_one(store§): pass\nclass TestTwo:\n    def test_two(self, link§): pass\ndef helper(): pass\n"},
    "cases": {"m.py": "import unittest\nclass First(unittest.TestCase): pass\nclass Second(First): pass\nclass Other: pass\ndef setUpModule(): pass\n"},
    "hooked": {"m.py": "class Root:\n    def __init_subclass__(cls): pass\nclass Leaf(Root): pass\nclass Leaf2(Leaf): pass\nclass Free: pass\n"},
    "patched": {"lib.py": "def real(): pass\n", "m.py": "from unittest.mock import patch\ndef f():\n    with patch('patched§.lib.real'): pass\n"},
    "served": {"m.py": "from flask import Flask\napp = Flask(__name__)\n@app.route('/')\ndef home(): pass\n@app.errorhandler(404)\ndef lost(): pass\ndef free(): pass\n"},
    "named": {"m.py": "def keep(): pass\ndef drop(): pass\n"},
}
#: What a column of packages is asked for: edges by names, or nodes.
NODES = ("rebound", "pinned", "outside", "notes", "script", "tested", "cases", "branches", "named", "stubs")



def _full(package: str, name: str) -> str:
    return f"{package}§" if name == "." else f"{package}§{name}" if name.startswith(".") else name


def answers_sql(package: str, of_nodes: bool) -> str:
    """The known answer of a package, for each supplier."""
    rows = []
    for line in (answers.NODES if of_nodes else answers.EDGES)[package]:
        if of_nodes:
            name, kind, *numbers = line.split(" ")
            rows.append(f"('{_full(package, name)}', '{kind}', {', '.join(numbers)})")
        else:
            src, _, dst, *flags = line.split(" ")
            rows.append(f"('{_full(package, src)}', '{_full(package, dst)}', {(flags or ['0'])[0]})")
    keys = "(SELECT CAST(s_suppkey AS VARCHAR) AS k FROM supplier)"
    if of_nodes:
        return f"SELECT replace(f, '§', k) AS fqname, kind, CAST(l AS INT) AS start_line, CAST(c AS INT) AS start_column, CAST(b AS BIGINT) AS flags FROM (VALUES {', '.join(rows)}) v(f, kind, l, c, b), {keys}"
    return f"SELECT replace(a, '§', k) AS src, replace(b, '§', k) AS dst, CAST(f AS INT) AS flags FROM (VALUES {', '.join(rows)}) v(a, b, f), {keys}"


_built: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, sha) of all packages of all suppliers."""
    files = []
    for package, own in PACKAGES.items():
        files += [(f"{ROOT}/{package}§/{name}", text) for name, text in ({"__init__.py": ""} | own).items()]
    one = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("content")) for p, t in files])).alias("f")
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("k"), one)
    put = lambda c: F.replace(F.col(f"f.{c}"), F.lit("§"), F.col("k"))
    return keys.select(put("path").alias("path"), put("content").alias("content")).withColumn("sha", F.sha2("content", 256))


def built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(package, src, dst, flags) of the edges and (package, fqname, kind, start_line, start_column, flags) of the nodes, plug-ins applied; built and written once for a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _built:
        graph = build(tree(spark, sf_dir), [ROOT])
        graph = run_plugins(graph, [*(builtin(p) for p in PLUGINS), Explicit(regexes=[r"^named\d+/m\.py$"])], graph.facts, ROOT)
        package = F.regexp_extract("path", rf"^{ROOT}/([a-z]+)", 1).alias("package")
        nodes = cut(graph.nodes.select("node_id", package, "fqname", "kind", "start_line", "start_column", "flags"))
        names = nodes.select("node_id", "package", "fqname")
        edges = graph.edges.join(names.select(F.col("node_id").alias("src"), "package", F.col("fqname").alias("a")), "src").join(names.select(F.col("node_id").alias("dst"), F.col("fqname").alias("b")), "dst")
        _built[key] = cut(edges.select("package", F.col("a").alias("src"), F.col("b").alias("dst"), "flags")), nodes.drop("node_id")
    return _built[key]


def asked(spark: SparkSession, sf_dir: str, package: str, of_nodes: bool) -> DataFrame:
    edges, nodes = built(spark, sf_dir)
    return (nodes if of_nodes else edges).where(F.col("package") == package).drop("package")


#: A query for each package, and its SQL.
QUERIES = {f"tree_{p}{'_nodes' * n}": (lambda spark, sf_dir, p=p, n=n: asked(spark, sf_dir, p, n)) for n in (False, True) for p in (NODES if n else PACKAGES)}
ORACLES = {f"tree_{p}{'_nodes' * n}": answers_sql(p, n) for n in (False, True) for p in (NODES if n else PACKAGES)}
