"""symreach build | analyze | remove: graphs of source trees from the command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .graph import SymbolGraph
from .operators.stats import by_kind
from .plans.builtin import builtin
from .plans.plugins import Explicit, run_plugins
from .plans.resolve import build
from .sources.codemod import patch
from .sources.files import installed, project_scripts, read_tree, report_json, search_paths

QUERIES = ("dead", "test-only", "dead-tests")


def make_graph(spark: SparkSession, root: str, venv: str | None, plugins: list[str], entrypoints: list[str], regexes: list[str]) -> SymbolGraph:
    graph = build(read_tree(spark, root), search_paths(root, venv), dists=installed(spark, venv))
    own = [builtin(p, **({"targets": project_scripts(root)} if p == "project_scripts" else {})) for p in plugins]
    if entrypoints or regexes:
        own.append(Explicit(regexes=regexes, exact=entrypoints))
    facts = graph.facts
    return run_plugins(graph, own, facts, root) if own else graph


def selected(graph: SymbolGraph, query: str):
    if query == "test-only":
        return graph.test_only()
    return graph.dead_tests() if query == "dead-tests" else graph.dead_all()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="symreach", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("build", "analyze", "remove"):
        c = sub.add_parser(name)
        c.add_argument("root", nargs="?")
        c.add_argument("--venv")
        c.add_argument("--plugin", action="append", default=[])
        c.add_argument("-e", "--entrypoint", action="append", default=[])
        c.add_argument("--entrypoint-regex", action="append", default=[])
        if name == "build":
            c.add_argument("-o", "--output", required=True)
            c.add_argument("--meta", action="append", default=[], metavar="KEY=VALUE")
        else:
            c.add_argument("--graph")
            c.add_argument("--query", choices=QUERIES, default="dead")
        if name == "analyze":
            c.add_argument("--format", choices=("text", "json"), default="text")
            c.add_argument("--exit-zero", action="store_true")
    a = p.parse_args(argv)
    if getattr(a, "graph", None) and (a.venv or a.plugin or a.entrypoint or a.entrypoint_regex):
        p.error("--graph is a built graph: --venv, --plugin, -e and --entrypoint-regex do not go with it")
    if not a.root and not getattr(a, "graph", None):
        p.error("a source tree or --graph is needed")
    spark = spark or SparkSession.builder.getOrCreate()
    if getattr(a, "graph", None):
        graph = SymbolGraph.read(spark, a.graph)
    else:
        graph = make_graph(spark, a.root, a.venv, a.plugin, a.entrypoint, a.entrypoint_regex)
    if a.command == "build":
        graph.write(a.output, dict(x.split("=", 1) for x in a.meta))
        return 0
    found = selected(graph, a.query)
    if a.command == "remove":
        dead = [r.asDict() for r in found.where(F.col("flags").bitwiseAND(F.lit(S.NOTEBOOK | S.STAR_REEXPORT)) == 0).where("kind <> 'external'").collect()]
        sys.stdout.write(patch(a.root, dead))
        return 0
    rows = [r.asDict() for r in by_kind(graph.nodes, found).orderBy("kind").collect()]
    dead = [r.asDict() for r in found.select("fqname", "kind", "path").orderBy("path", "fqname").collect()]
    if a.format == "json":
        print(report_json(rows, dead))
    else:
        for r in rows:
            print(f"{r['kind']}: {r['dead']} of {r['total']}")
        for r in dead:
            print(f"{r['path']}: {r['fqname']} ({r['kind']})")
    return int(bool(dead) and not a.exit_zero)


if __name__ == "__main__":
    sys.exit(main())
