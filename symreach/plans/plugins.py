"""Plug-ins: what they see (a frozen graph), what they emit (flags and edges), and the joins that they share."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..graph import SymbolGraph
from ..operators import closure
from ..operators.filters import matching_specs

#: Ids of a file that meet others as one block, about; importers that stand together in the output.
BLOCK, RUN = 8192, 256
#: Tasks among which pairs are dealt, up to 2^26 pairs for each.
PARTS = 64


class GraphView:
    """A graph as plug-ins see it. DataFrames do not change, so all see the same."""

    def __init__(self, graph: SymbolGraph, facts: DataFrame | None = None, root: str = ""):
        self.graph, self.nodes, self.edges, self.facts, self.root = graph, graph.nodes, graph.edges, facts, root
        self._kept: dict[str, DataFrame] = {}
        self._locks: defaultdict[str, Lock] = defaultdict(Lock)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What several plug-ins ask for, made and written at the first call."""
        with self._locks[name]:
            if name not in self._kept:
                self._kept[name] = closure.cut(make())
            return self._kept[name]

    def facts_for(self, topic: str) -> DataFrame:
        return self.facts.where(F.col("topic") == topic)


@dataclass
class Ops:
    """flags: node_id, bits; edges: src, dst, flags."""

    flags: DataFrame | None = None
    edges: DataFrame | None = None

    @classmethod
    def keep_alive(cls, nodes: DataFrame) -> Ops:
        return cls(flags=nodes.select("node_id", F.lit(S.ENTRYPOINT).cast("long").alias("bits")))


class Plugin:
    """A name, flags that it declares, and run(view) -> Ops."""

    name = ""

    def declare(self, registry) -> None:
        pass

    def run(self, view: GraphView) -> Ops:
        raise NotImplementedError


class Explicit(Plugin):
    """Keeps alive what patterns on relative paths, exact paths or names, or absolute paths name."""

    name = "explicit"

    def __init__(self, regexes=(), exact=(), absolute=()):
        self.regexes, self.exact, self.absolute = list(regexes), list(exact), list(absolute)

    def run(self, view: GraphView) -> Ops:
        if not (self.regexes or self.exact or self.absolute):
            return Ops()
        return Ops.keep_alive(matching_specs(view.nodes, view.root, self.regexes, self.exact, self.absolute))


class ServerConfig(Plugin):
    """Keeps alive all but the type aliases of files with certain names."""

    name = "server_config"

    def __init__(self, filenames):
        self.filenames = list(filenames)

    def run(self, view: GraphView) -> Ops:
        from ..operators.filters import where

        return Ops.keep_alive(where(view.nodes, basenames=self.filenames).where("kind <> 'type_alias'"))


def apply_ops(graph: SymbolGraph, ops: list[Ops]) -> SymbolGraph:
    """The graph with all flags ORed in and all edges added to the set."""
    nodes, edges = graph.nodes, graph.edges
    if flags := [o.flags for o in ops if o.flags is not None]:
        bits = reduce(DataFrame.unionByName, flags).groupBy("node_id").agg(F.bit_or("bits").alias("_bits"))
        names = nodes.columns
        nodes = nodes.join(bits, "node_id", "left").withColumn("flags", F.col("flags").bitwiseOR(F.coalesce("_bits", F.lit(0).cast("long")))).select(*names)
    if more := [o.edges for o in ops if o.edges is not None]:
        edges = reduce(DataFrame.unionByName, [edges, *more]).dropDuplicates(["src", "dst", "flags"])
    return SymbolGraph(nodes, edges, graph.registry, **graph.how)


def run_plugins(graph: SymbolGraph, plugins: list[Plugin], facts: DataFrame | None = None, root: str = "") -> SymbolGraph:
    """All plug-ins on the same frozen graph; ids that are no nodes are an error, and then nothing is applied."""
    for p in plugins:
        p.declare(graph.registry)
    view = GraphView(graph, facts, root)
    # Each written by itself: no plan holds the joins of several plug-ins, nor runs them again.
    def written(p: Plugin) -> Ops:
        o = p.run(view)
        return Ops(*[d if d is None else closure.cut(d) for d in (o.flags, o.edges)])

    with closure.Beside(graph.nodes.sparkSession) as beside:
        ops = [x.result() for x in [beside.start(lambda p=p: written(p)) for p in plugins]]
    named = []
    for i, o in enumerate(ops):
        at = F.lit(i).alias("_at")
        named += [o.flags.select(at, "node_id")] if o.flags is not None else []
        named += [o.edges.select(at, F.col(c).alias("node_id")) for c in ("src", "dst")] if o.edges is not None else []
    # Written first: an anti-join would go below the union, once for each part. The first plug-in that names an odd id is told.
    if named and (odd := closure.cut(reduce(DataFrame.unionByName, named).groupBy("node_id").agg(F.min("_at").alias("_at"))).join(graph.nodes.select("node_id"), "node_id", "left_anti").orderBy("_at", "node_id").limit(1).collect()):
        raise IndexError(f"plug-in {plugins[odd[0]['_at']].name}: no node {odd[0]['node_id']}")
    return apply_ops(graph, ops)


def fixture_edges(params: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Edges from tests to the fixtures that their parameters (node_id, name) name; fixtures: node_id, name."""
    f = fixtures.select(F.col("node_id").alias("dst"), "name")
    return params.join(f, "name").select(F.col("node_id").alias("src"), "dst", F.lit(0).alias("flags")).distinct()


def dispatch_edges(apps: DataFrame, handlers: DataFrame) -> DataFrame:
    """Edges from app variables (node_id, path, name) to the handlers (node_id, path, owner) of their file."""
    a = apps.select(F.col("node_id").alias("src"), "path", F.col("name").alias("owner"))
    return handlers.join(a, ["path", "owner"]).select("src", F.col("node_id").alias("dst"), F.lit(0).alias("flags")).distinct()


def dynamic_fanout(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from what imports a node dynamically to all public names of that node's file."""
    targets = closure.cut(imports.select("src", F.col("dst").alias("node_id")).join(nodes.select("node_id", "path"), "node_id").select("src", "path").distinct())
    asked = closure.cut(targets.groupBy("path").agg(F.count("*").alias("_srcs")))
    public = nodes.where((F.col("kind") != "module") & ~F.substring_index("fqname", ".", -1).startswith("_")).select(F.col("node_id").alias("dst"), "path").join(asked.select("path"), "path", "left_semi")
    public = closure.cut(public.groupBy("dst").agg(F.collect_set("path").alias("paths")))
    edges = [_pairs(targets, asked, public.where(F.size("paths") == 1).select("dst", F.col("paths")[0].alias("path")))]
    # A name of one file meets an importer once; pairs of names that stand in several are told apart.
    if not (several := public.where(F.size("paths") > 1)).isEmpty():
        edges += [_pairs(targets, asked, several.select("dst", F.explode("paths").alias("path"))).distinct()]
    return reduce(DataFrame.unionByName, edges)


def _pairs(targets: DataFrame, asked: DataFrame, names: DataFrame) -> DataFrame:
    """Edges from each importer (src, path) to the names (dst, path) of its file; asked: path, _srcs. Blocks of ids are shuffled, pairs are not."""
    sizes = closure.cut(asked.join(names.groupBy("path").agg(F.count("*").alias("_dsts")), "path"))
    n, ids = sizes.agg(F.coalesce(F.sum(F.col("_srcs") * F.col("_dsts")), F.lit(0)), F.coalesce(F.sum(F.col("_srcs") + F.col("_dsts")), F.lit(0))).first()
    tasks = max(1 + min(n >> 20, PARTS), n >> 26, ids >> 18)
    # Files of more than one block: at most one for each BLOCK ids.
    large = F.broadcast(sizes.select("path", *[F.ceil(F.col(c) / BLOCK).alias(k) for k, c in (("_i", "_srcs"), ("_j", "_dsts"))]).where("_i > 1 OR _j > 1"))

    def blocks(rows: DataFrame, c: str, own: str, other: str) -> DataFrame:
        """Arrays of c by path and block, one for each block of the other side."""
        rows = rows.join(large, "path", "left").fillna(1, ["_i", "_j"]).withColumn(own, F.pmod(F.xxhash64(c), own))
        rows = rows.groupBy("path", "_i", "_j").agg(F.sort_array(F.collect_list(c)).alias(c))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))

    by = ["path", "_i", "_j"]
    runs = F.expr(f"transform(sequence(0, (size(src) - 1) div {RUN}), k -> slice(src, k * {RUN} + 1, {RUN}))")
    met = blocks(targets, "src", "_i", "_j").withColumn("src", runs).repartition(tasks, *by).join(blocks(names, "dst", "_j", "_i").repartition(tasks, *by), by)
    # Runs repeat for each name: files of the pairs stay small. Lambdas are not compiled, so a task holds the pairs of one run at a time, not of a block.
    met = met.select(F.expr("inline(flatten(transform(src, r -> transform(dst, d -> struct(r AS run, d AS dst)))))"))
    return met.select(F.explode("run").alias("src"), "dst").where("src <> dst").select("src", "dst", F.lit(0).alias("flags"))


def subclasses(supers: DataFrame, seeds: DataFrame, **how) -> DataFrame:
    """node_id of all below the seeds in supers (sub, super); a seed only if a cycle leads back to it."""
    down = supers.select(F.col("super").alias("src"), F.col("sub").alias("dst"), F.lit(0).alias("flags"))
    first = down.join(seeds.select(F.col("node_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("node_id")).distinct()
    return closure.reach(down, first, **how)
