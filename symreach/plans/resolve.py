"""From per-file rows to a graph: references meet modules and exports in joins.

Names are resolved in rounds, each a few equi-joins: a reference stands at a module with the rest of its
chain; it goes to a submodule, to an export (and through star re-exports to where that is declared), or ends."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schema as S
from ..graph import SymbolGraph
from ..operators.closure import Beside, cut, scratch
from ..registry import FlagRegistry
from ..sources.extract import extract
from ..sources.files import named_modules, python_text, stdlib

ROWS = "row string, path string, module string, package boolean, idx int, name string, kind string, start_line int, start_column int, end_line int, end_column int, flags long, imp_module string, imp_decl string, imp_star boolean, target int, chain array<string>, value string"
MOST_STARS = 256
#: Parsed rows for each batch that leaves a task, and the least tasks that parse for each core.
AT_ONCE, TASKS = 20_000, 4


def _parse(batches):
    names = [x.strip().split(" ")[0] for x in ROWS.split(",")]

    def frame(out):
        d = pd.DataFrame(out, columns=names)
        for c in ("idx", "start_line", "start_column", "end_line", "end_column", "flags", "target"):
            d[c] = d[c].astype("Int64")
        return d

    for pdf in batches:
        out = []
        for path, module, package, content, notebook in zip(pdf["path"], pdf["module"], pdf["package"], pdf["content"], pdf["notebook"]):
            f = extract(content or "", module, bool(package))
            head = (path, module, bool(package))
            none = (None,) * 5
            for i, n in enumerate(f.nodes):
                imp = n.imported or (None, None, None)
                out.append(("node", *head, i, n.name, n.kind, n.line, n.column, n.end_line, n.end_column, n.flags | (S.NOTEBOOK if notebook else 0), *imp, None, None, n.bound))
            for r in f.refs:
                out.append(("ref", *head, r.src, None, r.kind, *none[:4], r.flags, r.module, r.decl, r.star, r.target, list(r.names if r.kind == "dynamic" else r.chain), None))
            for name, nodes in f.exports.items():
                for i in nodes:
                    out.append(("export", *head, i, name, None, *none[:4], 0, None, None, None, None, None, None))
            for i, module_ in f.stars:
                out.append(("star", *head, i, module_, None, *none[:4], 0, None, None, None, None, None, None))
            for topic, i, value in f.facts:
                out.append(("fact", *head, i, topic, None, *none[:4], 0, None, None, None, None, None, value))
            if f.error:
                out.append(("error", *head, 0, None, None, *none[:4], 0, None, None, None, None, None, f.error))
            if len(out) >= AT_ONCE:
                yield frame(out)
                out = []
        yield frame(out)


def parse(files: DataFrame, paths: list[str]) -> DataFrame:
    """Tagged rows of all files, written once, each tag's in a folder of its own: whoever asks for one reads no other. Files are dealt out first: a table of many small ones may come as one partition."""
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS * spark.sparkContext.defaultParallelism)
    rows = python_text(named_modules(files, paths)).select("path", "module", "package", "content", "notebook").repartition(tasks, "path").mapInPandas(_parse, ROWS)
    path = scratch(spark)
    rows.write.partitionBy("row").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Found:
    """Edges as they are found, each part written by itself, beside other jobs, so that no plan holds the joins of several parts."""

    def __init__(self, spark, beside: Beside):
        self.spark, self.beside, self.schema = spark, beside, "src long, dst long, flags int"
        self.parts = []

    def add(self, edges: DataFrame, loops: bool = False) -> None:
        """Edges src, dst, flags; those from a node to itself only with loops."""
        e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("flags").cast("int").alias("flags"))
        path = scratch(self.spark)
        self.parts.append((path, self.beside.start(lambda: (e if loops else e.where("src <> dst")).write.parquet(path))))

    def all(self) -> DataFrame:
        for _, written in self.parts:
            written.result()
        return self.spark.read.schema(self.schema).parquet(*[path for path, _ in self.parts]).dropDuplicates(["src", "dst", "flags"])


def star_names(rows: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, name, from_module, statement, shadowed): public names that star imports bring, through chains and cycles of them; shadowed by a name of the module's own."""
    stars = cut(rows.where("row = 'star'").select("module", F.col("name").alias("from_module"), F.col("idx").alias("statement")).join(modules.select(F.col("module").alias("from_module")), "from_module", "left_semi"))
    # Names of modules that neither have stars nor are brought by one play no part.
    near = stars.select("module").unionByName(stars.select(F.col("from_module").alias("module"))).distinct()
    own = cut(rows.where("row = 'export'").select("module", "name").where("NOT startswith(name, '_')").join(near, "module", "left_semi").distinct())
    known, size = own, -1
    for _ in range(MOST_STARS):
        more = stars.join(known.select(F.col("module").alias("from_module"), "name"), "from_module").select("module", "name", "from_module", "statement")
        more = cut(more.groupBy("module", "name").agg(F.max(F.struct("statement", "from_module")).alias("x")).select("module", "name", F.col("x.from_module").alias("from_module"), F.col("x.statement").alias("statement")))
        n = more.count()
        if n == size or not n:
            return more.join(own.withColumn("_own", F.lit(True)), ["module", "name"], "left").withColumn("shadowed", F.col("_own").isNotNull()).drop("_own")
        size, known = n, own.unionByName(more.select("module", "name")).distinct()
    raise RuntimeError("star imports chain too deep")


def build(files: DataFrame, paths: list[str], registry: FlagRegistry | None = None, dists: DataFrame | None = None, **how) -> SymbolGraph:
    """The graph of a source tree: files (path, content), search paths, distributions (top, dist)."""
    with Beside(files.sparkSession) as beside:
        return _build(beside, files, paths, registry, dists, **how)


def _build(beside: Beside, files: DataFrame, paths: list[str], registry: FlagRegistry | None, dists: DataFrame | None, **how) -> SymbolGraph:
    spark, cuts = files.sparkSession, beside.cuts
    rows = parse(files, paths)
    # Of a stub and its twin, the twin stands for the module.
    twin_path = F.when(~F.col("path").endswith(".pyi"), F.col("path"))
    nodes = rows.where("row = 'node'").select("path", "module", "idx", F.col("name").alias("fqname"), "kind", "start_line", "start_column", "end_line", "end_column", "flags", F.when(F.col("kind") == "import", F.struct(F.col("imp_module").alias("module"), F.col("imp_decl").alias("decl"), F.col("imp_star").alias("star"))).alias("import"), F.lit(None).cast("string").alias("star_name"))
    modules, per = cuts(
        rows.where("row = 'node' AND kind = 'module'").groupBy("module").agg(F.coalesce(F.max(twin_path), F.max("path")).alias("path"), F.max_by("package", "path").alias("package")),
        nodes.groupBy("path").agg(F.max("idx").alias("_last")),
    )
    stars = cut(star_names(rows, modules))

    at = nodes.where("import.star").select("module", F.col("idx").alias("statement"), "path", "start_line", "start_column", "end_line", "end_column")
    again = W.partitionBy("path").orderBy("statement", "name")
    minted = stars.join(at, ["module", "statement"]).join(per, "path").select("path", "module", (F.col("_last") + F.row_number().over(again)).cast("int").alias("idx"), F.concat_ws(".", "module", "name").alias("fqname"), F.lit("import").alias("kind"), "start_line", "start_column", "end_line", "end_column", F.lit(S.STAR_REEXPORT).cast("long").alias("flags"), F.struct(F.col("from_module").alias("module"), F.col("name").alias("decl"), F.lit(False).alias("star")).alias("import"), F.col("name").alias("star_name"), "statement")
    shadowed = stars.where("shadowed").select("module", F.col("name").alias("star_name"))
    minted = cut(minted)
    count = per.unionByName(minted.select("path", F.col("idx").alias("_last"))).groupBy("path").agg(F.max("_last").alias("_n"))
    base = cut(count.select("path", "_n", F.coalesce(F.sum(F.col("_n") + 1).over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base")))
    last, base = base.agg(F.coalesce(F.max(F.col("base") + F.col("_n") + 1), F.lit(0))).first()[0], base.drop("_n")
    node_id = (F.col("base") + F.col("idx")).cast("long")
    refs = rows.where("row = 'ref'").join(base, "path").select((F.col("base") + F.col("idx")).cast("long").alias("src"), F.col("kind").alias("role"), F.col("imp_module").alias("module"), F.col("imp_decl").alias("decl"), "imp_star", F.col("module").alias("own"), F.when(F.col("kind") == "local", (F.col("base") + F.col("target")).cast("long")).alias("local"), "chain", F.col("flags").cast("int").alias("flags"))
    facts = beside.start(lambda: cut(rows.where("row = 'fact'").join(base, "path").select(F.col("name").alias("topic"), "path", node_id.alias("node_id"), "value")))
    nodes, exports, refs = cuts(
        nodes.withColumn("statement", F.lit(None).cast("int")).unionByName(minted).join(base, "path").withColumn("node_id", node_id),
        rows.where("row = 'export'").join(base, "path").select("module", "path", "name", node_id.alias("node_id")).join(modules.select("module", "path"), ["module", "path"], "left_semi").drop("path"),
        refs,
    )
    found_edges = Found(spark, beside)
    put = found_edges.add
    put(refs.where("role = 'local'").select("src", F.col("local").alias("dst"), "flags"))

    # A module's own name comes before the node that a star makes for it.
    module_ids, shadow = cuts(
        nodes.where("kind = 'module'").join(modules, ["module", "path"]).select("module", F.col("node_id").alias("module_id"), "package"),
        nodes.where("star_name IS NOT NULL").join(shadowed, ["module", "star_name"], "left_anti").select("module", F.col("star_name").alias("name"), "node_id"),
    )
    # Structure: everything to its module, packages' members to them, stars' names to their statements.
    own_module = nodes.where("kind = 'module'").select("path", F.col("node_id").alias("dst"))
    put(nodes.where("kind <> 'module'").join(own_module, "path").select(F.col("node_id").alias("src"), "dst", F.lit(0).alias("flags")))
    parents = module_ids.where("package").select(F.col("module").alias("parent"), F.col("module_id").alias("dst"))
    put(nodes.where("kind = 'module' AND contains(fqname, '.')").withColumn("parent", F.regexp_extract("fqname", r"^(.*)[.][^.]*$", 1)).join(parents, "parent").select(F.col("node_id").alias("src"), "dst", F.lit(0).alias("flags")))
    statement = nodes.select("path", F.col("idx").alias("statement"), F.col("node_id").alias("dst"))
    put(nodes.where("star_name IS NOT NULL").select("path", "statement", F.col("node_id").alias("src")).join(statement, ["path", "statement"]).select("src", "dst", F.lit(0).alias("flags")))
    # An import goes through stars to the declaration; a use stops at the star's own node.
    real = exports.select("module", "name", "node_id")
    hops = stars.where("NOT shadowed").select("module", "name", "from_module")
    along = lambda names: hops.join(names.select(F.col("module").alias("from_module"), "name", "node_id"), ["from_module", "name"]).select("module", "name", "node_id").distinct()
    # Only what stars bring goes from round to round.
    deep = front = cut(along(real))
    for _ in range(MOST_STARS):
        if front.isEmpty():
            break
        front = cut(along(front).join(deep, ["module", "name", "node_id"], "left_anti"))
        deep = cut(deep.unionByName(front))
    else:
        raise RuntimeError("star imports chain too deep")

    # Member references: base module, then a declaration or submodule, then the chain.
    # An import from the file's own module binds nothing new.
    member = refs.where("role <> 'local' AND NOT (role = 'binding' AND module = own)").join(module_ids.select("module", "module_id"), "module", "left").withColumn("ref", F.monotonically_increasing_id())
    # Declarations that stand for modules: variables that a dynamic import makes, and imports of modules.
    made = rows.where("row = 'fact' AND name = 'denotes'").join(base, "path").select(node_id.alias("_node"), F.col("value").alias("_module"))
    bound_to = nodes.where("kind = 'import' AND NOT import.star").select(F.col("node_id").alias("_node"), F.when(F.col("import.decl").isNotNull(), F.concat_ws(".", "import.module", "import.decl")).when(F.substring_index("fqname", ".", -1) == F.split("import.module", "[.]")[0], F.split("import.module", "[.]")[0]).otherwise(F.col("import.module")).alias("_module"))
    for_binding, for_use, member, denotes = cuts(
        real.unionByName(deep).distinct(),
        exports.unionByName(shadow),
        member,
        made.unionByName(bound_to).join(module_ids.select(F.col("module").alias("_module"), F.col("module_id").alias("_module_id")), "_module"),
    )
    inside = member.where("module_id IS NOT NULL")
    put(inside.where("role IN ('binding', 'use') AND decl IS NULL AND imp_star = false AND (role = 'binding' OR size(chain) = 0)").select("src", F.col("module_id").alias("dst"), "flags"))
    put(inside.where("imp_star").select("src", F.col("module_id").alias("dst"), "flags"))
    sub = module_ids.select(F.col("module").alias("sub"), F.col("module_id").alias("sub_id"))

    def step(found: DataFrame, name, names: DataFrame, prefer_name: bool):
        """found (ref, src, flags, module, module_id, chain) one segment on: edges, and what stands at submodules."""
        asked = found.withColumn("_name", name).withColumn("sub", F.concat_ws(".", "module", "_name")).join(sub, "sub", "left")
        has = names.select(F.col("module"), F.col("name").alias("_name"), F.col("node_id").alias("_node"))
        asked = cut(asked.join(has, ["module", "_name"], "left"))
        goes = F.col("sub_id").isNotNull() & (F.col("_node").isNull() if prefer_name else F.lit(True))
        ended = asked.where(~goes)
        hit = ended.select("src", F.col("module_id").alias("dst"), "flags").unionByName(ended.where("_node IS NOT NULL").select("src", F.col("_node").alias("dst"), "flags"))
        on = asked.where(goes).dropDuplicates(["ref"]).select("ref", "role", "src", "flags", F.col("sub").alias("module"), F.col("sub_id").alias("module_id"), "chain")
        # What stands for a module passes the rest of the chain on to it.
        through = ended.where("_node IS NOT NULL AND role = 'use' AND size(chain) > 0").join(denotes, "_node")
        on = cut(on.unionByName(through.select("ref", "role", "src", "flags", F.col("_module").alias("module"), F.col("_module_id").alias("module_id"), "chain")))
        lost = ended.where("_node IS NULL").select("ref", "src", "role")
        return hit, on, lost

    bound = inside.where("role = 'binding' AND decl IS NOT NULL")
    used = inside.where("role = 'use' AND decl IS NOT NULL")
    first = beside.start(lambda: step(used, F.col("decl"), for_use, False))
    hit, on, lost = step(bound, F.col("decl"), for_binding, True)
    put(on.select("src", F.col("module_id").alias("dst"), "flags"))
    # A binding that a circle of stars leads back to itself keeps its loop; no other edge does.
    put(hit, loops=True)
    unresolved = [lost.select(F.col("src").alias("node_id"))]
    hit, on, _ = first.result()
    put(hit)
    walking = inside.where("role = 'use' AND decl IS NULL AND size(chain) > 0").select("ref", "role", "src", "flags", "module", "module_id", "chain").unionByName(on)
    while not walking.isEmpty():
        put(walking.where("size(chain) = 0").select("src", F.col("module_id").alias("dst"), "flags"))
        more = walking.where("size(chain) > 0").withColumn("_head", F.get("chain", F.lit(0))).withColumn("chain", F.expr("slice(chain, 2, greatest(size(chain) - 1, 0))"))
        hit, on, _ = step(more, F.col("_head"), for_use, False)
        put(hit)
        walking = on
    # A name that a star import brings: its node in the module, the declaration that it comes from and that one's module.
    starred = cut(inside.where("role = 'starred'").select("src", "flags", "module", F.col("decl").alias("name")))
    brought = cut(starred.join(hops, ["module", "name"]).select("src", "flags", F.col("from_module").alias("module"), "name").join(for_binding, ["module", "name"]).select("src", F.col("node_id").alias("dst"), "flags"))
    at_home = nodes.select(F.col("node_id").alias("dst"), "module").join(module_ids.select("module", "module_id"), "module")
    put(starred.join(shadow, ["module", "name"]).select("src", F.col("node_id").alias("dst"), "flags"))
    put(brought)
    put(brought.join(at_home, "dst").select("src", F.col("module_id").alias("dst"), "flags"))
    dynamic = inside.where("role = 'dynamic'")
    put(dynamic.select("src", F.col("module_id").alias("dst"), "flags"))
    hit, on, _ = step(cut(dynamic.withColumn("_each", F.explode("chain")).withColumn("ref", F.monotonically_increasing_id())), F.col("_each"), for_use, False)
    put(hit)
    put(on.select("src", F.col("module_id").alias("dst"), "flags"))

    # Outside the project: the standard library is silent, distributions are externals, the rest is unresolved.
    std = spark.createDataFrame([(x,) for x in stdlib()], "top string")
    outside = member.where("module_id IS NULL").withColumn("top", F.split("module", "[.]")[0]).join(F.broadcast(std), "top", "left_anti")
    dists = dists if dists is not None else spark.createDataFrame([], "top string, dist string")
    outside = cut(outside.join(dists, "top", "left"))
    unresolved.append(outside.where("dist IS NULL AND role = 'binding'").select(F.col("src").alias("node_id")))
    externals = outside.where("dist IS NOT NULL").groupBy("dist").agg(F.min("top").alias("path")).withColumn("fqname", F.concat(F.lit("[external dist] "), "dist"))
    externals = cut(externals.withColumn("node_id", (F.row_number().over(W.orderBy("fqname")) - 1 + F.lit(last)).cast("long")))
    put(outside.where("dist IS NOT NULL").join(externals.select("dist", F.col("node_id").alias("dst")), "dist").select("src", "dst", "flags"))

    # Stubs: a declaration to its twin's export of that name; without one it is an entry point.
    stem = F.regexp_replace("path", "[.]pyi?$", "")
    stub = nodes.where("endswith(path, '.pyi') AND kind <> 'module'").select("node_id", stem.alias("stem"), F.substring_index("fqname", ".", -1).alias("name"))
    twin = rows.where("row = 'export' AND endswith(path, '.py')").join(base, "path").select(stem.alias("stem"), "name", node_id.alias("dst"))
    paired = rows.where("row = 'node' AND kind = 'module' AND endswith(path, '.py')").select(stem.alias("stem"))
    put(stub.join(twin, ["stem", "name"]).select(F.col("node_id").alias("src"), "dst", F.lit(0).alias("flags")))
    only = stub.join(paired, "stem", "left_semi").join(twin, ["stem", "name"], "left_anti").select("node_id", F.lit(S.ENTRYPOINT).cast("long").alias("bits"))

    all_edges = found_edges.all()
    bits = _union(*[u.select("node_id", F.lit(S.UNRESOLVED).cast("long").alias("bits")) for u in unresolved], only).groupBy("node_id").agg(F.bit_or("bits").alias("_bits"))
    columns = [f.name for f in S.NODES.fields]
    final = nodes.join(bits, "node_id", "left").withColumn("flags", F.col("flags").bitwiseOR(F.coalesce("_bits", F.lit(0).cast("long")))).select(*columns)
    outer = externals.select("node_id", "fqname", F.lit("external").alias("kind"), "path", *[F.lit(0).alias(c) for c in ("start_line", "start_column", "end_line", "end_column")], F.lit(0).cast("long").alias("flags"), F.lit(None).cast(S.IMPORT).alias("import"))
    graph = SymbolGraph(*cuts(final.unionByName(outer), all_edges), registry, **how)
    graph.facts = facts.result()
    graph.errors = rows.where("row = 'error'").select("path", F.col("value").alias("error"))
    return graph


def edge_names(graph: SymbolGraph) -> set[str]:
    """'a -> b' for each edge, by names; for tests and reports."""
    n = graph.nodes.select("node_id", "fqname")
    e = graph.edges.join(n.select(F.col("node_id").alias("src"), F.col("fqname").alias("a")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("fqname").alias("b")), "dst")
    return {f"{r['a']} -> {r['b']}" for r in e.select("a", "b").distinct().collect()}
