"""Lookups by dotted name and path. Walk-back and subtree queries explode names into their prefixes, so that they are equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.names import parent_name, prefixes


def named(nodes: DataFrame) -> DataFrame:
    """Nodes that the name tables hold: no type aliases, no externals."""
    return nodes.where(~F.col("kind").isin("type_alias", "external"))


def _walk(names: DataFrame) -> DataFrame:
    """name, rank (0: the name itself) and prefix."""
    return names.select("name").distinct().select("name", F.posexplode(prefixes(F.col("name"))).alias("rank", "prefix"))


def find_declarations(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, node_id): all declarations of the longest prefix of name that has any; modules are none."""
    decls = named(nodes).where("kind <> 'module'").select(F.col("fqname").alias("prefix"), "node_id")
    hits = _walk(names).join(decls, "prefix")
    best = hits.groupBy("name").agg(F.min("rank").alias("rank"))
    return hits.join(best, ["name", "rank"]).select("name", "node_id")


def last_modules(nodes: DataFrame) -> DataFrame:
    """(fqname, node_id): of modules with one name, the last."""
    return nodes.where("kind = 'module'").groupBy("fqname").agg(F.max("node_id").alias("node_id"))


def resolve(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, node_id): at the longest prefix that is a declaration (the first one) or else a module (the last)."""
    decls = named(nodes).where("kind <> 'module'").groupBy("fqname").agg(F.min("node_id").alias("node_id")).withColumn("is_module", F.lit(0))
    both = decls.unionByName(last_modules(nodes).withColumn("is_module", F.lit(1))).withColumnRenamed("fqname", "prefix")
    hits = _walk(names).join(both, "prefix")
    return hits.groupBy("name").agg(F.min(F.struct("rank", "is_module", "node_id")).alias("best")).select("name", F.col("best.node_id").alias("node_id"))


def modules_for_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(ordinal, path, node_id) for rows (ordinal, path); null where no module lies there."""
    own = nodes.where("kind = 'module'").groupBy("path").agg(F.max("node_id").alias("node_id"))
    return paths.join(own, "path", "left").select("ordinal", "path", "node_id")


def module_top_level(nodes: DataFrame, fqname: str) -> DataFrame:
    """What a module holds one level below it, without modules."""
    return named(nodes).where((parent_name(F.col("fqname")) == fqname) & (F.col("kind") != "module"))


def module_surfaces(nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, node_id): all that stands under each of modules (module: a name) by its dotted name, the module included."""
    subtree = named(nodes).select("node_id", F.explode(prefixes(F.col("fqname"))).alias("module"))
    present = modules.select("module").distinct().join(last_modules(nodes).select(F.col("fqname").alias("module")), "module", "left_semi")
    return subtree.join(present, "module").select("module", "node_id").distinct()


def module_surface(nodes: DataFrame, fqname: str, most_depth: int = 100) -> DataFrame:
    """node_id of a module and what it holds, going on into modules alone: a gap in the modules' names ends the way."""
    tree = named(nodes).select("node_id", "fqname", "kind", parent_name(F.col("fqname")).alias("parent"))
    level = last_modules(nodes).where(F.col("fqname") == fqname).select("node_id", "fqname")
    out = level.select("node_id")
    for _ in range(most_depth):
        below = tree.join(level.select(F.col("fqname").alias("parent")), "parent")
        level = below.where("kind = 'module'").select("node_id", "fqname")
        out = out.unionByName(below.select("node_id"))
        if level.isEmpty():
            return out.distinct()
    raise RuntimeError("modules nest too deep")


def imports_of(nodes: DataFrame, module: str) -> DataFrame:
    """Import nodes of a module or of one below it, bounded by the dot."""
    own = F.col("import.module")
    return nodes.where((F.col("kind") == "import") & ((own == module) | own.startswith(f"{module}.")))


def has_imports_of(nodes: DataFrame, module: str) -> bool:
    return not imports_of(nodes, module).isEmpty()


def first_variables(nodes: DataFrame) -> DataFrame:
    """The first variable of each path and simple name."""
    name = F.substring_index("fqname", ".", -1)
    first = W.partitionBy("path", "name").orderBy("node_id")
    return nodes.where("kind = 'variable'").withColumn("name", name).withColumn("_i", F.row_number().over(first)).where("_i = 1").drop("_i")


def children_by_parent(nodes: DataFrame) -> DataFrame:
    """(parent, children): the ids below each dotted name, ascending."""
    return named(nodes).groupBy(parent_name(F.col("fqname")).alias("parent")).agg(F.array_sort(F.collect_list("node_id")).alias("children"))


def dense_ids(nodes: DataFrame) -> DataFrame:
    """(node_id, dense_id): positions by path, then id; a prefix sum over paths and a rank within each."""
    per = nodes.groupBy("path").agg(F.count("*").alias("n"))
    base = per.select("path", F.coalesce(F.sum("n").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = W.partitionBy("path").orderBy("node_id")
    return nodes.select("node_id", "path", (F.row_number().over(own) - 1).alias("i")).join(base, "path").select("node_id", (F.col("base") + F.col("i")).alias("dense_id"))
