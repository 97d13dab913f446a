"""A query for each relational operator, over the graph views, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.names import simple_name
from ..operators import closure, filters, lookups, stats
from ..plans.plugins import GraphView, Ops, apply_ops, dispatch_edges, dynamic_fanout, fixture_edges, subclasses
from ..streaming.incremental import dirty_files, latest_state, retranslate
from . import trees
from .tables import ASKED_CTE, CTE, NAMES_CTE, STEPS_CTE, asked_names, document_names, graph, registry, table, user_steps

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _reach(name: str, seeds: str, edges: str = "edges", where: str = "TRUE", src: str = "src", dst: str = "dst") -> str:
    """A recursive closure named name, from seeds (a query of ids)."""
    return f"{name} AS (SELECT id FROM ({seeds}) UNION SELECT e.{dst} FROM {name} JOIN {edges} e ON e.{src} = {name}.id WHERE {where})"


def _with(*parts: str) -> str:
    return f"WITH RECURSIVE {CTE}, " + ", ".join(parts) + " "


DEFAULT = "SELECT node_id AS id FROM nodes WHERE flags & 306 <> 0"
_R = _reach("r", DEFAULT)
DECLS = "('function', 'class', 'variable', 'import', 'type_alias')"


# --- closures and their differences ---------------------------------------------------------------------------

@query(_with(_R) + "SELECT id AS node_id FROM r")
def reachable_default(spark, d):
    return graph(spark, d).reachable()


@query(_with(_reach("r", "SELECT node_id AS id FROM nodes WHERE flags & 2 <> 0")) + "SELECT id AS node_id FROM r")
def reachable_entrypoint(spark, d):
    return graph(spark, d).reachable(2)


@query(_with(_reach("r", DEFAULT, where="e.flags & 1 = 0")) + "SELECT id AS node_id FROM r")
def reachable_skip_dead_branch(spark, d):
    return graph(spark, d).reachable(skip_flags=1)


@query(_with(_R) + "SELECT id AS node_id FROM r")
def reachable_distributed(spark, d):
    """The same closure by rounds of joins."""
    return graph(spark, d, local_edges=0).reachable()


@query(_with(_R) + f"SELECT node_id, fqname, kind, path FROM nodes WHERE kind IN {DECLS} AND node_id NOT IN (SELECT id FROM r)")
def dead_api(spark, d):
    return graph(spark, d).dead().select("node_id", "fqname", "kind", "path")


@query(_with(_R) + "SELECT node_id, fqname, kind, path FROM nodes WHERE node_id NOT IN (SELECT id FROM r)")
def dead_cli(spark, d):
    return graph(spark, d).dead_all().select("node_id", "fqname", "kind", "path")


@query(_with(_R) + "SELECT kind, count(*) AS total, CAST(sum(CASE WHEN node_id IN (SELECT id FROM r) THEN 0 ELSE 1 END) AS BIGINT) AS dead FROM nodes GROUP BY kind")
def dead_count_by_kind(spark, d):
    g = graph(spark, d)
    return stats.by_kind(g.nodes, g.dead_all())


@query(_with(_R, _reach("s", DEFAULT, where="e.flags & 1 = 0")) + "SELECT id AS node_id FROM r EXCEPT SELECT id FROM s")
def kept_alive_by_dead_branch(spark, d):
    return graph(spark, d).kept_alive_by_dead_branches().select("node_id")


@query(_with(_R, _reach("s", "SELECT node_id AS id FROM nodes WHERE flags & 290 <> 0")) + "SELECT id AS node_id FROM r EXCEPT SELECT id FROM s")
def kept_alive_by_flags_16(spark, d):
    return graph(spark, d).kept_alive_by_flags_only(16).select("node_id")


@query(_with(_R, _reach("s", "SELECT node_id AS id FROM nodes WHERE flags & 50 <> 0")) + "SELECT id AS node_id FROM r EXCEPT SELECT id FROM s")
def test_only(spark, d):
    return graph(spark, d).test_only().select("node_id")


_D6 = (
    _reach("prod", "SELECT node_id AS id FROM nodes WHERE flags & 306 <> 0 AND flags & 256 = 0"),
    "layered AS (SELECT dst * 2 AS src, src * 2 AS dst FROM edges JOIN nodes ON node_id = src WHERE kind <> 'module' UNION SELECT src * 2 + 1, dst * 2 + 1 FROM edges JOIN nodes ON node_id = src WHERE kind <> 'module' UNION SELECT node_id * 2, node_id * 2 + 1 FROM nodes WHERE flags & 256 <> 0 UNION SELECT node_id * 2 + 1, node_id * 2 FROM nodes WHERE kind IN ('function', 'class', 'variable', 'type_alias'))",
    _reach("live", "SELECT node_id * 2 AS id FROM nodes WHERE kind IN ('function', 'class', 'variable', 'type_alias') AND node_id IN (SELECT id FROM prod)", "layered"),
    "gone AS (SELECT node_id FROM nodes WHERE flags & 256 <> 0 AND node_id * 2 NOT IN (SELECT id FROM live))",
    _R,
    _reach("s", "SELECT node_id AS id FROM nodes WHERE flags & 306 <> 0 AND node_id NOT IN (SELECT node_id FROM gone)"),
)


@query(_with(*_D6) + "SELECT id AS node_id FROM r EXCEPT SELECT id FROM s")
def dead_tests(spark, d):
    return graph(spark, d).dead_tests().select("node_id")


@query(_with(_reach("r", "SELECT max(node_id) AS id FROM nodes WHERE kind = 'function'")) + "SELECT id AS node_id FROM r")
def descendants_of(spark, d):
    g = graph(spark, d)
    return g.descendants(g.nodes.where("kind = 'function'").agg(F.max("node_id")).first()[0])


@query(_with(_reach("r", "SELECT 1003 AS id", src="dst", dst="src")) + "SELECT id AS node_id FROM r")
def ancestors_of(spark, d):
    return graph(spark, d).ancestors(1003)


@query(_with("one AS (SELECT 1)") + "SELECT DISTINCT src AS node_id FROM edges WHERE dst = 1003")
def predecessors_of(spark, d):
    return graph(spark, d).direct_predecessors(1003)


@query(f"WITH RECURSIVE {STEPS_CTE}, " + _reach("r", "SELECT min(src) AS id FROM steps", "steps", "e.flags & 1 = 0") + " SELECT id AS node_id FROM r")
def reachable_cyclic_users(spark, d):
    s = user_steps(spark, d)
    return closure.reach(s, s.agg(F.min("src").alias("node_id")), 1)


@query("WITH RECURSIVE links AS (SELECT conv_id * 1000 + turn AS src, conv_id * 1000 + turn - 1 AS dst FROM conversations WHERE turn > 0), r AS (SELECT conv_id * 1000 + turn AS id FROM conversations WHERE turn = 3 UNION SELECT l.dst FROM r JOIN links l ON l.src = r.id) SELECT id AS node_id FROM r")
def chain_depth(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node_id"), "turn")
    links = c.where("turn > 0").select(F.col("node_id").alias("src"), (F.col("node_id") - 1).alias("dst"), F.lit(0).alias("flags"))
    return closure.reach(links, c.where("turn = 3"))


@query(_with("open AS (SELECT e.* FROM edges e JOIN nodes ON node_id = src WHERE kind <> 'class' OR flags & 2 <> 0)".replace("flags & 2", "nodes.flags & 2"), _reach("r", "SELECT node_id AS id FROM nodes WHERE flags & 2 <> 0", "open")) + "SELECT id AS node_id FROM r")
def expand_stop_classes(spark, d):
    g = graph(spark, d)
    return g.reachable_expanding(g.seeds(2), ["class"])


# --- filters ----------------------------------------------------------------------------------------------

def _nodes_where(condition: str, columns: str = "node_id, fqname, kind") -> str:
    return f"WITH {CTE} SELECT {columns} FROM nodes WHERE {condition}"


def _picked(df: DataFrame) -> DataFrame:
    return df.select("node_id", "fqname", "kind")


@query(_nodes_where("kind IN ('class', 'module')"))
def where_kind(spark, d):
    return _picked(filters.where(graph(spark, d).nodes, kinds=["class", "module"]))


@query(_nodes_where("path IN ('/w/region1/nation3.py', '/w/orders/c7.py')"))
def where_path(spark, d):
    return _picked(filters.where(graph(spark, d).nodes, paths=["/w/region1/nation3.py", "/w/orders/c7.py"]))


@query(_nodes_where("regexp_extract(path, '[^/]*$') IN ('__init__.py', 'c7.py')"))
def where_basename(spark, d):
    return _picked(filters.where(graph(spark, d).nodes, basenames=["__init__.py", "c7.py"]))


@query(_nodes_where("flags & 18 = 2"))
def where_flags_all(spark, d):
    return _picked(filters.where(graph(spark, d).nodes, flags_all=2).where("flags & 16 = 0"))


@query(_nodes_where("flags & 272 <> 0"))
def where_flags_any(spark, d):
    return _picked(filters.where(graph(spark, d).nodes, flags_any=272))


@query(_nodes_where("starts_with(fqname, 'region1')"))
def where_prefix(spark, d):
    return _picked(filters.where(graph(spark, d).nodes, prefix="region1"))


@query(_nodes_where("regexp_extract(fqname, '[^.]*$') IN ('part7', 'nation3', 'order65')"))
def where_simple_name(spark, d):
    return _picked(filters.where(graph(spark, d).nodes, names=["part7", "nation3", "order65"]))


@query(_nodes_where("regexp_matches(path, 'c[0-3]+[.]py')"))
def where_path_regex(spark, d):
    return _picked(filters.where(graph(spark, d).nodes, path_regex="c[0-3]+[.]py"))


@query(_nodes_where("kind = 'function' AND flags & 18 <> 0 AND regexp_matches(path, 'orders') AND starts_with(fqname, 'orders.c1')"))
def where_combined(spark, d):
    return _picked(filters.where(graph(spark, d).nodes, kinds=["function"], flags_any=18, path_regex="orders", prefix="orders.c1"))


@query(_nodes_where("path = '/w/orders/c3.py' OR fqname = 'region1' OR regexp_matches(substr(path, 4), '^(?:parts/brand1)')"))
def spec_match(spark, d):
    return _picked(filters.matching_specs(graph(spark, d).nodes, "/w", regexes=["parts/brand1"], exact=["orders/c3.py", "region1"]))


@query(_nodes_where("kind IN ('variable', 'function') AND regexp_matches(regexp_extract(fqname, '[^.]*$'), '^__.+__$')"))
def dunder_names(spark, d):
    return _picked(filters.module_dunders(graph(spark, d).nodes))


@query(_nodes_where("starts_with(path, '/w/parts')"))
def decls_under(spark, d):
    return _picked(filters.decls_under(graph(spark, d).nodes, "/w/parts"))


@query(_nodes_where("contains(path, 'nation1')"))
def decls_matching(spark, d):
    return _picked(filters.decls_matching(graph(spark, d).nodes, "nation1"))


@query(_nodes_where(f"regexp_matches(regexp_extract(fqname, '[^.]*$'), 'er1.$') AND kind IN {DECLS}"))
def decls_matching_name(spark, d):
    return _picked(filters.decls_matching_name(graph(spark, d).nodes, "er1.$"))


@query(f"WITH {CTE} SELECT DISTINCT src, dst, edges.flags AS flags FROM edges JOIN nodes ON node_id = dst WHERE edges.flags & 3 <> 0 AND kind = 'class'")
def edges_dynamic(spark, d):
    g = graph(spark, d)
    return filters.edges_where(g.edges, g.nodes, 3, ["class"])


@query(f"WITH {CTE} SELECT CAST(ordinal AS INT) AS ordinal, nodes.node_id AS node_id, fqname FROM (VALUES (0, 1003), (1, 2), (2, 10000001), (3, 1003)) t(ordinal, node_id) JOIN nodes ON nodes.node_id = t.node_id")
def nodes_at(spark, d):
    return filters.nodes_at(graph(spark, d).nodes, [1003, 2, 10000001, 1003]).select("ordinal", "node_id", "fqname")


@query(f"WITH {CTE} SELECT node_id, kind, path, fqname, flags FROM nodes")
def node_attrs(spark, d):
    return graph(spark, d).nodes.select("node_id", "kind", "path", "fqname", "flags")


# --- lookups -------------------------------------------------------------------------------------------------

_LOOK = f"WITH {NAMES_CTE}, {ASKED_CTE}, decls AS (SELECT * FROM names WHERE kind NOT IN ('type_alias', 'module')), mods AS (SELECT fqname, max(node_id) AS node_id FROM names WHERE kind = 'module' GROUP BY fqname) "


@query(_LOOK + ", hits AS (SELECT name, rank, node_id FROM walk JOIN decls ON fqname = prefix) SELECT name, node_id FROM (SELECT *, min(rank) OVER (PARTITION BY name) AS best FROM hits) WHERE rank = best")
def find_declarations_bucket(spark, d):
    return lookups.find_declarations(document_names(spark, d), asked_names(spark, d))


@query(_LOOK + ", hits AS (SELECT name, rank, 0 AS m, node_id FROM walk JOIN decls ON fqname = prefix UNION ALL SELECT name, rank, 1, node_id FROM walk JOIN mods ON fqname = prefix) SELECT name, node_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank, m, node_id) AS i FROM hits) WHERE i = 1")
def resolve_walkback(spark, d):
    return lookups.resolve(document_names(spark, d), asked_names(spark, d))


@query(f"WITH {NAMES_CTE} SELECT fqname, max(node_id) AS node_id FROM names WHERE kind = 'module' GROUP BY fqname")
def last_module_per_name(spark, d):
    return lookups.last_modules(document_names(spark, d))


@query(f"WITH {NAMES_CTE}, own AS (SELECT path, max(node_id) AS node_id FROM names WHERE kind = 'module' GROUP BY path), asked AS (SELECT CAST(row_number() OVER (ORDER BY source) AS INT) AS ordinal, '/d/en/' || source || '.py' AS path FROM (SELECT DISTINCT source FROM documents)) SELECT ordinal, asked.path AS path, node_id FROM asked LEFT JOIN own ON own.path = asked.path")
def modules_for_paths(spark, d):
    asked = table(spark, d, "documents").select("source").distinct().select(F.row_number().over(W.orderBy("source")).alias("ordinal"), F.concat(F.lit("/d/en/"), "source", F.lit(".py")).alias("path"))
    return lookups.modules_for_paths(document_names(spark, d), asked)


@query(f"WITH {NAMES_CTE} SELECT node_id FROM names WHERE kind NOT IN ('type_alias', 'module') AND regexp_replace(fqname, '[.][^.]*$', '') = 'en.src1'")
def module_top_level(spark, d):
    return lookups.module_top_level(document_names(spark, d), "en.src1").select("node_id")


@query(f"WITH {NAMES_CTE} SELECT m.fqname AS module, n.node_id AS node_id FROM (SELECT DISTINCT fqname FROM names WHERE kind = 'module' AND fqname LIKE 'd%') m JOIN names n ON (n.fqname = m.fqname OR starts_with(n.fqname, m.fqname || '.')) WHERE n.kind <> 'type_alias'")
def module_surfaces_bulk(spark, d):
    n = document_names(spark, d)
    return lookups.module_surfaces(n, n.where("kind = 'module' AND fqname LIKE 'd%'").select(F.col("fqname").alias("module")))


@query(f"WITH RECURSIVE {NAMES_CTE}, known AS (SELECT *, CASE WHEN contains(fqname, '.') THEN regexp_replace(fqname, '[.][^.]*$', '') ELSE '' END AS parent FROM names WHERE kind <> 'type_alias'), r AS (SELECT node_id, fqname, kind FROM (SELECT * FROM known WHERE kind = 'module' AND fqname = 'fr' ORDER BY node_id DESC LIMIT 1) UNION SELECT k.node_id, k.fqname, k.kind FROM r JOIN known k ON k.parent = r.fqname WHERE r.kind = 'module') SELECT DISTINCT node_id FROM r")
def module_surface(spark, d):
    return lookups.module_surface(document_names(spark, d), "fr")


@query("SELECT c_custkey AS node_id FROM customer WHERE 'pkg' || c_nationkey = 'pkg1' OR starts_with('pkg' || c_nationkey || '.m', 'pkg1.')")
def imports_of(spark, d):
    c = table(spark, d, "customer")
    n = c.select(F.col("c_custkey").alias("node_id"), F.lit("import").alias("kind"), F.struct(F.concat(F.lit("pkg"), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, ".m").otherwise("")).alias("module")).alias("import"))
    return lookups.imports_of(n, "pkg1").select("node_id")


@query(f"WITH {CTE} SELECT path, regexp_extract(fqname, '[^.]*$') AS name, min(node_id) AS node_id FROM nodes WHERE kind = 'variable' GROUP BY 1, 2")
def first_var_per_file(spark, d):
    return lookups.first_variables(graph(spark, d).nodes).select("path", "name", "node_id")


@query(f"WITH {CTE} SELECT parent, CAST(count(*) AS BIGINT) AS n, CAST(min(node_id) AS BIGINT) AS least FROM (SELECT node_id, CASE WHEN contains(fqname, '.') THEN regexp_replace(fqname, '[.][^.]*$', '') ELSE '' END AS parent FROM nodes) GROUP BY parent")
def children_by_parent(spark, d):
    c = lookups.children_by_parent(graph(spark, d).nodes)
    return c.select("parent", F.size("children").cast("long").alias("n"), F.element_at("children", 1).alias("least"))


@query(f"WITH {CTE} SELECT node_id, row_number() OVER (ORDER BY path, node_id) - 1 AS dense_id FROM nodes")
def dense_ids(spark, d):
    return lookups.dense_ids(graph(spark, d).nodes)


# --- aggregations and set operations ----------------------------------------------------------------------------

@query("SELECT CAST(306 AS BIGINT) AS seed_mask")
def seed_mask(spark, d):
    return stats.seed_mask(registry().to_df(spark))


@query(f"WITH {CTE}, ops AS (SELECT src AS node_id, CAST(256 AS BIGINT) AS bits FROM edges WHERE flags = 1 UNION ALL SELECT dst, CAST(512 AS BIGINT) FROM edges WHERE flags = 1) SELECT nodes.node_id AS node_id, nodes.flags | coalesce(b, 0) AS flags FROM nodes LEFT JOIN (SELECT node_id, bit_or(bits) AS b FROM ops GROUP BY node_id) o ON o.node_id = nodes.node_id")
def flag_or_fold(spark, d):
    g = graph(spark, d)
    hot = g.edges.where("flags = 1")
    ops = [Ops(flags=hot.select(F.col("src").alias("node_id"), F.lit(256).cast("long").alias("bits"))), Ops(flags=hot.select(F.col("dst").alias("node_id"), F.lit(512).cast("long").alias("bits")))]
    return apply_ops(g, ops).nodes.select("node_id", "flags")


@query(f"WITH {CTE} SELECT src, dst, flags FROM edges UNION SELECT dst, src, 8 FROM edges WHERE flags = 2 UNION SELECT src, dst, flags FROM edges WHERE flags = 0")
def edge_union_distinct(spark, d):
    g = graph(spark, d)
    more = [Ops(edges=g.edges.where("flags = 2").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(8).alias("flags"))), Ops(edges=g.edges.where("flags = 0"))]
    return apply_ops(g, more).edges.select("src", "dst", F.col("flags").cast("int").alias("flags"))


@query("SELECT '[external dist] ' || lower(regexp_replace(p_brand, '[-_.#]+', '-', 'g')) AS fqname, min(p_type || '/' || p_name) AS path FROM part GROUP BY 1")
def external_dedup(spark, d):
    p = table(spark, d, "part")
    name = F.concat(F.lit("[external dist] "), F.lower(F.regexp_replace("p_brand", "[-_.#]+", "-")))
    return p.groupBy(name.alias("fqname")).agg(F.min(F.concat_ws("/", "p_type", "p_name")).alias("path"))


@query(f"WITH {CTE}, f AS (SELECT path, max(start_line) AS last FROM nodes GROUP BY path) SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, count(*) AS file_count, CAST(sum(last) AS BIGINT) AS line_count FROM f")
def graph_stats(spark, d):
    g = graph(spark, d)
    return stats.graph_stats(g.nodes.withColumn("end_line", F.col("start_line")), g.edges)


@query(f"WITH {CTE} SELECT degree, count(*) AS n FROM (SELECT dst, count(*) AS degree FROM edges GROUP BY dst) GROUP BY degree")
def dst_histogram(spark, d):
    return stats.dst_histogram(graph(spark, d).edges)


@query()
def surface_fingerprint(spark, d):
    n = graph(spark, d).nodes
    return stats.surface_fingerprint(n.select("path", simple_name(F.col("fqname")).alias("name"), F.col("node_id").alias("target")))


# --- plug-in plans ---------------------------------------------------------------------------------------------

@query(f"WITH {CTE}, params AS (SELECT 1000000000 + l_orderkey AS node_id, 'part' || (l_partkey % 50) AS name FROM lineitem), fixtures AS (SELECT node_id, regexp_extract(fqname, '[^.]*$') AS name FROM nodes WHERE kind = 'variable' AND start_line < 100) SELECT DISTINCT p.node_id AS src, f.node_id AS dst, CAST(0 AS INT) AS flags FROM params p JOIN nodes t ON t.node_id = p.node_id AND t.flags & 256 <> 0 JOIN fixtures f ON f.name = p.name")
def fixture_param_edges(spark, d):
    g = graph(spark, d)
    params = table(spark, d, "lineitem").select((F.col("l_orderkey") + 1000000000).alias("node_id"), F.concat(F.lit("part"), (F.col("l_partkey") % 50).cast("string")).alias("name"))
    fixtures = g.nodes.where("kind = 'variable' AND start_line < 100").select("node_id", simple_name(F.col("fqname")).alias("name"))
    return fixture_edges(params.join(g.nodes.where("flags & 256 <> 0").select("node_id"), "node_id", "left_semi"), fixtures)


@query(f"WITH {CTE}, apps AS (SELECT path, regexp_extract(fqname, '[^.]*$') AS owner, min(node_id) AS node_id FROM nodes WHERE kind = 'variable' GROUP BY 1, 2), handlers AS (SELECT 1000000000 + l_orderkey AS node_id, '/w/parts/' || lower(replace(p_brand, '#', '')) || '.py' AS path, 'part' || (l_partkey % 50) AS owner FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 2) SELECT DISTINCT a.node_id AS src, h.node_id AS dst, CAST(0 AS INT) AS flags FROM handlers h JOIN apps a ON a.path = h.path AND a.owner = h.owner")
def dispatch_handler_edges(spark, d):
    g = graph(spark, d)
    h = table(spark, d, "lineitem").where("l_linenumber = 2").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    handlers = h.select((F.col("l_orderkey") + 1000000000).alias("node_id"), F.concat(F.lit("/w/parts/"), F.lower(F.replace("p_brand", F.lit("#"))), F.lit(".py")).alias("path"), F.concat(F.lit("part"), (F.col("l_partkey") % 50).cast("string")).alias("owner"))
    return dispatch_edges(lookups.first_variables(g.nodes), handlers)


@query(f"WITH {CTE}, dyn AS (SELECT DISTINCT src, dst FROM edges WHERE flags & 2 <> 0), tops AS (SELECT DISTINCT m.node_id AS module, n.node_id AS node_id FROM nodes m JOIN nodes n ON n.path = m.path AND n.kind <> 'module' AND regexp_extract(n.fqname, '[^.]*$') NOT LIKE '\\_%' ESCAPE '\\' WHERE m.kind = 'class' AND m.node_id IN (SELECT dst FROM dyn)) SELECT DISTINCT src, tops.node_id AS dst, CAST(0 AS INT) AS flags FROM dyn JOIN tops ON module = dst WHERE src <> tops.node_id")
def dynamic_fanout_edges(spark, d):
    g = graph(spark, d)
    return dynamic_fanout(g.edges.where("flags & 2 <> 0").select("src", "dst"), g.nodes)


@query("WITH RECURSIVE supers AS (SELECT c_custkey AS sub, c_custkey // 3 AS super FROM customer WHERE c_custkey > 3), r AS (SELECT sub FROM supers WHERE super = 5 UNION SELECT s.sub FROM r JOIN supers s ON s.super = r.sub) SELECT sub AS node_id FROM r")
def subclass_closure(spark, d):
    s = table(spark, d, "customer").where("c_custkey > 3").select(F.col("c_custkey").alias("sub"), F.floor(F.col("c_custkey") / 3).alias("super"))
    return subclasses(s, spark.range(5, 6).select(F.col("id").alias("node_id")))


@query(f"WITH {CTE} SELECT node_id, flags | CASE WHEN regexp_matches(path, 'test_') THEN 256 ELSE 0 END | CASE WHEN path LIKE '%\\_\\_init\\_\\_.py' ESCAPE '\\' THEN 2 ELSE 0 END AS flags FROM nodes")
def plugin_pass(spark, d):
    """Two plug-ins on one frozen graph: tests by file name, and package modules kept alive."""
    g = graph(spark, d)
    view = GraphView(g)
    tests = Ops(flags=view.nodes.where(F.col("path").rlike("test_")).select("node_id", F.lit(256).cast("long").alias("bits")))
    return apply_ops(g, [tests, Ops.keep_alive(view.nodes.where(F.col("path").endswith("__init__.py")))]).nodes.select("node_id", "flags")


# --- incremental -----------------------------------------------------------------------------------------------

_CHANGES = "changes AS (SELECT user_id AS path, event_id AS seq, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'changed' END AS kind FROM events)"


def _changes(spark, d):
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("changed")
    return table(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), kind.alias("kind"))


@query(f"WITH {_CHANGES} SELECT path, kind, seq FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS i FROM changes) WHERE i = 1 AND kind <> 'deleted'")
def latest_state_after_events(spark, d):
    return latest_state(_changes(spark, d))


@query("SELECT coalesce(o.o_orderkey, n.o_orderkey) AS path, CASE WHEN o.o_orderkey IS NULL THEN 'created' WHEN n.o_orderkey IS NULL THEN 'deleted' ELSE 'changed' END AS kind FROM (SELECT o_orderkey, o_custkey AS h FROM orders WHERE o_orderkey % 5 <> 0) o FULL OUTER JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_custkey END AS h FROM orders WHERE o_orderkey % 11 <> 0) n ON n.o_orderkey = o.o_orderkey WHERE o.h IS DISTINCT FROM n.h")
def dirty_files_query(spark, d):
    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("sha"))
    new = o.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 7 == 0, -1).otherwise(F.col("o_custkey")).alias("sha"))
    return dirty_files(old, new)


@query("SELECT DISTINCT l_orderkey AS path FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) UNION SELECT p_partkey FROM part WHERE p_size = 7")
def retranslate_set(spark, d):
    reads = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("read"))
    return retranslate(reads, table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("path")))


QUERIES |= trees.QUERIES
ORACLES |= trees.ORACLES
