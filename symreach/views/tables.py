"""A symbol graph over order tables: regions and nations are modules, suppliers and customers classes, parts variables, orders functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import SymbolGraph
from ..registry import FlagRegistry


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NODE = "CAST({id} AS BIGINT) AS node_id, {fqname} AS fqname, '{kind}' AS kind, {path} AS path, CAST({line} AS INT) AS start_line, CAST({flags} AS BIGINT) AS flags"

NODES = [
    ("region", dict(id="r_regionkey", fqname="concat('region', r_regionkey)", kind="module", path="concat('/w/region', r_regionkey, '/__init__.py')", line="1", flags="0")),
    ("nation", dict(id="1000 + n_nationkey", fqname="concat('region', n_regionkey, '.nation', n_nationkey)", kind="module", path="concat('/w/region', n_regionkey, '/nation', n_nationkey, '.py')", line="1", flags="0")),
    ("supplier JOIN nation ON s_nationkey = n_nationkey", dict(id="10000000 + s_suppkey", fqname="concat('region', n_regionkey, '.nation', n_nationkey, '.Supplier', s_suppkey)", kind="class", path="concat('/w/region', n_regionkey, '/nation', n_nationkey, '.py')", line="10 + s_suppkey % 500", flags="0")),
    ("customer JOIN nation ON c_nationkey = n_nationkey", dict(id="20000000 + c_custkey", fqname="concat('region', n_regionkey, '.nation', n_nationkey, '.Customer', c_custkey)", kind="class", path="concat('/w/region', n_regionkey, '/nation', n_nationkey, '.py')", line="600 + c_custkey % 900", flags="0")),
    ("part", dict(id="30000000 + p_partkey", fqname="concat('parts.', lower(replace(p_brand, '#', '')), '.part', p_partkey % 50)", kind="variable", path="concat('/w/parts/', lower(replace(p_brand, '#', '')), '.py')", line="p_partkey % 700 + 1", flags="0")),
    ("orders", dict(id="1000000000 + o_orderkey", fqname="concat('orders.', CASE WHEN o_orderpriority = '5-LOW' THEN 'test_' ELSE 'c' END, o_orderkey % 40, '.', CASE WHEN o_orderkey % 97 = 0 THEN '__all__' ELSE concat('order', o_orderkey) END)", kind="function", path="concat('/w/orders/', CASE WHEN o_orderpriority = '5-LOW' THEN 'test_' ELSE 'c' END, o_orderkey % 40, '.py')", line="o_orderkey % 2000 + 1", flags="CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 10 = 0 THEN 2 WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 7 = 0 THEN 16 WHEN o_orderpriority = '5-LOW' AND o_orderkey % 3 = 0 THEN 256 ELSE 0 END")),
]

EDGE = "CAST({src} AS BIGINT) AS src, CAST({dst} AS BIGINT) AS dst, CAST({flags} AS INT) AS flags"

EDGES = [
    ("orders", dict(src="1000000000 + o_orderkey", dst="20000000 + o_custkey", flags="0")),
    ("lineitem", dict(src="1000000000 + l_orderkey", dst="30000000 + l_partkey", flags="CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END")),
    ("lineitem WHERE l_linenumber = 1", dict(src="30000000 + l_partkey", dst="10000000 + l_suppkey", flags="2")),
    ("supplier", dict(src="10000000 + s_suppkey", dst="1000 + s_nationkey", flags="0")),
    ("customer", dict(src="20000000 + c_custkey", dst="1000 + c_nationkey", flags="0")),
    ("nation", dict(src="1000 + n_nationkey", dst="n_regionkey", flags="0")),
]


def _sql(form: str, parts: list[tuple[str, dict]], by: str) -> str:
    return f" {by} ".join(f"SELECT {form.format(**values)} FROM {source}" for source, values in parts)


#: The same view as SQL, for oracles.
CTE = f"nodes AS ({_sql(NODE, NODES, 'UNION ALL')}), edges AS ({_sql(EDGE, EDGES, 'UNION')})"


def _frame(spark: SparkSession, sf_dir: str, form: str, parts: list[tuple[str, dict]]) -> DataFrame:
    out = None
    for source, values in parts:
        source, _, condition = source.partition(" WHERE ")
        names = source.replace("JOIN", "").split(" ON ")[0].split()
        d = table(spark, sf_dir, names[0])
        if len(names) > 1:
            a, b = source.split(" ON ")[1].split(" = ")
            d = d.join(table(spark, sf_dir, names[1]), F.col(a) == F.col(b))
        if condition:
            d = d.where(condition)
        d = d.selectExpr(*_columns(form.format(**values)))
        out = d if out is None else out.unionByName(d)
    return out


def _columns(select: str) -> list[str]:
    """The select list cut at the commas that stand in no parentheses."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(select):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(select[last:i])
            last = i + 1
    return [*out, select[last:]]


def registry() -> FlagRegistry:
    out = FlagRegistry()
    out.nodes.declare("test/testcase", True, True, "a test")
    return out


def graph(spark: SparkSession, sf_dir: str, **how) -> SymbolGraph:
    return SymbolGraph(_frame(spark, sf_dir, NODE, NODES), _frame(spark, sf_dir, EDGE, EDGES).dropDuplicates(), registry(), **how)


def document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted names over documents: lang and lang.source are modules, lang.source.docN variables (type aliases where N % 11 = 0)."""
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 11 == 0, "type_alias").when(F.col("doc_id") % 3 == 0, "function").otherwise("variable")
    docs = d.select((F.col("doc_id") + 100000).alias("node_id"), F.concat_ws(".", "lang", "source", F.concat(F.lit("doc"), (F.col("doc_id") % 400).cast("string"))).alias("fqname"), kind.alias("kind"), F.concat(F.lit("/d/"), "lang", F.lit("/"), "source", F.lit(".py")).alias("path"))
    langs = d.groupBy("lang").agg(F.min("doc_id").alias("node_id")).select("node_id", F.col("lang").alias("fqname"), F.lit("module").alias("kind"), F.concat(F.lit("/d/"), "lang", F.lit("/__init__.py")).alias("path"))
    sources = d.where("source <> 'src3'").groupBy("lang", "source").agg((F.min("doc_id") + 50000).alias("node_id")).select("node_id", F.concat_ws(".", "lang", "source").alias("fqname"), F.lit("module").alias("kind"), F.concat(F.lit("/d/"), "lang", F.lit("/"), "source", F.lit(".py")).alias("path"))
    return docs.unionByName(langs).unionByName(sources)


NAMES_CTE = """names AS (
SELECT doc_id + 100000 AS node_id, lang || '.' || source || '.doc' || (doc_id % 400) AS fqname, CASE WHEN doc_id % 11 = 0 THEN 'type_alias' WHEN doc_id % 3 = 0 THEN 'function' ELSE 'variable' END AS kind, '/d/' || lang || '/' || source || '.py' AS path FROM documents
UNION ALL SELECT min(doc_id), lang, 'module', '/d/' || lang || '/__init__.py' FROM documents GROUP BY lang
UNION ALL SELECT min(doc_id) + 50000, lang || '.' || source, 'module', '/d/' || lang || '/' || source || '.py' FROM documents WHERE source <> 'src3' GROUP BY lang, source)"""


def asked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to look up: of documents, some with segments too many, some of modules, some of nothing."""
    d = table(spark, sf_dir, "documents").where("doc_id % 5 = 0")
    base = F.concat_ws(".", "lang", "source", F.concat(F.lit("doc"), (F.col("doc_id") % 700).cast("string")))
    return d.select(F.when(F.col("doc_id") % 3 == 0, F.concat(base, F.lit(".Cls.method"))).when(F.col("doc_id") % 4 == 0, F.concat_ws(".", "lang", "source")).otherwise(base).alias("name")).distinct()


ASKED_CTE = """asked AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN lang || '.' || source || '.doc' || (doc_id % 700) || '.Cls.method' WHEN doc_id % 4 = 0 THEN lang || '.' || source ELSE lang || '.' || source || '.doc' || (doc_id % 700) END AS name FROM documents WHERE doc_id % 5 = 0),
walk AS (SELECT name, i - 1 AS rank, array_to_string(list_slice(string_split(name, '.'), 1, len(string_split(name, '.')) - i + 1), '.') AS prefix FROM (SELECT name, unnest(range(1, len(string_split(name, '.')) + 1)) AS i FROM asked))"""


def user_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic graph: an edge from each event's user to the next event's."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    # One window over all events; their order is the graph's definition.
    before = F.lag("user_id").over(W.orderBy("ts", "event_id"))
    return e.select(before.alias("src"), F.col("user_id").alias("dst"), "event_type").where("src IS NOT NULL").select("src", "dst", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("flags")).distinct()


STEPS_CTE = """steps AS (SELECT DISTINCT src, dst, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS flags FROM (SELECT lag(user_id) OVER (ORDER BY ts, event_id) AS src, user_id AS dst, event_type FROM events) WHERE src IS NOT NULL)"""
