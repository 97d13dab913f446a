"""Tables of a symbol graph: column types, kinds and the engine's flag bits."""

from __future__ import annotations

from pyspark.sql import types as T

KINDS = ("function", "class", "variable", "import", "type_alias", "module", "external")
DECL_KINDS = ("function", "class", "variable", "import", "type_alias")
CODE_KINDS = ("function", "class", "variable", "type_alias")

# Node flags.
UNRESOLVED, ENTRYPOINT, NOQA, NOTEBOOK, DEAD_BRANCH, STAR_REEXPORT = 1, 2, 16, 32, 64, 128
FIRST_NODE_BIT, NODE_BITS = 256, 32
# Edge flags.
EDGE_DEAD_BRANCH, EDGE_DYNAMIC_IMPORT, EDGE_INIT_SUBCLASS = 1, 2, 4
FIRST_EDGE_BIT, EDGE_BITS = 8, 8

IMPORT = T.StructType([T.StructField("module", T.StringType()), T.StructField("decl", T.StringType()), T.StructField("star", T.BooleanType())])
NODES = T.StructType(
    [
        T.StructField("node_id", T.LongType()),
        T.StructField("fqname", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("start_column", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("end_column", T.IntegerType()),
        T.StructField("flags", T.LongType()),
        T.StructField("import", IMPORT),
    ]
)
EDGES = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("flags", T.IntegerType())])
FACTS = "topic string, path string, node_id long, value string"
