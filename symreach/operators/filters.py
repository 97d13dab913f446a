"""Predicates on nodes: DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.names import basename, checked_regex, is_dunder, relative_path, simple_name


def where(
    nodes: DataFrame,
    kinds: Iterable[str] | None = None,
    paths: Iterable[str] | None = None,
    basenames: Iterable[str] | None = None,
    names: Iterable[str] | None = None,
    flags_all: int | None = None,
    flags_any: int | None = None,
    prefix: str | None = None,
    path_regex: str | None = None,
) -> DataFrame:
    """Nodes for which all that is given holds. A prefix is raw, not bounded by dots; a pattern is searched for anywhere in the path."""
    if kinds is not None and (odd := set(kinds := list(kinds)) - set(S.KINDS)):
        raise ValueError(f"no such kind: {', '.join(sorted(odd))}")
    held = []
    for column, values in ((F.col("kind"), kinds), (F.col("path"), paths), (basename(F.col("path")), basenames), (simple_name(F.col("fqname")), names)):
        if values is not None:
            held.append(column.isin(list(values)))
    if flags_all is not None:
        held.append(F.col("flags").bitwiseAND(F.lit(flags_all)) == flags_all)
    if flags_any is not None:
        held.append(F.col("flags").bitwiseAND(F.lit(flags_any)) != 0)
    if prefix is not None:
        held.append(F.col("fqname").startswith(prefix))
    if path_regex is not None:
        held.append(F.col("path").rlike(checked_regex(path_regex)))
    return nodes.where(reduce(lambda a, b: a & b, held)) if held else nodes


def decls_under(nodes: DataFrame, path_prefix: str) -> DataFrame:
    return nodes.where(F.col("path").startswith(path_prefix))


def decls_matching(nodes: DataFrame, part: str) -> DataFrame:
    return nodes.where(F.col("path").contains(part))


def decls_matching_name(nodes: DataFrame, regex: str) -> DataFrame:
    """Declarations whose last segment matches anywhere."""
    return nodes.where(simple_name(F.col("fqname")).rlike(checked_regex(regex)) & F.col("kind").isin(*S.DECL_KINDS))


def matching_specs(nodes: DataFrame, root: str, regexes: Iterable[str] = (), exact: Iterable[str] = (), absolute: Iterable[str] = ()) -> DataFrame:
    """Nodes whose absolute path, or relative path or name, is one of those, or whose relative path starts with a match of a pattern."""
    rel = relative_path(F.col("path"), root)
    held = [F.col("path").isin(list(absolute)), rel.isin(list(exact)), F.col("fqname").isin(list(exact))]
    held += [rel.rlike(f"^(?:{checked_regex(r)})") for r in regexes]
    return nodes.where(reduce(lambda a, b: a | b, held))


def module_dunders(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind").isin("variable", "function") & is_dunder(simple_name(F.col("fqname"))))


def nodes_at(nodes: DataFrame, ids: list[int]) -> DataFrame:
    """The nodes of those ids, in that order (column ordinal); IndexError for an id that is none."""
    spark = nodes.sparkSession
    wanted = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "ordinal int, node_id long")
    if missing := wanted.join(nodes.select("node_id"), "node_id", "left_anti").limit(1).collect():
        raise IndexError(f"no node {missing[0]['node_id']}")
    return wanted.join(nodes, "node_id").orderBy("ordinal")


def edges_where(edges: DataFrame, nodes: DataFrame, flags_any: int | None = None, dst_kinds: Iterable[str] | None = None) -> DataFrame:
    """Edges with one of the flags that lead to a node of one of the kinds."""
    out = edges if flags_any is None else edges.where(F.col("flags").bitwiseAND(F.lit(flags_any)) != 0)
    if dst_kinds is None:
        return out
    return out.join(nodes.where(F.col("kind").isin(list(dst_kinds))).select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "dst", "flags")
