"""Counts over graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_kind(nodes: DataFrame, dead: DataFrame) -> DataFrame:
    """kind, total and dead, for dead (node_id)."""
    gone = dead.select("node_id").distinct().withColumn("_dead", F.lit(1))
    return nodes.join(gone, "node_id", "left").groupBy("kind").agg(F.count("*").alias("total"), F.coalesce(F.sum("_dead"), F.lit(0)).alias("dead"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, file_count (paths that are not empty), line_count (the last line of each path, summed)."""
    per = nodes.groupBy("path").agg(F.max("end_line").alias("last"), F.count("*").alias("n"))
    files = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("node_count"), F.count(F.when(F.col("path") != "", 1)).alias("file_count"), F.coalesce(F.sum(F.when(F.col("path") != "", F.col("last"))), F.lit(0)).cast("long").alias("line_count"))
    count = edges.agg(F.count("*").alias("edge_count"))
    return files.withColumn("_k", F.lit(0)).join(count.withColumn("_k", F.lit(0)), "_k").select("node_count", "edge_count", "file_count", "line_count")


def dst_histogram(edges: DataFrame) -> DataFrame:
    """degree and how many nodes have it as targets."""
    return edges.groupBy("dst").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n"))


def seed_mask(registry: DataFrame) -> DataFrame:
    """All node bits that seed by default, in one row."""
    return registry.where("space = 'node' AND seed AND default_on").agg(F.coalesce(F.bit_or("bit"), F.lit(0)).cast("long").alias("seed_mask"))


def surface_fingerprint(exports: DataFrame) -> DataFrame:
    """path and an order-free fingerprint of its exports (path, name, target)."""
    return exports.groupBy("path").agg(F.bit_xor(F.xxhash64("name", "target")).alias("fingerprint"))
