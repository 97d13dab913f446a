"""Shared pieces: scratch tables, prefix sums in two levels, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

NOT_SPACE = r"[^ \t-\r]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Key ranges that two_level() deals a group into; 2 ** RANGE_BITS of them.
RANGE_BITS = 12


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that the session names; a folder of our own where it names none and all runs in one process."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="symreach-"))
        where = sc.getCheckpointDir()
    return f"{where.rstrip('/')}/symreach-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, and columns can be pruned."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_row(docs: DataFrame, *left_out: str) -> Column:
    """All columns of docs but those left out as one struct, so that no name of theirs can clash with one in use."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in left_out] or [F.lit(True).alias("none")]).alias("row")


def unwrapped(names: list[str], **put: Column) -> list[Column]:
    """The columns of a whole_row() again, those of `put` from elsewhere."""
    return [put[c].alias(c) if c in put else F.col(f"row.`{c}`") for c in names]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what scratch() named."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows, so that what Python makes of a slice's values stays small."""
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.slice(a, rows)
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_range(key: Column) -> Column:
    """The range of a 64-bit key: ascending with it, of 2 ** RANGE_BITS values."""
    return F.shiftright(key, 64 - RANGE_BITS)


def two_level(df: DataFrame, group: str, part: Column, order: list[Column], value: Column) -> DataFrame:
    """Adds pos and before, the count and the sum of value over the rows of the group that stand earlier.

    Rows stand by (part, order); part must be non-null. Each window holds one part of one group, and
    one more runs over the parts' sums, so that no task holds a whole group."""
    d = df.withColumn("_part", part).withColumn("_value", value)
    sums = d.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.sum("_value").alias("_sum"))
    ahead = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(group, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_sum0"))
    own = W.partitionBy(group, "_part").orderBy(*order)
    d = d.withColumn("_i", F.row_number().over(own) - 1).withColumn("_run", F.sum("_value").over(own.rowsBetween(W.unboundedPreceding, 0)) - F.col("_value"))
    return d.join(sums, [group, "_part"]).withColumn("pos", F.col("_n0") + F.col("_i")).withColumn("before", F.col("_sum0") + F.col("_run")).drop("_part", "_value", "_i", "_run", "_n0", "_sum0")


def half_range(key: Column, n: Column) -> Column:
    """The range of a 64-bit key among about sqrt(n) ranges, ascending with it: with it two_level() holds about sqrt(n) rows of a group of n in any window."""
    bits = F.greatest(F.lit(1), F.least(F.lit(24), F.ceil(F.log2(F.greatest(n, F.lit(2))) / 2))).cast("int")
    return F.call_function("shiftright", key, F.lit(64) - bits)


def running(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """df with i, its rows' places in that order, and before_<name>, each value's sum over the rows ahead.

    One distributed sort: a row knows its partition of the sort and its place there, so windows hold a partition each
    and one more runs over the partitions' sums; no task holds all rows. order must tell all rows apart."""
    d = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    for name, v in values.items():
        d = d.withColumn(f"_v_{name}", v)
    d = cut(d).withColumn("_pid", F.shiftright("_mid", 33))
    sums = d.groupBy("_pid").agg(F.count("*").alias("_n"), *[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values]).withColumn("_k", F.lit(0))
    ahead = W.partitionBy("_k").orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_pid", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"), *[F.coalesce(F.sum(f"_s_{k}").over(ahead), F.lit(0)).alias(f"_b_{k}") for k in values])
    own = W.partitionBy("_pid").orderBy("_mid").rowsBetween(W.unboundedPreceding, -1)
    d = d.select("*", *[F.coalesce(F.sum(f"_v_{k}").over(own), F.lit(0)).alias(f"_o_{k}") for k in values]).join(sums, "_pid")
    return d.select(*df.columns, (F.col("_n0") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).alias("i"), *[(F.col(f"_b_{k}") + F.col(f"_o_{k}")).alias(f"before_{k}") for k in values])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps, each a minimum per node and a join; written after each round."""
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = cut(links.select(u, v).where("u > v").distinct())
    mark = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small)
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
