"""Transitive closures as DataFrame fixpoints, several at a time in one bit mask.

Each closure has a bit. A node's mask holds the closures that reach it; an edge lets those pass that its own
mask allows. The distributed form is semi-naive: each round joins only bits that are new, and ends in the
shared folder. Below LOCAL_EDGES edges, counted first, one task runs all rounds over arrays; both give the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL_EDGES, MOST_ROUNDS = 2_000_000, 10_000
#: Jobs that Beside runs side by side.
JOBS = 2


def scratch(spark) -> str:
    """A new path in the shared folder that the session names; a folder of our own where it names none."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="symreach-"))
        where = sc.getCheckpointDir()
    return f"{where.rstrip('/')}/symreach-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Beside:
    """Runs jobs that don't wait for each other side by side, JOBS at most. What one raises is raised where its result is asked for; leaving the block waits for all."""

    def __init__(self, spark):
        self.spark, self.pool = spark, ThreadPoolExecutor(JOBS)

    def __enter__(self) -> Beside:
        return self

    def __exit__(self, *_) -> None:
        self.pool.shutdown(cancel_futures=True)

    def start(self, job: Callable) -> Future:
        # With the caller's job group and other local properties.
        return self.pool.submit(inheritable_thread_target(self.spark)(job))

    def cuts(self, *frames: DataFrame) -> list[DataFrame]:
        """cut() of each."""
        return [x.result() for x in [self.start(lambda d=d: cut(d)) for d in frames]]


def spread(src: np.ndarray, dst: np.ndarray, allow: np.ndarray, ids: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, masks) reached over arrays: one breadth-first search for each bit."""
    if not len(ids):
        return ids.astype(np.int64), masks.astype(np.int64)
    known, back = np.unique(np.concatenate((ids, src, dst)), return_inverse=True)
    at, a, b = back[: len(ids)], back[len(ids) : len(ids) + len(src)], back[len(ids) + len(src) :]
    order = np.argsort(a, kind="stable")
    b, allow = b[order], allow[order]
    first = np.searchsorted(a[order], np.arange(len(known) + 1))
    out = np.zeros(len(known), np.int64)
    for bit in range(63):
        one = np.int64(1) << np.int64(bit)
        if not (masks & one).any():
            continue
        seen = np.zeros(len(known), bool)
        front = np.unique(at[(masks & one) != 0])
        seen[front] = True
        while len(front):
            n = first[front + 1] - first[front]
            edge = np.repeat(first[front] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            to = b[edge[(allow[edge] & one) != 0]]
            front = np.unique(to[~seen[to]])
            seen[front] = True
        out[seen] |= one
    hit = out != 0
    return known[hit], out[hit]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, m): an edge from a to b that lets m pass, or a seed a with mask m where b is null."""
    a, b, m, seed = [], [], [], []
    for batch in batches:
        a.append(np.array(batch.column(0)))
        b.append(np.array(batch.column(1).fill_null(0)))
        m.append(np.array(batch.column(2)))
        seed.append(np.array(batch.column(1).is_null()))
    if not a:
        return
    a, b, m, seed = (np.concatenate(x) for x in (a, b, m, seed))
    ids, masks = spread(a[~seed], b[~seed], m[~seed], a[seed], m[seed])
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(masks, pa.int64())], ["node_id", "mask"])


def closures(edges: DataFrame, seeds: DataFrame, local_edges: int = LOCAL_EDGES, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(node_id, mask) of all nodes that some closure reaches, seeds included.

    edges: src, dst, allow (the closures that may pass); seeds: node_id, mask."""
    seeds = seeds.groupBy("node_id").agg(F.bit_or("mask").alias("mask")).where("mask <> 0")
    edges = edges.select("src", "dst", F.col("allow").cast("long").alias("allow")).where("allow <> 0")
    if edges.limit(local_edges + 1).count() <= local_edges:
        rows = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("allow").alias("m")).unionByName(seeds.select(F.col("node_id").alias("a"), F.lit(None).cast("long").alias("b"), F.col("mask").alias("m")))
        return rows.coalesce(1).mapInArrow(_local, "node_id long, mask long")
    edges = cut(edges.groupBy("src", "dst").agg(F.bit_or("allow").alias("allow")))
    state = front = cut(seeds)
    for _ in range(most_rounds):
        if front.isEmpty():
            return state
        passed = front.join(edges, front["node_id"] == edges["src"]).select(F.col("dst").alias("node_id"), F.col("mask").bitwiseAND(F.col("allow")).alias("mask")).where("mask <> 0")
        passed = passed.groupBy("node_id").agg(F.bit_or("mask").alias("mask"))
        old = state.select("node_id", F.col("mask").alias("old"))
        front = cut(passed.join(old, "node_id", "left").select("node_id", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long")))).alias("mask")).where("mask <> 0"))
        state = cut(state.unionByName(front).groupBy("node_id").agg(F.bit_or("mask").alias("mask")))
    raise RuntimeError(f"the closure did not end in {most_rounds} rounds")


def reach(edges: DataFrame, seeds: DataFrame, skip: int = 0, reverse: bool = False, **how) -> DataFrame:
    """Distinct node_id reached from seeds (node_id) over edges without a flag of skip."""
    src, dst = ("dst", "src") if reverse else ("src", "dst")
    open_ = edges if not skip else edges.where(F.col("flags").bitwiseAND(F.lit(skip)) == 0)
    return closures(open_.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(1).alias("allow")), seeds.select("node_id", F.lit(1).cast("long").alias("mask")), **how).select("node_id")


def several(edges: DataFrame, nodes: DataFrame, wanted: list[tuple[Column, int]], **how) -> DataFrame:
    """(node_id, mask): bit i for the closure from nodes where wanted[i][0], without edges that have a flag of wanted[i][1]."""
    mask, allow = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i, (seed, skip) in enumerate(wanted):
        mask = mask.bitwiseOR(F.when(seed, F.lit(1 << i)).otherwise(0).cast("long"))
        allow = allow.bitwiseOR(F.when(F.col("flags").bitwiseAND(F.lit(skip)) == 0, F.lit(1 << i)).otherwise(0).cast("long"))
    return closures(edges.select("src", "dst", allow.alias("allow")), nodes.select("node_id", mask.alias("mask")), **how)
