"""A symbol graph: nodes, edges and the registry of its flags, with the queries on it."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .operators import closure
from .operators.stats import graph_stats
from .registry import FlagRegistry

FORMAT_VERSION = 1


class SymbolGraph:
    def __init__(self, nodes: DataFrame, edges: DataFrame, registry: FlagRegistry | None = None, **how):
        """how: local_edges and most_rounds of the closures."""
        self.nodes, self.edges, self.registry, self.how = nodes, edges, registry or FlagRegistry(), how

    def node_flag(self, name: str) -> int:
        return self.registry.nodes.bit(name)

    def seeds(self, mask: int) -> DataFrame:
        return self.nodes.where(F.col("flags").bitwiseAND(F.lit(mask)) != 0).select("node_id")

    def reachable(self, seed_flags: int | None = None, skip_flags: int = 0) -> DataFrame:
        """node_id of all that nodes with a seed flag (the registry's defaults) reach over edges without a skip flag."""
        mask = self.registry.default_seed_mask() if seed_flags is None else seed_flags
        return closure.reach(self.edges, self.seeds(mask), skip_flags, **self.how)

    def _from(self, node_id: int, reverse: bool) -> DataFrame:
        one = self.nodes.where(F.col("node_id") == node_id).select("node_id")
        if one.isEmpty():
            raise IndexError(f"no node {node_id}")
        return closure.reach(self.edges, one, reverse=reverse, **self.how)

    def descendants(self, node_id: int) -> DataFrame:
        return self._from(node_id, False)

    def ancestors(self, node_id: int) -> DataFrame:
        return self._from(node_id, True)

    def direct_predecessors(self, node_id: int) -> DataFrame:
        return self.edges.where(F.col("dst") == node_id).select(F.col("src").alias("node_id")).distinct()

    def reachable_expanding(self, seeds: DataFrame, stop_kinds: list[str]) -> DataFrame:
        """The closure from seeds that visits nodes of stop_kinds but does not go on from them (a seed goes on)."""
        stops = self.nodes.where(F.col("kind").isin(stop_kinds)).select(F.col("node_id").alias("src"))
        stops = stops.join(seeds.select(F.col("node_id").alias("src")), "src", "left_anti")
        return closure.reach(self.edges.join(stops, "src", "left_anti"), seeds, **self.how)

    def dead(self, seed_flags: int | None = None) -> DataFrame:
        """Declarations that the seeds do not reach."""
        return self.nodes.where(F.col("kind").isin(*S.DECL_KINDS)).join(self.reachable(seed_flags), "node_id", "left_anti")

    def dead_all(self, seed_flags: int | None = None) -> DataFrame:
        """Nodes of any kind that the seeds do not reach."""
        return self.nodes.join(self.reachable(seed_flags), "node_id", "left_anti")

    def _mask(self, seed_flags: int | None) -> int:
        return self.registry.default_seed_mask() if seed_flags is None else seed_flags

    def _difference(self, all_mask: int, less_mask: int, skip: int) -> DataFrame:
        """What the seeds of all_mask reach, and those of less_mask without edges of skip do not: one pass for both."""
        flags = F.col("flags")
        both = closure.several(self.edges, self.nodes, [(flags.bitwiseAND(F.lit(all_mask)) != 0, 0), (flags.bitwiseAND(F.lit(less_mask)) != 0, skip)], **self.how)
        return self.nodes.join(both.where("mask = 1").select("node_id"), "node_id", "left_semi")

    def kept_alive_by_dead_branches(self, seed_flags: int | None = None) -> DataFrame:
        m = self._mask(seed_flags)
        return self._difference(m, m, S.EDGE_DEAD_BRANCH)

    def kept_alive_by_flags_only(self, flags: int, seed_flags: int | None = None) -> DataFrame:
        m = self._mask(seed_flags)
        return self._difference(m, m & ~flags, 0)

    def test_only(self) -> DataFrame:
        known = self.registry.nodes.flags
        bits = sum(known[n].bit for n in ("test/testcase", "test/fixture") if n in known)
        return self.kept_alive_by_flags_only(bits)

    def dead_tests(self, testcase: int | None = None, fixture: int | None = None) -> DataFrame:
        """What only tests keep alive that exercise no live production code.

        One closure over two layers: (n, 0) is live, (n, 1) is exercised by a live test. Liveness goes back
        over edges from non-modules; a live test exercises what it reaches, without going on from modules; exercised code is live."""
        known = self.registry.nodes.flags
        testcase = testcase if testcase is not None else known["test/testcase"].bit if "test/testcase" in known else 0
        fixture = fixture if fixture is not None else known["test/fixture"].bit if "test/fixture" in known else 0
        if not testcase:
            return self.nodes.limit(0)
        mask, flags = self.registry.default_seed_mask(), F.col("flags")
        nodes = self.nodes.select("node_id", "kind", "flags")
        seed = flags.bitwiseAND(F.lit(mask)) != 0
        prod = closure.reach(self.edges, nodes.where(seed & (flags.bitwiseAND(F.lit(testcase | fixture)) == 0)), **self.how)
        code = nodes.where(F.col("kind").isin(*S.CODE_KINDS)).select("node_id")
        tests = nodes.where(flags.bitwiseAND(F.lit(testcase)) != 0).select("node_id")
        pairs = self.edges.select("src", "dst").distinct().join(nodes.where("kind <> 'module'").select(F.col("node_id").alias("src")), "src", "left_semi")
        step = lambda df, a, la, b, lb: df.select((F.col(a) * 2 + la).alias("src"), (F.col(b) * 2 + lb).alias("dst"), F.lit(1).alias("allow"))
        layered = step(pairs, "dst", 0, "src", 0).unionByName(step(pairs, "src", 1, "dst", 1)).unionByName(step(tests, "node_id", 0, "node_id", 1)).unionByName(step(code, "node_id", 1, "node_id", 0))
        start = prod.join(code, "node_id", "left_semi").select((F.col("node_id") * 2).alias("node_id"), F.lit(1).cast("long").alias("mask"))
        live = closure.closures(layered, start, **self.how).where("node_id % 2 = 0").select(F.floor(F.col("node_id") / 2).alias("node_id"))
        dead = closure.cut(tests.join(live, "node_id", "left_anti"))
        full = nodes.join(dead.withColumn("_dead", F.lit(True)), "node_id", "left").withColumn("_live", F.col("_dead").isNull())
        both = closure.several(self.edges, full, [(seed, 0), (seed & F.col("_live"), 0)], **self.how)
        return self.nodes.join(both.where("mask = 1").select("node_id"), "node_id", "left_semi")

    def write(self, path: str, user_meta: dict[str, str] | None = None) -> None:
        """nodes, edges and flag_registry as Parquet, meta as JSON, ids dense; an existing graph is an error."""
        from .operators.lookups import dense_ids

        spark = self.nodes.sparkSession
        ids = dense_ids(self.nodes)
        nodes = self.nodes.join(ids, "node_id").drop("node_id").withColumnRenamed("dense_id", "node_id").select(*self.nodes.columns)
        edges = self.edges
        for side in ("src", "dst"):
            edges = edges.join(ids.select(F.col("node_id").alias(side), F.col("dense_id").alias("_to")), side).drop(side).withColumnRenamed("_to", side)
        nodes.write.parquet(f"{path}/nodes")
        edges.select("src", "dst", "flags").dropDuplicates().write.parquet(f"{path}/edges")
        self.registry.to_df(spark).write.parquet(f"{path}/flag_registry")
        stats = graph_stats(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")).first().asDict()
        meta = {"format_version": FORMAT_VERSION, "created_at": int(time.time()), **stats, "user_meta": user_meta or {}}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")

    @classmethod
    def read(cls, spark: SparkSession, path: str, **how) -> SymbolGraph:
        meta = read_meta(spark, path)
        if meta["format_version"] != FORMAT_VERSION:
            raise ValueError(f"{path} has format {meta['format_version']}, not {FORMAT_VERSION}")
        rows = [tuple(r) for r in spark.read.parquet(f"{path}/flag_registry").collect()]
        return cls(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), FlagRegistry.from_rows(rows), **how)


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r["value"] for r in spark.read.text(f"{path}/meta").collect()))
