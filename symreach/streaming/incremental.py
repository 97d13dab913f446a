"""Incremental rebuilds: which files changed, which of them count, and what must be resolved again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dirty_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, kind) of files that two listings (path, sha) tell apart: created, deleted or changed."""
    a, b = old.select("path", F.col("sha").alias("_old")), new.select("path", F.col("sha").alias("_new"))
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), "path", "full_outer")
    kind = F.when(F.col("_a").isNull(), "created").when(F.col("_b").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select("path", kind.alias("kind")).where("kind IS NOT NULL")


def latest_state(changes: DataFrame) -> DataFrame:
    """(path, kind, seq): the last change (path, kind, seq) of each path, unless it is a deletion."""
    last = changes.groupBy("path").agg(F.max(F.struct("seq", "kind")).alias("last"))
    return last.select("path", F.col("last.kind").alias("kind"), F.col("last.seq").alias("seq")).where("kind <> 'deleted'")


def retranslate(reads: DataFrame, dirty: DataFrame) -> DataFrame:
    """path of what is dirty or has read (path, read) something dirty."""
    touched = reads.join(dirty.select(F.col("path").alias("read")), "read", "left_semi").select("path")
    return touched.unionByName(dirty.select("path")).distinct()


def full_rebuild_needed(events: DataFrame, known: DataFrame) -> bool:
    """Whether events (kind, path) are more than changes of known files."""
    odd = events.where("kind <> 'changed'").select("path").unionByName(events.select("path").join(known.select("path"), "path", "left_anti"))
    return not odd.isEmpty()


def follow(spark, folder: str, schema: str, apply, checkpoint: str, **options):
    """A stream of change events (files in a folder) whose batches go to apply(events, batch number); once each, by the checkpoint."""
    events = spark.readStream.schema(schema).options(**options).json(folder)
    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
