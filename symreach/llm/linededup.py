"""Line deduplication over levelled sorted runs of line keys.

A store keeps runs: tables bucketed and sorted by the key's hash, so a merge join reads them in order
without a shuffle. Batches come in descending order of doc_id. Each new batch is reduced to one row per
key, merge-anti-joined with the runs (a key that no run holds is new, and the batch's largest doc_id is
its keeper for good), and its rows are added as a run of level 0. FAN runs of a level are compacted into one of
the next, so that n batches leave O(FAN log n) runs, and each key is rewritten O(log n) times.

A key is a line without white space ([\\x20\\x09-\\x0D]) at both ends, A-Z lower-cased. Only keys of
at least MIN_CHARS code points count. Keys are compared by 128 bits of a hash.

Null or empty text: one empty line, kept. Repeated rows: each is a row of its own; they hold a key
as one document (by doc_id), and each keeps the lines of which that doc_id is the keeper. Null doc_id: counts as one document below
all others. Ties do not arise: a key has one largest doc_id. Very long texts and lines: whole. Empty tables: no rows. Other columns, of any name, are ignored by
line_report() and kept by dedup_lines()."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CHARS, cut, discard, scratch, small, unwrapped, whole_row

MIN_CHARS, MIN_DOCS, BATCHES, FAN = 40, 5, 4, 2
KEY = "h1 long, h2 long"
NO_ID = -(2**63)


def line_key(line: str, min_chars: int = MIN_CHARS) -> tuple[int, int] | None:
    """128 bits that stand for the line's key; None for a key that is too short."""
    if len(line) < min_chars:
        return None
    key = line.strip(SPACE_CHARS)
    if len(key) < min_chars:
        return None
    h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass").lower())
    return (h >> 64) - (1 << 63), (h & (2**64 - 1)) - (1 << 63)


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids, marks, a, b = [], [], [], []
            for i, mark, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for key in {line_key(x, min_chars) for x in (text or "").split("\n")} - {None}:
                    ids.append(i)
                    marks.append(mark)
                    a.append(key[0])
                    b.append(key[1])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, marks, a, b)], ["doc_id", "mark", "h1", "h2"])

    return run


def _named(docs: DataFrame) -> list:
    """doc_id, NO_ID for null, and mark: a hash of the text where doc_id is null, so that such rows, one document all, are still told apart; else 0."""
    own = F.col("doc_id").cast("long")
    text = F.col("text").cast("string")
    return [F.coalesce(own, F.lit(NO_ID)).alias("doc_id"), F.when(own.isNull(), F.xxhash64(text)).otherwise(0).alias("mark")]


class LineRuns:
    """Levelled sorted runs of (h1, h2, n, keeper): documents that hold the key, and the largest of them.

    Rows of one key in several runs add up: n by sum, keeper by maximum."""

    def __init__(self, spark: SparkSession, fan: int = FAN, buckets: int | None = None):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        discard(self.spark, self.paths.pop(name))

    def close(self) -> None:
        """Drops all runs, from the catalogue and the shared folder; nothing that reads them may run after it."""
        for level in self.levels:
            for name in level:
                self._drop(name)
        self.levels = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows = rows.repartition(self.buckets, "h1")
        rows.write.bucketBy(self.buckets, "h1").sortBy("h1", "h2").option("path", self.paths.setdefault(name, scratch(self.spark))).saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """One row for each key of several runs, by merge joins of the sorted buckets.

        Not a union with an aggregate above: Spark 4.1 takes a union of equally bucketed tables for one
        partitioning and then leaves out the exchange that would bring the runs' rows of a key together."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).select("h1", "h2", F.col("n").alias("_n"), F.col("keeper").alias("_keeper")).hint("merge")
            n = F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))
            out = out.join(more, ["h1", "h2"], "full_outer").select("h1", "h2", n.alias("n"), F.greatest("keeper", "_keeper").alias("keeper"))
        return out

    def merged(self) -> DataFrame | None:
        """What all runs hold, a row for each key."""
        names = [x for level in self.levels for x in level]
        return self._merged(names) if names else None

    def fresh(self, batch: DataFrame) -> DataFrame:
        """Rows of batch (with h1, h2) whose key no run holds: one merge anti-join for each run."""
        for name in (x for level in self.levels for x in level):
            batch = batch.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """Adds rows (h1, h2, doc_id, mark), distinct, all of whose doc_id are below those added before.

        A key that the runs hold has its keeper; the batch's run then adds to its count alone."""
        own = batch.groupBy("h1", "h2").agg((F.count_if(F.col("doc_id") != NO_ID) + F.max((F.col("doc_id") == NO_ID).cast("long"))).alias("n"), F.max("doc_id").alias("top"))
        if self.levels:
            new = self.fresh(own).select("h1", "h2", F.lit(True).alias("new"))
            own = own.join(new, ["h1", "h2"], "left").select("h1", "h2", "n", F.when(F.col("new"), F.col("top")).alias("keeper"))
        else:
            own = own.withColumnRenamed("top", "keeper")
        self._push(0, self._write(own))

    def _push(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fan:
            merged = self._write(self._merged(self.levels[level]))
            for x in self.levels[level]:
                self._drop(x)
            self.levels[level] = []
            self._push(level + 1, merged)


def fill(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS, fan: int = FAN) -> LineRuns:
    """Runs of all lines of docs (doc_id, text), added in descending ranges of doc_id."""
    spark = docs.sparkSession
    keys = docs.select(*_named(docs), F.col("text").cast("string").alias("text")).mapInArrow(_keys(min_chars), f"doc_id long, mark long, {KEY}")
    keys = cut(keys.distinct())
    runs = LineRuns(spark, fan)
    cuts = sorted(set(keys.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)))
    for k in range(len(cuts), -1, -1):
        part = keys
        if k < len(cuts):
            part = part.where(F.col("doc_id") < F.lit(int(cuts[k])))
        if k:
            part = part.where(F.col("doc_id") >= F.lit(int(cuts[k - 1])))
        runs.add(part)
    runs.keys = keys
    return runs


def _drop(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, text, lost) to (row, n_lines, n_dropped, kept)."""
        for batch in small(batches):
            kept, n, n_dropped = [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = (text or "").split("\n")
                n.append(len(lines))
                if gone:
                    gone = {(x["h1"], x["h2"]) for x in gone}
                    lines = [x for x in lines if line_key(x, min_chars) not in gone]
                n_dropped.append(n[-1] - len(lines))
                kept.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["row", "n_lines", "n_dropped", "kept"])

    return run


def _decided(docs: DataFrame, min_docs: int, min_chars: int, batches: int, *left_out: str) -> DataFrame:
    """row (a struct of the columns of docs but those left out), n_lines, n_dropped and kept (text)."""
    runs = fill(docs.select("doc_id", "text"), batches, min_chars)
    frequent = runs.merged().where(F.col("n") >= min_docs).select("h1", "h2", "keeper")
    # Written, as the runs go now. A document's list is bounded by its own lines.
    lost = cut(runs.keys.join(frequent, ["h1", "h2"]).where("doc_id <> keeper").groupBy(F.col("doc_id").alias("own"), F.col("mark").alias("own_mark")).agg(F.collect_list(F.struct("h1", "h2")).alias("lost")))
    runs.close()
    rows = docs.select(whole_row(docs, *left_out), *_named(docs), F.col("text").cast("string").alias("text"))
    # Always a merge join: a table that is small enough to broadcast would not stay so as the input grows.
    rows = rows.join(lost.hint("merge"), (F.col("doc_id") == F.col("own")) & (F.col("mark") == F.col("own_mark")), "left").select("row", "text", "lost")
    schema = T.StructType([rows.schema["row"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])
    return rows.mapInArrow(_drop(min_chars), schema)


def line_report(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines (before), n_dropped and the kept text of each row of docs."""
    out = _decided(docs.select("doc_id", "text"), min_docs, min_chars, batches, "text")
    return out.select("row.doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_text"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """docs with the kept text in place of text."""
    out = _decided(docs, min_docs, min_chars, batches, "text")
    return out.select(*unwrapped(docs.columns, text=F.col("kept")))
