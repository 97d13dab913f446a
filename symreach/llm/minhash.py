"""MinHash near-duplicates: banded candidates, odd-sketch pruning, links confirmed on full sets.

Documents with equal shingle sets form a class; all work after the first pass is on classes. Each class
has `BANDS * ROWS` minima over its shingles. A bucket is all classes that share one band's minima. Of
buckets with the same members one is kept. A bucket is compared in pairs of blocks of at most about
BLOCK classes: the odd sketches (parity bitmaps of the minima, whose XOR's population count estimates
the similarity) rule out most pairs, then shared shingles are counted for the rest, and one spanning
forest of each pair of blocks is emitted. Exact copies cost nothing here, being one class; n different classes of one bucket meet in
(n / BLOCK)^2 / 2 pairs of blocks, spread over tasks, each class being sent to n / BLOCK of them. At the threshold, a link
is missed by all bands with probability (1 - 0.85**5)**26 < 3e-7 (at 0.80, which the pipeline's stage takes, below 4e-5), far less above it, and the sketch rules out
only what lies more than six standard deviations below the threshold.

Null text, empty text and text without words: an empty set, linked with nothing, its own component.
Repeated rows: each gets a row, in one component if it has words. Null doc_id: never the component's id
unless no other exists. Ties do not arise: a component has one smallest id. Very long texts: whole sets, in slices. Empty tables: no rows.
Other columns, of any name, are ignored by near_duplicates() and kept by keep_one()."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, small, unwrapped, whole_row
from .shingles import mix, shingle_sets

BANDS, ROWS, SKETCH_BITS, BLOCK = 26, 5, 512, 192
#: A shingle's stored hash; two sets of 100,000 meet by chance with probability below 6e-10.
HASH_BYTES = 8
_U = np.uint64
NO_ID = 2**63 - 1


def _multipliers(k: int) -> np.ndarray:
    return np.random.default_rng(85).integers(1, 2**63, k, dtype=np.uint64) | _U(1)


def signature(shingles: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """The minimum of each of k hash functions over a set."""
    out = np.full(k, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(out, (shingles[i : i + 2048, None] * _multipliers_130()).min(axis=0), out=out)
    return out


_cache: dict[int, np.ndarray] = {}


def _multipliers_130() -> np.ndarray:
    if 0 not in _cache:
        _cache[0] = _multipliers(BANDS * ROWS)
    return _cache[0]


def odd_sketches(signatures: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """One parity bitmap for each row of minima: bit h(k, minimum k) flips for each k."""
    n, k = signatures.shape
    at = (mix(signatures + np.arange(1, k + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) % _U(bits)).astype(np.int64)
    counts = np.zeros((n, bits), np.uint8)
    np.add.at(counts, (np.repeat(np.arange(n), k), at.ravel()), 1)
    return np.packbits(counts & 1, axis=1)


def sketch_similarity(xor_bits: np.ndarray, bits: int = SKETCH_BITS, k: int = BANDS * ROWS) -> np.ndarray:
    """The similarity that a population count of two sketches' XOR stands for."""
    share = np.minimum(2.0 * xor_bits / bits, 1 - 1e-9)
    return 1 + bits * np.log1p(-share) / (4 * k)


def _least_sketch_similarity(threshold: float, k: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> float:
    # Spread of the matches among k samples, and of the bitmap's collisions.
    spread = (threshold * (1 - threshold) / k) ** 0.5 + (1 - threshold) * k / bits / k**0.5
    return threshold - 6 * spread


def _keys(mins: np.ndarray) -> np.ndarray:
    n = len(mins)
    bands = mins.reshape(n, BANDS, ROWS)
    odd = _multipliers(ROWS + BANDS)
    return mix((mix(bands) * odd[:ROWS]).sum(axis=2, dtype=np.uint64) + odd[ROWS:][None, :]).view(np.int64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set."""
    if not len(s):
        return 0, 0
    a = int(mix(s).sum(dtype=np.uint64)) ^ len(s)
    b = int(mix(s * _U(0xA24BAED4963EE407) + _U(1)).sum(dtype=np.uint64))
    return tuple(int(x) for x in np.array([a & (2**64 - 1), b], np.uint64).view(np.int64))


FIRST = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch binary"


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, 1000):
        ids, n, f, mins = batch.column(0), [], [], []
        for s in shingle_sets(batch.column(1)):
            n.append(len(s))
            f.append(_digest(s))
            mins.append(signature(s))
        if not n:
            continue
        mins, full = np.array(mins), np.array(n) > 0
        keys = _keys(mins)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
        sketches = [x.tobytes() for x in odd_sketches(mins)]
        f = np.array(f, np.int64).reshape(-1, 2)
        none = pa.array(~full)
        yield pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.compute.if_else(none, pa.scalar(None, bands.type), bands), pa.array(sketches, pa.binary())],
            ["doc_id", "n_shingles", "f1", "f2", "bands", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f1, f2, text) to (f1, f2, shingles), where the text has that set."""
    for batch in small(batches):
        f1, f2, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for i, s in enumerate(shingle_sets(batch.column(2))):
            if _digest(s) == (f1[i], f2[i]):
                low = np.unique(s & _U(2 ** (8 * HASH_BYTES) - 1))
                out.append((f1[i], f2[i], low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["f1", "f2", "shingles"])


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return wide.view("<u8").ravel()


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many members each set of a shares with each set of b."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    row_a, row_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    out = np.zeros((len(a), len(b)), np.float64)
    for i in range(0, len(both), 8192):
        part = both[i : i + 8192]
        sides = []
        for flat, row, n in ((flat_a, row_a, len(a)), (flat_b, row_b, len(b))):
            at = np.searchsorted(part, flat)
            hit = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == flat)
            m = np.zeros((n, len(part)), np.float32)
            m[row[hit], at[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _forest(f1, f2, side, sketches, sets, percent: int) -> list[tuple[int, int, int, int]]:
    """Links that span what is linked among the classes of one pair of blocks."""
    n = len(f1)
    bits = np.frombuffer(b"".join(sketches), np.uint8).reshape(n, -1)
    sizes = np.array([len(s) // HASH_BYTES for s in sets], np.int64)
    least = _least_sketch_similarity(percent / 100)
    one_block = (side == side[0]).all()
    a = np.arange(n) if one_block else np.flatnonzero(side == side.min())
    b = a if one_block else np.flatnonzero(side != side.min())
    if len(a) == 0 or len(b) == 0 or n < 2:
        return []
    close = np.empty((len(a), len(b)), bool)
    for i, x in enumerate(a):
        z = np.bitwise_count(bits[x] ^ bits[b]).sum(axis=1, dtype=np.int64)
        s, t = np.minimum(sizes[x], sizes[b]), np.maximum(sizes[x], sizes[b])
        close[i] = (sketch_similarity(z) >= least) & (100 * s >= percent * t)
    if one_block:
        close &= a[:, None] < b[None, :]
    rows, cols = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
    if not len(rows):
        return []
    if close.sum() <= 8:
        shared = np.zeros(close.shape)
        for i, j in zip(*np.nonzero(close)):
            shared[i, j] = len(np.intersect1d(_unpack(sets[a[i]]), _unpack(sets[b[j]]), assume_unique=True))
    else:
        shared = np.zeros(close.shape)
        shared[np.ix_(rows, cols)] = shared_counts([_unpack(sets[a[i]]) for i in rows], [_unpack(sets[b[j]]) for j in cols])
    union = sizes[a][:, None] + sizes[b][None, :] - shared
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(close & (100 * shared >= percent * union))):
        x, y = find(a[i]), find(b[j])
        if x != y:
            parent[x] = y
            out.append((f1[a[i]], f2[a[i]], f1[b[j]], f2[b[j]]))
    return out


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (bucket, lo, hi); a group may go over several batches."""
        held, name = [], None

        def links() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                x = list(zip(*held))
                if out := _forest(np.array(x[0]), np.array(x[1]), np.array(x[2]), x[3], x[4], percent):
                    yield pa.RecordBatch.from_arrays([pa.array([int(y[k]) for y in out], pa.int64()) for k in range(4)], ["a1", "a2", "b1", "b2"])
            held.clear()

        for batch in small(batches):
            cols = [batch.column(k).to_pylist() for k in range(8)]
            for key in zip(*cols):
                if key[:3] != name:
                    yield from links()
                    name = key[:3]
                held.append(key[3:])
        yield from links()

    return run


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    base = cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_first, FIRST))
    full = base.where("n_shingles > 0")
    ids = full.groupBy("f1", "f2").agg(F.min("doc_id").alias("least"))
    rows = full.select("doc_id", "f1", "f2", "bands", "sketch").join(ids.withColumnRenamed("f1", "g1").withColumnRenamed("f2", "g2"), (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & F.col("doc_id").eqNullSafe(F.col("least")))
    classes = cut(rows.groupBy("f1", "f2").agg(F.first("least").alias("least"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    spread = classes.select("f1", "f2", F.explode("bands").alias("bucket"))
    several = spread.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor("f1").alias("x1"), F.bit_xor("f2").alias("x2"), F.bit_xor(F.xxhash64("f1", "f2")).alias("x3")).where("n > 1")
    several = several.groupBy("n", "x1", "x2", "x3").agg(F.min("bucket").alias("bucket"))
    members = cut(spread.join(several.select("bucket", "n"), "bucket").distinct())
    wanted = members.select("f1", "f2").distinct().join(classes.select("f1", "f2", "least", "sketch"), ["f1", "f2"])
    texts = docs.select(F.col("doc_id").cast("long").alias("least"), F.col("text").cast("string"))
    texts = wanted.withColumnRenamed("least", "own").join(texts, F.col("own").eqNullSafe(F.col("least")))
    sets = texts.select("f1", "f2", "text").mapInArrow(_sets, "f1 long, f2 long, shingles binary").groupBy("f1", "f2").agg(F.first("shingles").alias("shingles"))
    sets = cut(sets.join(wanted.select("f1", "f2", "sketch"), ["f1", "f2"]))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = members.withColumn("side", F.pmod(F.xxhash64("f1", "f2"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("bucket", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "f1", "f2", "side")
    placed = placed.join(sets, ["f1", "f2"]).select("bucket", "lo", "hi", "f1", "f2", "side", "sketch", "shingles")
    links = placed.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(_compare(percent), "a1 long, a2 long, b1 long, b2 long")

    named = classes.select("f1", "f2", F.struct(F.coalesce("least", F.lit(NO_ID)).alias("id"), "f1", "f2").alias("node"))
    pairs = links.join(named.select(F.col("f1").alias("a1"), F.col("f2").alias("a2"), F.col("node").alias("a")), ["a1", "a2"]).join(named.select(F.col("f1").alias("b1"), F.col("f2").alias("b2"), F.col("node").alias("b")), ["b1", "b2"])
    roots = components(pairs.select("a", "b")).select("node.f1", "node.f2", F.col("root.id").alias("root"))
    label = classes.select("f1", "f2", "least").join(roots, ["f1", "f2"], "left").select("f1", "f2", F.coalesce(F.nullif("root", F.lit(NO_ID)), "least").alias("component_id"))
    out = base.select("doc_id", "n_shingles", "f1", "f2").where("n_shingles > 0").join(label, ["f1", "f2"]).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(base.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs that stay when each group of near-duplicates keeps its smallest doc_id (of equal rows, one)."""
    text = F.col("text").cast("string")
    stays = near_duplicates(docs, percent).where("kept").groupBy(F.col("doc_id").alias("stays")).agg(F.count("*").alias("alike"))
    kept = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2"))
    kept = kept.join(stays, F.col("id").eqNullSafe(F.col("stays")))
    # Rows with one id and one text are one document, kept once. An id can stand for several texts, of which some are copies of other documents.
    once = kept.where("alike = 1").unionByName(kept.where("alike > 1").dropDuplicates(["id", "t1", "t2"]))
    return once.select(*unwrapped(docs.columns))
