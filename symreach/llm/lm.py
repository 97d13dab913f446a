"""Language-model scores: a causal self-attention model over subword ids, trained in numpy, beside a word-count base.

Text is lower-cased (A-Z) first, as for the base. A subword's probability starts from how often it follows the one before it
(absolute discounting over all training texts, for the FREQUENT_IDS most frequent ids; the others are one id, divided by their counts). A causal
attention layer over a window of CONTEXT + STRIDE ids and a tanh layer give weights to CLASSES classes of ids with like neighbours, by which
those shares are multiplied and made a distribution again, so that what the window holds beyond the last id tells. Windows overlap by CONTEXT ids and each id
is scored once, in the window in which it is among the last STRIDE, in batches with a causal mask.

What is counted (words, ids, pairs of neighbours) is counted over all training texts by distributed sums; the driver gets a number of cells that
the vocabulary bounds. The weights start from a fit of WINDOWS windows, by hash, in the driver; where there are more, trainers, tasks with a part
of the training windows each, go on from there over every training window once, and the mean of their weights is the model. There is a trainer
for TRAINER_WINDOWS windows, MOST_TRAINERS at most. The base
counts words over all training texts; the FREQUENT most frequent are broadcast, the others joined.

Null or empty text: the closing token alone. Repeated rows: each is scored (and counted in training). Null doc_id: never held
out. No training text: uniform shares. Words are told apart by 64 bits of a hash. Very long texts: cut into windows, never shortened. Ties in counts go to the
smaller id. Empty tables: no rows. Other columns, of any name, are ignored."""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .langid import fold
from .packing import tokenizer
from .shingles import mix, text_slices, word_hashes

CONTEXT, STRIDE, CLASSES, WIDTH, HIDDEN = 8, 24, 40, 16, 32
WINDOWS, STEPS, BATCH, RATE, SEED = 8192, 800, 192, 0.006, 7
#: The share of all training windows that trainers learn from (1: every one), their rate, windows for each trainer and the most trainers.
SHARE, TRAINER_RATE, TRAINER_WINDOWS, MOST_TRAINERS = 1.0, 0.002, 8192, 512
#: Words are counted in 2 ** RANGE_BITS ranges of their hashes; texts are looked up in groups of so many bytes.
RANGE_BITS, GROUP_BYTES = 9, 16 << 20
#: Texts whose words are looked up at once, in bytes.
TOKEN_BYTES = 4 << 20
#: Bytes of texts that are hashed at once: what is made of them stays in a core's cache.
HASH_BYTES = 1 << 18
#: Windows that are dealt out to trainers at once, in a row for each that gets some.
DEAL = 16_384
IDS, FREQUENT, FREQUENT_IDS = 50_257, 1 << 18, 2_048
#: Ids, the most frequent, that count as neighbours, and what is taken off each count of a pair.
NEAR, DISCOUNT = 384, 0.6
END, START = IDS, IDS + 1
LENGTH = CONTEXT + STRIDE
LN10 = float(np.log(10))
#: Exponents up to this can't pass single precision, even in sums.
SAFE = 60.0


# --- tokens -------------------------------------------------------------------------------------------------

TOKENS = "doc_id long, held_out boolean, learnt boolean, k1 long, k2 long, ids binary"


def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(5), TOKEN_BYTES):
                # Bytes' lower() changes A-Z alone.
                ids, bounds = tok.column(np.frombuffer(data.tobytes().lower(), np.uint8), offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(5)), _runs(ids.astype("<u2"), bounds)], ["doc_id", "held_out", "learnt", "k1", "k2", "ids"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the folds and a key of 128 bits, the same for rows that are alike."""
    held = fold(F.col("doc_id"), 7) == 2
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), (~held).alias("learnt"), F.xxhash64(F.lit(1), "doc_id", text).alias("k1"), F.xxhash64(F.lit(2), "doc_id", text).alias("k2"), text.alias("text"))


# --- the base -----------------------------------------------------------------------------------------------

def _runs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column: the bytes of values[bounds[i] : bounds[i + 1]] for each i."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _range_bounds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of sorted words that are not empty, and where each begins, with the end behind."""
    bounds = np.searchsorted(words, np.arange(1, 1 << RANGE_BITS, dtype=np.uint64) << np.uint64(64 - RANGE_BITS))
    bounds = np.concatenate(([0], bounds, [len(words)]))
    full = np.flatnonzero(np.diff(bounds))
    return full, np.append(bounds[full], len(words))


COUNTS = "range long, words binary, n binary"


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text to COUNTS: for each range its words, sorted, and their numbers, summed over about 32 MB of text at a time."""
    held: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        full, bounds = _range_bounds(values)
        return pa.RecordBatch.from_arrays([pa.array(full), _runs(values, bounds), _runs(n.astype(np.int64), bounds)], ["range", "words", "n"])

    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column(0), HASH_BYTES):
            held.append(word_hashes(data, offsets)[0])
            size += len(held[-1])
            if size > 6_000_000:
                yield out()
                held, size = [], 0
    if size:
        yield out()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for a in range(0, len(batch), 64):
            yield from zip(*(batch.column(i).slice(a, 64).to_pylist() for i in range(batch.num_columns)))


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTS by range to COUNTS, one row for each range."""
    for name, rows in groupby(_rows(batches), lambda r: r[0]):
        words, n = zip(*(r[1:] for r in rows))
        words, n = np.frombuffer(b"".join(words), np.uint64), np.frombuffer(b"".join(n), np.int64)
        order = np.argsort(words, kind="stable")
        words, n = words[order], n[order]
        heads = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([words[heads].tobytes()], pa.binary()), pa.array([np.add.reduceat(n, heads).tobytes()], pa.binary())], ["range", "words", "n"])


def _count_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n to (times, kinds): how many words stand so often."""
    for (n,) in _rows(batches):
        times, kinds = np.unique(np.frombuffer(n, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(times), pa.array(kinds)], ["times", "kinds"])


def _at_least(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(words, n) to those words that stand `least` times or more."""
        for words, n in _rows(batches):
            n = np.frombuffer(n, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(x, np.int64)[n >= least].tobytes()], pa.binary()) for x in (words, n.tobytes())], ["words", "n"])

    return run


#: A lone row holds a group's texts: their keys (a, b), sums over frequent words (c), known words (d) and numbers of words (e). Others hold, for a range, places in the group (a), words (b) and how often each stands there (c).
PARTS = "range long, texts long, lone boolean, a binary, b binary, c binary, d binary, e binary"
PART_NAMES = [x.split()[0] for x in PARTS.split(", ")]


class Places:
    """np.searchsorted(words, ...) for sorted hashes: a table by their first bits leaves a few steps for each."""

    def __init__(self, words: np.ndarray):
        bits = min(20, len(words).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.heads = np.searchsorted(words, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.words = np.append(words, np.uint64(2**64 - 1))

    def of(self, own: np.ndarray) -> np.ndarray:
        at = self.heads[(own >> self.shift).astype(np.int64)]
        more = np.flatnonzero(self.words[at] < own)
        while len(more):
            at[more] += 1
            more = more[self.words[at[more]] < own[more]]
        return at


def _base_parts(shared, n_all: int, n_kinds: int):
    """(k1, k2, text) to PARTS: for each group of texts, of about GROUP_BYTES, a lone row and a row for each range of the words that are not frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, end = shared.value
        logs = np.log10((counts + 1) / (n_all + n_kinds + 1))
        end_part = np.log10((end + 1) / (n_all + n_kinds + 1))
        places = Places(words)
        lone: list[tuple] = []
        rare: list[tuple] = []
        size, texts, group = 0, 0, TaskContext.get().partitionId() << 32

        def out() -> Iterator[pa.RecordBatch]:
            own = [np.concatenate(x) for x in zip(*lone)]
            yield pa.RecordBatch.from_arrays([pa.array([group % (1 << RANGE_BITS)]), pa.array([group]), pa.array([True]), *(pa.array([x.tobytes()], pa.binary()) for x in own)], PART_NAMES)
            at, word, times = (np.concatenate(x) for x in zip(*rare))
            order = np.argsort(word, kind="stable")
            full, bounds = _range_bounds(word[order])
            if len(full):
                none = pa.nulls(len(full), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(full), pa.array([group] * len(full)), pa.array([False] * len(full)), *(_runs(x[order], bounds) for x in (at, word, times)), none, none], PART_NAMES)

        for batch in batches:
            heads = [np.array(batch.column(i), np.int64) for i in range(2)]
            for a, b, data, offsets in text_slices(batch.column(2), HASH_BYTES):
                own, bounds = word_hashes(data, offsets)
                row = np.repeat(np.arange(b - a), np.diff(bounds))
                at = np.minimum(places.of(own), max(len(words) - 1, 0))
                hit = words[at] == own if len(words) else np.zeros(len(own), bool)
                part = np.bincount(row[hit], logs[at[hit]], b - a) + end_part
                known = np.bincount(row[hit], minlength=b - a) + (end > 0)
                lone.append((heads[0][a:b], heads[1][a:b], part, known.astype(np.int64), (np.diff(bounds) + 1).astype(np.int64)))
                rest, own = row[~hit], own[~hit]
                order = np.lexsort((own, rest))
                rest, own = rest[order], own[order]
                new = np.ones(len(own), bool)
                new[1:] = (rest[1:] != rest[:-1]) | (own[1:] != own[:-1])
                first = np.flatnonzero(new)
                rare.append(((rest[first] + texts).astype(np.int32), own[first], np.diff(np.append(first, len(own))).astype(np.int32)))
                size, texts = size + len(data), texts + b - a
                if size >= GROUP_BYTES:
                    yield from out()
                    lone, rare, size, texts, group = [], [], 0, 0, group + 1
        if lone:
            yield from out()

    return run


def _look_up(n_all: int, n_kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """PARTS by range, behind each range's counts (texts -1, words in b and their numbers in c), to PARTS without words: sums over them (b) and known ones (c) at places (a)."""
        name, words, counts, held = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        kinds = pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 5
        out = lambda: pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*held), kinds)], PART_NAMES)
        for row in _rows(batches):
            if row[0] != name:
                name, words, counts = row[0], np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if row[1] == -1:
                words, counts = np.frombuffer(row[4], np.uint64), np.frombuffer(row[5], np.int64)
                continue
            if not row[2]:
                at, own, times = (np.frombuffer(x, kind) for x, kind in zip(row[3:6], (np.int32, np.uint64, np.int32)))
                place = np.minimum(np.searchsorted(words, own), max(len(words) - 1, 0))
                found = np.where(words[place] == own, counts[place], 0) if len(words) else np.zeros(len(own), np.int64)
                log, known = times * np.log10((found + 1) / (n_all + n_kinds + 1)), np.where(found > 0, times, 0).astype(np.int64)
                row = (*row[:4], log.tobytes(), known.tobytes(), None, None)
            held.append(row)
            if len(held) == 64:
                yield out()
                held.clear()
        if held:
            yield out()

    return run


SUMS = "k1 long, k2 long, base_score double, n_known long, n_tokens long"


def _base_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _look_up(), a group's together, its lone row first, to SUMS of its texts."""
    for _, rows in groupby(_rows(batches), lambda r: r[1]):
        first = next(rows)
        k1, k2, score, known, n = (np.frombuffer(x, kind).copy() for x, kind in zip(first[3:], (np.int64, np.int64, float, np.int64, np.int64)))
        for r in rows:
            at = np.frombuffer(r[3], np.int32).astype(np.int64)
            np.add.at(score, at, np.frombuffer(r[4]))
            np.add.at(known, at, np.frombuffer(r[5], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, score, known, n)], [x.split()[0] for x in SUMS.split(", ")])


def base_scores(keyed: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """k1, k2 (distinct), base_score, n_known, n_tokens, train_tokens.

    Words are counted, and what is not frequent is looked up, in 2 ** RANGE_BITS ranges of their hashes. Rows hold many words each, so that
    the shuffles cost by bytes and not by words."""
    counts = cut(keyed.where("learnt").select("text").mapInArrow(_word_counts, COUNTS).repartition("range").sortWithinPartitions("range").mapInArrow(_sum_counts, COUNTS))
    spread = counts.select("n").mapInArrow(_count_kinds, "times long, kinds long").groupBy("times").agg(F.sum("kinds").alias("kinds")).orderBy(F.desc("times")).toArrow()
    times, kinds = (np.array(spread[c], np.int64) for c in ("times", "kinds"))
    end = keyed.where("learnt").count()
    n_all, n_kinds = int((times * kinds).sum()) + end, int(kinds.sum()) + (end > 0)
    # The bound of what is broadcast: `frequent` words, those that stand so often that no more do. The others are looked up by range.
    fit = int((np.cumsum(kinds) <= frequent).sum())
    top = counts.select("words", "n").mapInArrow(_at_least(int(times[fit - 1])), "words binary, n binary").toArrow() if fit else None
    words, n = (np.frombuffer(b"".join(top[c].to_pylist()) if top else b"", kind) for c, kind in (("words", np.uint64), ("n", np.int64)))
    order = np.argsort(words)
    shared = keyed.sparkSession.sparkContext.broadcast((words[order], n[order], end))
    none = F.lit(None).cast("binary")
    known = counts.select("range", F.lit(-1).cast("long").alias("texts"), F.lit(False).alias("lone"), none.alias("a"), F.col("words").alias("b"), F.col("n").alias("c"), none.alias("d"), none.alias("e"))
    parts = keyed.select("k1", "k2", "text").mapInArrow(_base_parts(shared, n_all, n_kinds), PARTS).unionByName(known).repartition("range").sortWithinPartitions("range", "texts")
    found = parts.mapInArrow(_look_up(n_all, n_kinds), PARTS).repartition("texts").sortWithinPartitions("texts", F.desc("lone"), "range")
    # Rows that are alike have the same sums.
    return found.mapInArrow(_base_sums, SUMS).dropDuplicates(["k1", "k2"]).withColumn("train_tokens", F.lit(n_all).cast("long"))


# --- the model ----------------------------------------------------------------------------------------------

def ranks(counts: np.ndarray, frequent: int) -> np.ndarray:
    """Each id's place by falling count; `frequent` for all from there on, and for START."""
    out = np.full(len(counts) + 1, frequent, np.int64)
    out[np.argsort(-counts, kind="stable")[:frequent]] = np.arange(min(frequent, len(counts)))
    return out


def pairs_of(rank: np.ndarray, ids: np.ndarray, frequent: int) -> np.ndarray:
    """(frequent + 1) ** 2 counts: how often each rank stands before each other one in ids, in which START leads every text."""
    own = rank[ids]
    cells = own[:-1] * (frequent + 1)
    cells += own[1:]
    # What stands before a START goes into one cell more.
    cells[ids[1:] == START] = (frequent + 1) ** 2
    return np.bincount(cells, minlength=(frequent + 1) ** 2 + 1)[:-1]


def beside(pairs: np.ndarray, near: int = NEAR) -> np.ndarray:
    """(frequent, 2 * near): how often each of the first `near` ids stands before (or, in the second half, after) each frequent one. pairs: a square of counts."""
    near = min(near, len(pairs) - 1)
    return np.concatenate((pairs[:near, :-1].T, pairs[:-1, :near]), axis=1)


def shares_after(pairs: np.ndarray, counts: np.ndarray, discount: float = DISCOUNT) -> np.ndarray:
    """(ranks, ranks): the share of each rank after each, discounted pairs with what is taken off going by the counts of the ranks."""
    base = (counts + 0.5) / (counts + 0.5).sum()
    total, kinds = pairs.sum(axis=1, keepdims=True), (pairs > 0).sum(axis=1, keepdims=True)
    # As if each rank had been seen once more before any, in proportion to the counts.
    return ((np.maximum(pairs - discount, 0) + (discount * kinds + 1) * base) / (total + 1)).astype(np.float32)


def classes_of(counts: np.ndarray, seen: np.ndarray, classes: int = CLASSES, seed: int = SEED) -> np.ndarray:
    """The class of each rank, by the ids beside it: weighted k-means over square roots of their shares."""
    seen = seen.astype(np.float32)
    seen = np.sqrt(seen / np.maximum(seen.sum(axis=1, keepdims=True), 1))
    weight = counts.astype(np.float64) ** 0.5 + 1
    r = np.random.default_rng(seed)
    likely = min(4 * classes, len(counts))
    middle = seen[np.argsort(-weight, kind="stable")[:likely]][r.permutation(likely)[:classes]]
    for _ in range(12):
        near_to = (seen @ middle.T - (middle * middle).sum(axis=1) / 2).argmax(axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, near_to, seen * weight[:, None].astype(np.float32))
        mass = np.bincount(near_to, weight, len(middle))
        middle = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-9)[:, None], middle).astype(np.float32)
    return near_to


_rooms: dict[tuple, np.ndarray] = {}


def room(name: str, kind: np.dtype, *shape: int) -> np.ndarray:
    """An array to be filled, in memory that the next call of this name uses again: large arrays made and freed at each step cost more in page faults than the sums in them."""
    size = math.prod(shape)
    if (held := _rooms.get((name, kind))) is None or held.size < size:
        held = _rooms[name, kind] = np.empty(size, kind)
    return held[:size].reshape(shape)


class ClassModel:
    """P(next id | the window so far): shares after the last id, weighted by classes, and the maps from ids to inputs and classes."""

    def __init__(self, counts: np.ndarray, pairs: np.ndarray | None = None, seed: int = SEED, classes: int = CLASSES, width: int = WIDTH, hidden: int = HIDDEN):
        frequent = min(FREQUENT_IDS, len(counts) - 1)
        rank = ranks(counts, frequent)
        pairs = np.zeros((frequent + 1, frequent + 1), np.int64) if pairs is None else pairs
        own = np.bincount(rank[:-1], counts, frequent + 1)
        # Frequent ids in classes by their neighbours; the last class is the one rank that the other ids share.
        self.class_of = np.append(classes_of(own[:frequent], beside(pairs), classes - 1), classes - 1)
        self.rank = rank
        rest = np.where(rank[:-1] == frequent, counts + 1.0, 0)
        self.within = np.log(np.where(rank[:-1] == frequent, rest / max(rest.sum(), 1e-9), 1)).astype(np.float32)
        after = shares_after(pairs, own)
        sums = np.stack([after[:, self.class_of == c].sum(axis=1) for c in range(classes)], axis=1)
        self.class_after = np.log(np.maximum(sums, 1e-30)).astype(np.float32)
        self.after = (np.log(after) - self.class_after[:, self.class_of]).astype(np.float32)
        # Each frequent id is an input, the others are one; then START.
        self.input_of = np.append(rank[:-1], frequent + 1)
        self.frequent = frequent
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * (0.5 if len(s) == 2 and s[0] > 1000 else s[0] ** -0.5)).astype(np.float32)
        self.p = {"E": f(frequent + 2, width), "P": f(LENGTH, width) * 0.3, "Q": f(width, width), "K": f(width, width), "V": f(width, width), "O": f(width, hidden), "S": f(width, hidden), "b": np.zeros(hidden, np.float32), "W": f(hidden, classes) * 0.1, "c": np.zeros(classes, np.float32)}
        causal = np.arange(LENGTH)[None, :] <= np.arange(CONTEXT, LENGTH)[:, None]
        self.mask, self.causal = np.where(causal, 0, -1e9).astype(np.float32), causal.astype(np.float32)

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """(what q @ k.T is between two inputs, what an input that attention finds brings to the hidden layer): of Q and K, and of V and O, only the products tell."""
        p = self.p
        return (p["Q"] * np.float32(p["Q"].shape[0] ** -0.5)) @ p["K"].T, p["V"] @ p["O"]

    def tables(self) -> tuple:
        """What attend(), forward() and lower() take of the weights alone, until the next call."""
        p, d, kind = self.p, self.p["Q"].shape[0], np.dtype(self.p["E"].dtype.type)
        between, brought = self.products()
        # A last column of ones gives each row's sum with the same product.
        named, place = room("named", kind, len(p["E"]), d + 1), np.zeros((LENGTH, d + 1), kind)
        named[:, :d], named[:, d], place[:, :d] = p["E"], 1, p["P"]
        kind = np.dtype(np.result_type(self.class_after, p["c"]).type)
        before = np.add(self.class_after, p["c"], out=room("classes", kind, *self.class_after.shape))
        # The shares' logs lie between -70 and 0, one of them near 0.
        steep = (np.abs(p["W"]).sum(axis=0) + np.abs(p["c"])).max() > SAFE
        # No product of a query and a key passes what the lengths of the longest allow.
        longest = lambda x: float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0)))
        far = not (longest(p["E"] @ between) + longest(p["P"] @ between)) * (longest(p["E"]) + longest(p["P"])) <= SAFE
        return between, brought, named, place, np.concatenate((brought, p["b"][None], p["S"])), far, before, steep

    def attend(self, inputs: np.ndarray, tables: tuple):
        """inputs (n, LENGTH) of input numbers to the hidden layer (n * STRIDE, hidden) and what the gradients need, until the next call."""
        p, n, d, kind = self.p, len(inputs), self.p["Q"].shape[0], np.dtype(self.p["E"].dtype.type)
        between, brought, named, place, mixing, far = tables[:6]
        x = named.take(inputs, axis=0, out=room("x", kind, n, LENGTH, d + 1), mode="clip")
        x += place
        # What attention finds, a one, and the place's own input.
        both = room("both", kind, n, STRIDE, 2 * d + 1)
        both[:, :, d + 1 :] = x[:, CONTEXT:, :d]
        flat = both.reshape(n * STRIDE, 2 * d + 1)
        q = np.matmul(flat[:, d + 1 :], between, out=room("q", kind, n * STRIDE, d)).reshape(n, STRIDE, d)
        a = np.matmul(q, x[:, :, :d].transpose(0, 2, 1), out=room("a", kind, n, STRIDE, LENGTH))
        if far and max(a.max(initial=0), -a.min(initial=0)) > SAFE:
            a -= (a + self.mask).max(axis=2, keepdims=True)
            np.minimum(a, SAFE, out=a)
        np.exp(a, out=a)
        a *= self.causal
        o = np.matmul(a, x, out=room("o", kind, n, STRIDE, d + 1))
        total = o[:, :, d:]
        np.divide(o, total, out=both[:, :, : d + 1])
        h = np.matmul(flat, mixing, out=room("h", kind, n * STRIDE, len(p["b"])))
        np.tanh(h, out=h)
        return h, (flat, x, q, a, total, between, brought)

    def forward(self, inputs: np.ndarray, tables: tuple | None = None):
        """inputs (n, LENGTH) of input numbers to class logits (n * STRIDE, classes), where exp() could pass single precision less each row's largest, and what the gradients need, until the next call."""
        tables = self.tables() if tables is None else tables
        before, steep = tables[6:]
        h, kept = self.attend(inputs, tables)
        size = len(h), len(self.p["c"])
        logits = np.matmul(h, self.p["W"], out=room("logits", np.dtype(h.dtype.type), *size))
        logits += before.take(np.minimum(inputs[:, CONTEXT:], self.frequent).ravel(), axis=0, out=room("before", np.dtype(before.dtype.type), *size), mode="clip")
        if steep:
            logits -= logits.max(axis=1, keepdims=True)
        return logits, (h, *kept)

    def log_probabilities(self, inputs: np.ndarray, targets: np.ndarray, tables: tuple | None = None) -> np.ndarray:
        """Natural logs, (n, STRIDE), of targets (ids) given inputs."""
        logits, _ = self.forward(inputs, tables)
        last, goal = np.minimum(inputs[:, CONTEXT:], self.frequent).ravel(), self.rank.take(targets.ravel())
        picked = logits.reshape(-1).take(np.arange(0, logits.size, logits.shape[1]) + self.class_of.take(goal))
        np.exp(logits, out=logits)
        return (picked - np.log(logits @ np.ones(logits.shape[1], logits.dtype)) + self.after[last, goal] + self.within[targets.ravel()]).reshape(targets.shape)

    def step(self, inputs: np.ndarray, targets: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over real targets, and its gradients."""
        p, n, d, kind = self.p, len(inputs), self.p["Q"].shape[0], np.dtype(self.p["E"].dtype.type)
        logits, (h, both, x, q, a, total, between, brought) = self.forward(inputs)
        hidden = h.shape[1]
        goal, w = self.class_of[self.rank[targets.ravel()]], real.ravel().astype(kind)
        w /= max(w.sum(), 1)
        at, ones = np.arange(0, logits.size, logits.shape[1]) + goal, np.ones(len(goal), kind)
        picked = logits.reshape(-1).take(at)
        g = np.exp(logits, out=logits)
        mass = g @ np.ones(g.shape[1], kind)
        loss = float(((np.log(mass) - picked) * w).sum())
        g *= (w / mass)[:, None]
        g.reshape(-1)[at] -= w
        grad = {"W": h.T @ g, "c": ones @ g}
        # Gradients of the hidden layer's sums and, behind them, of q.
        back = room("back", kind, n, STRIDE, hidden + d)
        flat = back.reshape(n * STRIDE, hidden + d)
        gh = np.matmul(g, p["W"].T, out=room("gh", kind, n * STRIDE, hidden))
        h *= h
        np.subtract(1, h, out=h)
        np.multiply(gh, h, out=flat[:, :hidden])
        # A softmax's gradient takes from each share's own the sum over all of them, which is go @ o: a last column beside the ones of x.
        go = room("go", kind, n, STRIDE, d + 1)
        np.divide(np.matmul(flat[:, :hidden], brought.T, out=room("go whole", kind, n * STRIDE, d)).reshape(n, STRIDE, d), total, out=go[:, :, :d])
        np.negative(np.einsum("ij,ij->i", go.reshape(-1, d + 1)[:, :d], both[:, :d]), out=go.reshape(-1, d + 1)[:, d])
        gs = np.matmul(go, x.transpose(0, 2, 1), out=room("gs", kind, n, STRIDE, LENGTH))
        gs *= a
        np.matmul(gs, x[:, :, :d], out=back[:, :, hidden:])
        mixed = both.T @ flat
        found, asked = mixed[:d, :hidden], mixed[d + 1 :, hidden:] * np.float32(d**-0.5)
        grad |= {"b": mixed[d, :hidden], "S": mixed[d + 1 :, :hidden], "V": found @ p["O"].T, "O": p["V"].T @ found, "Q": asked @ p["K"], "K": asked.T @ p["Q"]}
        gx = np.matmul(gs.transpose(0, 2, 1), q, out=room("gx", kind, n, LENGTH, d))
        gx += np.matmul(a.transpose(0, 2, 1), go[:, :, :d], out=room("gx found", kind, n, LENGTH, d))
        gx[:, CONTEXT:] += np.matmul(flat, np.concatenate((p["S"].T, between.T)), out=room("gx own", kind, n * STRIDE, d)).reshape(n, STRIDE, d)
        grad["P"] = (np.ones(n, kind) @ gx.reshape(n, -1)).reshape(LENGTH, d)
        # Of one dtype object, which a pickled array's is not: add.at() takes many times as long otherwise.
        grad["E"] = np.zeros(p["E"].shape, kind)
        # Two numbers at once, as a complex one: sums are the same, with half as many places.
        two = kind if d % 2 else np.dtype(np.result_type(kind, np.complex64).type)
        wide = d * kind.itemsize // two.itemsize
        cells = np.arange(grad["E"].size * kind.itemsize // two.itemsize).reshape(-1, wide).take(inputs.reshape(-1), axis=0, out=room("cells", np.dtype(np.int64), n * LENGTH, wide), mode="clip")
        np.add.at(grad["E"].reshape(-1).view(two), cells.reshape(-1), gx.reshape(-1).view(two))
        return loss, grad

    def fit(self, windows: np.ndarray, steps: int = STEPS, rate: float = RATE, seed: int = SEED, least: float = 0.1, once: bool = False) -> ClassModel:
        """windows (n, LENGTH + 1) of ids: each place's next id is its target. Adam, at a rate that falls to `least` of the first. once: steps take every window once, else BATCH of them by chance."""
        if not len(windows):
            return self
        r = np.random.default_rng(seed)
        parts = np.array_split(r.permutation(len(windows)), steps) if once else None
        # All weights lie in one array, in which self.p names places.
        flat = np.concatenate([v.ravel() for v in self.p.values()])
        a, b, g, tenth = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
        ends = np.cumsum([v.size for v in self.p.values()])
        places = lambda whole: {k: x.reshape(v.shape) for (k, v), x in zip(self.p.items(), np.split(whole, ends[:-1]))}
        into, self.p = places(g), places(flat)
        for t in range(1, steps + 1):
            pick = windows[parts[t - 1] if once else r.integers(0, len(windows), BATCH)]
            # Windows at a text's end hold END over and over; only the first counts.
            goal = pick[:, CONTEXT + 1 :]
            real = np.concatenate((np.ones((len(pick), 1), bool), goal[:, :-1] != END), axis=1)
            _, grad = self.step(self.input_of[pick[:, :-1]], goal, real)
            now = rate * min(1, t / 30) * (least + (1 - least) * (1 - t / steps))
            for k, v in grad.items():
                into[k][...] = v
            a *= np.float32(0.9)
            a += np.multiply(g, np.float32(0.1), out=tenth)
            b *= np.float32(0.99)
            g *= g
            g *= np.float32(0.01)
            b += g
            np.sqrt(b, out=g)
            g *= np.float32((1 - 0.99**t) ** -0.5)
            g += np.float32(1e-8)
            np.divide(a, g, out=g)
            g *= np.float32(now / (1 - 0.9**t))
            flat -= g
        return self

    def packed(self) -> bytes:
        """All weights, in the order of their names."""
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)]).astype(np.float32).tobytes()

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            self.p[k] = flat[at : at + self.p[k].size].reshape(self.p[k].shape).astype(np.float32)
            at += self.p[k].size


def places_of(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """START..., the ids, END, END... of each text in one array, and of each window its start there, its text and its number in the text."""
    counts = np.array([-(-(len(x) + 1) // STRIDE) for x in ids], np.int64)
    padded = np.full(int(counts.sum()) * STRIDE + len(ids) * (CONTEXT + 1), END, np.int32)
    at, firsts = 0, np.zeros(len(ids), np.int64)
    for i, x in enumerate(ids):
        padded[at : at + CONTEXT + 1] = START
        padded[at + CONTEXT + 1 : at + CONTEXT + 1 + len(x)] = x
        firsts[i] = at
        at += CONTEXT + 1 + counts[i] * STRIDE
    text = np.repeat(np.arange(len(ids)), counts)
    within = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return padded, firsts[text] + within * STRIDE, text, within


def windows_of(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """((n, LENGTH + 1) windows over START..., ids, END, END..., the text of each): window w of a text scores its ids w * STRIDE to (w + 1) * STRIDE - 1, END included."""
    padded, start, text, _ = places_of(ids)
    return padded[start[:, None] + np.arange(LENGTH + 1)], text


def score_texts(model: ClassModel, ids: list[np.ndarray], at_once: int = 192) -> np.ndarray:
    """log10 of each text's probability, its end included; each id is scored once."""
    windows, text = windows_of(ids)
    out, tables = np.zeros(len(ids)), model.tables()
    for a in range(0, len(windows), at_once):
        w = windows[a : a + at_once]
        goal = w[:, CONTEXT + 1 :]
        logs = model.log_probabilities(model.input_of.take(w[:, :-1]), goal, tables)
        # END repeats up to the window's end; its first place counts.
        logs[:, 1:][goal[:, :-1] == END] = 0
        out += np.bincount(text[a : a + at_once], logs.sum(axis=1, dtype=np.float64), len(ids))
    return out / LN10


def _id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each id stands in the texts; as id -1, how many windows they have."""
    total, windows = np.zeros(IDS + 1, np.int64), 0
    for batch in batches:
        column = batch.column(0)
        for a in range(0, len(column), 500):
            part = column.slice(a, 500).to_pylist()
            total[:IDS] += np.bincount(np.frombuffer(b"".join(part), np.uint16), minlength=IDS)
            total[END] += len(part)
            windows += sum(-(-(len(x) // 2 + 1) // STRIDE) for x in part)
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, -1)), pa.array(np.append(total[ids], windows))], ["id", "n"])


def _pairs(shared, frequent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """ids to (cell, n), the cells of pairs_of() that are not 0; a text starts with START and ends in END."""
        total = np.zeros((frequent + 1) ** 2, np.int64)
        first, last = np.array([START], "<u2").tobytes(), np.array([END], "<u2").tobytes()
        for batch in batches:
            column = batch.column(0)
            for a in range(0, len(column), 2000):
                flat = np.frombuffer(b"".join(first + x + last for x in column.slice(a, 2000).to_pylist()), "<u2")
                total += pairs_of(shared.value, flat, frequent)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    return run


def _some_windows(rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k1, ids) to (k1, window): of all windows of a text those that the hash names."""
        most = np.uint64(min(int(rate * 2**64), 2**64 - 1))
        for batch in batches:
            heads, column = np.array(batch.column(0), np.int64), batch.column(1)
            for b in range(0, len(column), 100):
                padded, start, text, within = places_of([np.frombuffer(x, np.uint16) for x in column.slice(b, 100).to_pylist()])
                own = heads[b : b + 100][text]
                named = np.flatnonzero(mix(own.view(np.uint64) + within.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) <= most)
                out = padded.astype("<u2")[start[named][:, None] + np.arange(LENGTH + 1)]
                offsets = np.arange(len(named) + 1, dtype=np.int64) * 2 * (LENGTH + 1)
                windows = pa.Array.from_buffers(pa.large_binary(), len(named), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([pa.array(own[named]), windows.cast(pa.binary())], ["k1", "window"])

    return run


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int32 if column.type == pa.binary() else np.int64)[column.offset : column.offset + len(column) + 1]


def packed_counts(column: pa.Array) -> np.ndarray:
    """How many windows each row holds."""
    return np.diff(_offsets(column)) // (2 * (LENGTH + 1)) if len(column) else np.zeros(0, np.int64)


def packed_rows(column: pa.Array) -> np.ndarray:
    """(n, LENGTH + 1) ids of windows as _some_windows() and _dealt() write them, a copy."""
    offsets = _offsets(column)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), "<u2").reshape(-1, LENGTH + 1)


def window_hashes(rows: np.ndarray) -> np.ndarray:
    """64 bits for each window, by its ids."""
    odd = np.random.default_rng(LENGTH).integers(1, 2**63, LENGTH + 1, dtype=np.uint64) | np.uint64(1)
    return mix(rows.astype(np.uint64) @ odd)


DEALT = "trainer long, window binary, block long"


def _dealt(some, trainers: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k1, ids) to (trainer, window, block): the windows that some() names, dealt out by hash. A row holds all windows of a trainer's block among some DEAL."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            rows, place = (np.concatenate([x[i] for x in held]) for i in range(2))
            order = np.argsort(place, kind="stable")
            place = place[order]
            heads = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            ends = np.append(heads, len(rows)).astype(np.int32) * rows.shape[1] * rows.itemsize
            column = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(rows[order])])
            return pa.RecordBatch.from_arrays([pa.array(place[heads] // blocks), column, pa.array(place[heads] % blocks)], ["trainer", "window", "block"])

        for batch in some(batches):
            rows = packed_rows(batch.column(1))
            named = mix(window_hashes(rows) + np.array(batch.column(0), np.int64).view(np.uint64))
            held.append((rows, (named % np.uint64(trainers * blocks)).astype(np.int64)))
            size += len(rows)
            if size >= DEAL:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return run


def _trainers(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(trainer, window or several, block or none), a trainer's rows together and in them a block's, to (trainer, weights, n) of each trainer, after one pass over its windows."""
        name, own, held, n, kept, model = None, None, [], 0, 0, None

        def done() -> Iterator[pa.RecordBatch]:
            if name is not None:
                learn()
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([model.packed()], pa.binary()), pa.array([n])], ["trainer", "weights", "n"])

        def learn() -> None:
            nonlocal kept
            if held:
                rows = np.concatenate(held)
                # The order in which a block's rows come does not matter.
                rows = rows[np.argsort(window_hashes(rows), kind="stable")].astype(np.int32)
                model.fit(rows, -(-len(rows) // BATCH), TRAINER_RATE, SEED + n, 0.3, once=True)
            held.clear()
            kept = 0

        for batch in batches:
            windows, ends = packed_rows(batch.column(1)), np.cumsum(packed_counts(batch.column(1)))
            trainers, blocks = (np.array(batch.column(i)) if i < batch.num_columns else np.zeros(len(batch), np.int64) for i in (0, 2))
            heads = np.flatnonzero((np.diff(trainers, prepend=-1) != 0) | (np.diff(blocks, prepend=-1) != 0))
            for i, j in zip(heads, [*heads[1:], len(batch)]):
                if trainers[i] != name:
                    yield from done()
                    name, own, n, kept, model = int(trainers[i]), int(blocks[i]), 0, 0, copy.copy(shared.value)
                    model.p = {k: v.copy() for k, v in model.p.items()}
                    held.clear()
                elif blocks[i] != own:
                    learn()
                    own = int(blocks[i])
                rows = windows[ends[i - 1] if i else 0 : ends[j - 1]]
                while len(rows):
                    part, rows = rows[: 8 * TRAINER_WINDOWS - kept], rows[8 * TRAINER_WINDOWS - kept :]
                    held.append(part)
                    n, kept = n + len(part), kept + len(part)
                    if kept >= 8 * TRAINER_WINDOWS:
                        learn()
        yield from done()

    return run


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(trainer, weights, n) to one row: the mean of the weights, each counting by its n, as doubles."""
    total, n = None, 0
    for batch in batches:
        for weights, k in zip(*(batch.column(i).to_pylist() for i in (1, 2))):
            own = np.frombuffer(weights, np.float32).astype(float) * k
            total, n = own if total is None else total + own, n + k
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([(total / n).tobytes()], pa.binary())], ["mean"])


def train(tokens: DataFrame, windows: int = WINDOWS, steps: int = STEPS) -> ClassModel:
    """A model from rows (learnt, k1, ids). The driver gets the ids' counts, their pairs' (of a fixed number of
    cells), about `windows` windows for a first fit of so many steps, and the mean of the trainers' weights."""
    own = tokens.where("learnt")
    got = own.select("ids").mapInArrow(_id_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = np.array(got["id"], np.int64), np.array(got["n"], np.int64)
    counts = np.zeros(IDS + 1, np.int64)
    counts[ids[ids >= 0]] = n[ids >= 0]
    whole = int(n[ids < 0].sum())
    frequent = min(FREQUENT_IDS, len(counts) - 1)
    context = tokens.sparkSession.sparkContext
    shared = context.broadcast(ranks(counts, frequent))
    cells = own.select("ids").mapInArrow(_pairs(shared, frequent), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros((frequent + 1) ** 2, np.int64)
    pairs[np.array(cells["cell"], np.int64)] = np.array(cells["n"], np.int64)
    some = lambda rate: own.select("k1", "ids").mapInArrow(_some_windows(rate), "k1 long, window binary")
    first = sorted(some(min(1.0, windows / max(whole, 1))).select("window").toArrow()["window"].to_pylist())
    rows = np.frombuffer(b"".join(first), "<u2").reshape(-1, LENGTH + 1).astype(np.int32)
    model = ClassModel(counts, pairs.reshape(frequent + 1, -1)).fit(rows, steps)
    trainers = max(1, min(MOST_TRAINERS, int(whole * SHARE) // TRAINER_WINDOWS)) if whole > len(rows) else 0
    if trainers:
        start = context.broadcast(model)
        # About 4 * TRAINER_WINDOWS windows in a block, which a trainer holds at once.
        blocks = -(-int(whole * SHARE) // (trainers * 4 * TRAINER_WINDOWS))
        dealt = own.select("k1", "ids").mapInArrow(_dealt(_some_windows(SHARE), trainers, blocks), DEALT).repartition(trainers, "trainer").sortWithinPartitions("trainer", "block")
        # Written, so that all trainers run side by side: an iterator in the driver would run them one after the other.
        learnt = cut(dealt.mapInArrow(_trainers(start), "trainer long, weights binary, n long"))
        for r in learnt.repartition(1).sortWithinPartitions("trainer").mapInArrow(_mean, "mean binary").collect():
            model.put(np.frombuffer(r["mean"], float))
    return model


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids = batch.column(batch.schema.names.index("ids"))
            out = np.zeros(len(batch))
            for b in range(0, len(batch), 200):
                part = [np.frombuffer(x, np.uint16) for x in ids.slice(b, 200).to_pylist()]
                out[b : b + len(part)] = score_texts(model, part)
            rest = [i for i, x in enumerate(batch.schema.names) if x != "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(out)], [*(batch.schema.names[i] for i in rest), "score"])

    return run


def lm_scores(docs: DataFrame, tokenizer_path: str, windows: int = WINDOWS, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text)."""
    keyed = _keyed(docs)
    tokens = cut(keyed.mapInArrow(_tokens(tokenizer_path), TOKENS))
    model = train(tokens, windows, steps)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = tokens.select("doc_id", "held_out", "k1", "k2", "ids").mapInArrow(_scores(shared), "doc_id long, held_out boolean, k1 long, k2 long, score double")
    both = scored.join(base_scores(keyed), ["k1", "k2"])
    return both.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
