"""Language identification with bit-sliced Bloom filters of character trigrams.

Training counts the trigrams of each language over all training rows. A language's filter gets the trigrams whose share of its
text is at least LEAST and at least CONTRAST times the largest share in any language. The filters share one array of SLOTS cells with
one bit for each language, so a trigram's k cells, ANDed, give all languages that contain it at
once. For a text the bits are summed per language, and each count is corrected for false positives,
(hits - f n) / (1 - f) with f the share of set cells to the power k. The largest corrected share decides; ties go to the
language name that sorts first.

Trigrams are taken over lower-cased letters; a run of other characters counts as one space. Null text, empty text and text
without a letter: `und`, score 0. Repeated rows: each is predicted (and counted in training). Null lang: not learnt. Null doc_id: never held
out. No learnt language: `und`. Very long texts: all their trigrams count. Empty tables: no rows. Other columns, of any name, are ignored by identify() and kept by keep_identified()."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .common import cut, small, unwrapped, whole_row
from .shingles import mix, text_slices

SLOTS, HASHES, LEAST, CONTRAST = 1 << 19, 3, 2e-6, 0.35
MOST_LANGUAGES = 1024
#: Distinct trigrams that a task counts before it passes them on.
HELD = 1 << 20
#: Clean texts score above 0.8; a text with less than this share of known trigrams is in no language learnt.
LEAST_SCORE = 0.4
_U = np.uint64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to its lower-case letter; 32 for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed trigrams, bounds of each row's) of UTF-8 bytes: each row's letters with spaces collapsed and around it."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    rows = np.searchsorted(at, offsets)
    letters = _letters()[points]
    n = len(rows) - 1
    # One space before each row, and one after the last.
    flat = np.full(len(letters) + n + 1, 32, np.uint32)
    place = np.arange(len(letters)) + np.repeat(np.arange(1, n + 1), np.diff(rows))
    flat[place] = letters
    own = np.zeros(len(flat), np.int64)
    own[rows[:-1] + np.arange(n)] = 1
    own = np.cumsum(own) - 1
    keep = np.ones(len(flat), bool)
    keep[1:] = ~((flat[1:] == 32) & (flat[:-1] == 32))
    keep[rows[:-1] + np.arange(n)] = True
    flat, own = flat[keep].astype(np.uint64), own[keep]
    grams = (flat[:-2] << _U(42)) | (flat[1:-1] << _U(21)) | flat[2:]
    # A trigram may use the next row's leading space, but no more of it.
    fine = (own[:-2] == own[1:-1]) & ((own[2:] == own[:-2]) | (flat[2:] == 32)) & (flat[1:-1] != 32)
    grams, own = grams[fine], own[:-2][fine]
    return grams, np.searchsorted(own, np.arange(n + 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n), summed over the task as far as HELD trigrams go."""
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, (grams, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
        total.clear()

    def add(lang: str, grams: np.ndarray, n: np.ndarray) -> None:
        if lang in total:
            grams, n = np.concatenate((total[lang][0], grams)), np.concatenate((total[lang][1], n))
        values, back = np.unique(grams, return_inverse=True)
        total[lang] = values, np.bincount(back, n, len(values)).astype(np.int64)

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for a, b, data, offsets in text_slices(batch.column(1)):
            grams, bounds = trigrams(data, offsets)
            per = np.diff(bounds)
            for lang in set(langs[a:b]):
                own, n = np.unique(grams[np.repeat(langs[a:b] == lang, per)], return_counts=True)
                add(lang, own, n)
            if sum(len(x) for x, _ in total.values()) > HELD:
                yield from out()
    yield from out()


def slots_of(grams: np.ndarray, slots: int = SLOTS, hashes: int = HASHES) -> np.ndarray:
    """(hashes, grams): the cells of each trigram."""
    a, b = mix(grams + _U(0x9E3779B97F4A7C15)), mix(grams ^ _U(0xD1B54A32D192ED03)) | _U(1)
    return np.stack([((a + _U(k) * b) % _U(slots)).astype(np.int64) for k in range(hashes)])


class Filters:
    """The languages' Bloom filters, one array of cells with a bit for each language in 64-bit words."""

    def __init__(self, languages: list[str], slots: int = SLOTS):
        self.languages, self.slots = languages, slots
        self.cells = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)

    def add(self, grams: np.ndarray, which: np.ndarray) -> None:
        word, bit = which // 64, _U(1) << (which % 64).astype(np.uint64)
        for cells in slots_of(grams, self.slots):
            np.bitwise_or.at(self.cells, (cells, word), bit)

    def noise(self) -> np.ndarray:
        """Each language's rate of false positives."""
        set_ = np.array([np.count_nonzero(self.cells[:, i // 64] >> _U(i % 64) & _U(1)) for i in range(len(self.languages))])
        return (set_ / self.slots) ** HASHES

    def holders(self, grams: np.ndarray) -> np.ndarray:
        """(grams, words): the languages that contain each."""
        cells = slots_of(grams, self.slots)
        out = self.cells[cells[0]]
        for c in cells[1:]:
            out = out & self.cells[c]
        return out

    def shares(self, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(rows, languages): the corrected share of each row's trigrams that the language contains."""
        held, n = self.holders(grams), np.diff(bounds)
        out, noise = np.zeros((len(n), len(self.languages))), self.noise_
        for i in range(len(self.languages)):
            ones = np.concatenate(([0], np.cumsum((held[:, i // 64] >> _U(i % 64)) & _U(1), dtype=np.int64)))
            out[:, i] = np.clip((ones[bounds[1:]] - ones[bounds[:-1]]) / np.maximum(n, 1) - noise[i], 0, None) / max(1e-9, 1 - noise[i])
        return out

    def done(self) -> Filters:
        self.noise_ = self.noise()
        return self


def train(rows: DataFrame, least: float = LEAST, contrast: float = CONTRAST, slots: int = SLOTS) -> Filters:
    """Filters from rows (lang, text). The driver gets the distinct languages and the cells, at most slots rows a word."""
    counts = rows.where("lang IS NOT NULL").select(F.col("lang").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(_count, "lang string, gram long, n long")
    counts = cut(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    total = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    languages = sorted(r["lang"] for r in total.collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the filters hold {MOST_LANGUAGES}")
    share = counts.join(F.broadcast(total), "lang").withColumn("p", F.col("n") / F.col("all"))
    share = share.withColumn("top", F.max("p").over(W.partitionBy("gram"))).where((F.col("p") >= least) & (F.col("p") >= contrast * F.col("top")))
    number = {x: i for i, x in enumerate(languages)}
    filters = Filters(languages, slots)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            at = slots_of(np.array(batch.column(1)).astype(np.uint64), slots)
            yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), pa.array(np.tile(which // 64, HASHES)), pa.array(np.tile(1 << (which % 64).astype(np.uint64), HASHES).astype(np.uint64).view(np.int64))], ["cell", "word", "bits"])

    found = share.select("lang", "gram").mapInArrow(cells, "cell long, word long, bits long").groupBy("cell", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    filters.cells[np.array(found["cell"]), np.array(found["word"])] = np.array(found["bits"]).view(np.uint64)
    return filters.done()


def _predict(shared, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, text) to (row, lang, score), with the text if that is asked for."""
        f: Filters = shared.value
        for batch in small(batches, 2000):
            lang, score = [], []
            for _, _, data, offsets in text_slices(batch.column(1)):
                grams, bounds = trigrams(data, offsets)
                n = np.diff(bounds)
                if not f.languages:
                    lang += ["und"] * len(n)
                    score += [0.0] * len(n)
                    continue
                shares = f.shares(grams, bounds)
                best = shares.argmax(axis=1)
                top = shares[np.arange(len(n)), best]
                lang += [f.languages[b] if k else "und" for b, k in zip(best, n)]
                score += np.where(n > 0, np.clip(top, 0, 1), 0).tolist()
            own = [0, 1] if keep_text else [0]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*("row", "text")[: len(own)], "lang", "score"])

    return run


def predict(docs: DataFrame, filters: Filters, keep_text: bool = False) -> DataFrame:
    """row (a struct of the columns of docs but text), text if that is asked for, lang and score."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    rows = docs.select(whole_row(docs, "text"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], *([rows.schema["text"]] if keep_text else []), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predict(shared, keep_text), schema)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts; -1 for null."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % parts, F.lit(-1))


def fold_of(doc_id: int, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs (doc_id, text, lang); rows of fold 1 of 3 are not learnt from."""
    held = fold(F.col("doc_id"), 3) == 1
    filters = train(docs.where(~held))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return predict(rows, filters).select("row.doc_id", "row.held_out", F.col("lang").alias("lang_pred"), "score")


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose language is recognised with a score of at least `least`."""
    filters = train(docs.where(fold(F.col("doc_id"), 3) != 1))
    known = predict(docs, filters, keep_text=True).where((F.col("lang") != "und") & (F.col("score") >= least))
    return known.select(*unwrapped(docs.columns, text=F.col("text").cast(docs.schema["text"].dataType)))
