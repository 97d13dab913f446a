"""Packing by power-of-two decomposition.

A document's token ids are split into pieces of binary length: as many of the full length as fit, then
one for each bit of the rest, largest first. A piece is a sequence of its own in the bucket of its
length, so no sequence crosses documents and none is padded. No row is shuffled.

Null text: empty. Empty text: the closing id alone, one piece of length 1. Repeated rows: each is
packed. Null doc_id: kept as null. Other columns are ignored."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FULL, END_ID = 2048, 1
#: Chunks in each of the two generations that a worker remembers; about 200 bytes each.
REMEMBER = 150_000
#: Words of so many bytes at most, the space before them included, are merged side by side.
LETTERS = 31
#: Bytes of letters below U+0250: a-z, A-Z, the leads C3 to C8 and what follows a lead.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = True


def binary_pieces(n: int, full: int = FULL) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; full must be a power of two."""
    out = [(i, full) for i in range(0, n - n % full, full)]
    at, size = n - n % full, full >> 1
    while size:
        if (n - at) & size:
            out.append((at, size))
            at += size
        size >>= 1
    return out


class Merges:
    """A byte-level BPE's merges for many words side by side."""

    NO, SLOTS = 1 << 30, 18

    def __init__(self, model: dict, table: list[str]):
        vocab = model["vocab"]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.none = max(vocab.values()) + 1
        self.byte = np.array([vocab[x] for x in table], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.feed, self.dot, self.comma = self.byte[[10, 46, 44]]
        keys = np.array([vocab[a] * (self.none + 1) + vocab[b] for a, b in pairs], np.int64)
        # A later merge of the same pair counts, as in the tokenizer; linear probing, filled by hash.
        self.keys, self.rank = np.full(1 << self.SLOTS, -1, np.int64), np.full(1 << self.SLOTS, self.NO, np.int64)
        for key, slot, rank in zip(keys.tolist(), self._slot(keys).tolist(), range(len(keys))):
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) % len(self.keys)
            self.keys[slot], self.rank[slot] = key, rank

    @classmethod
    def of(cls, path: str, table: list[str]) -> Merges | None:
        """None where merges alone do not tell the ids."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        return cls(model, table) if plain and all(x in model["vocab"] for x in table) and 2 * len(model["merges"]) < 1 << cls.SLOTS else None

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NO if it has none."""
        keys = left * (self.none + 1) + right
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.rank[slot], self.NO)
        more = np.flatnonzero((held != keys) & (held != -1))
        while len(more):
            slot[more] = (slot[more] + 1) % len(self.keys)
            held = self.keys[slot[more]]
            hit = held == keys[more]
            out[more[hit]] = self.rank[slot[more[hit]]]
            more = more[~hit & (held != -1)]
        return out

    def apply(self, raw: np.ndarray, real: np.ndarray) -> np.ndarray:
        """raw (most bytes, words), those that are real: each word's ids in order, none in other places. In each round each word merges its first pair of least rank."""
        most, n = raw.shape
        out = np.full((most, n), self.none, np.int64)
        columns = np.arange(n)
        # The last row is what lies before the first and after the last byte.
        ids = np.full((most + 1, n), self.none, np.int64)
        ids[:-1] = np.where(real, self.byte[raw], self.none)
        after = np.repeat(np.arange(1, most + 2), n).reshape(-1, n)
        before = after - 2
        # A rank and its place in one number.
        best = np.full((most + 1, n), self.NO, np.int64)
        best[: most - 1] = self._placed(self._ranks(ids[: most - 1].ravel(), ids[1:most].ravel()).reshape(-1, n), np.arange(most - 1)[:, None])
        while n := len(columns):
            least = best.min(axis=0)
            go = least < self.NO
            if (active := int(go.sum())) < 0.75 * n:
                out[:, columns[~go]] = ids[:-1, ~go]
                if not active:
                    break
                ids, after, before, best, columns, least = (x[..., go] for x in (ids, after, before, best, columns, least))
                n, go = active, np.ones(active, bool)
            c = np.flatnonzero(go)
            at, own = least[c] & 31, self.made[least[c] >> 5]
            gone = after[at, c]
            behind, ahead = after[gone, c], before[at, c]
            ids[at, c], ids[gone, c], best[gone, c] = own, self.none, self.NO
            after[at, c], before[behind, c] = behind, at
            ranks = self._ranks(np.concatenate((own, ids[ahead, c])), np.concatenate((ids[behind, c], own)))
            best[at, c] = self._placed(ranks[: len(c)], at)
            best[ahead, c] = self._placed(ranks[len(c) :], ahead)
        return out

    def _placed(self, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(ranks < self.NO, ranks * 32 + at, self.NO)


class WordwiseTokenizer:
    """Ids of whole texts from a byte-level BPE tokenizer, remembered by word.

    The tokenizer's own pattern always cuts before a single space between two characters that are not white space, so
    texts are cut there, and each chunk's ids are those of the chunk alone. Chunks are remembered in two
    generations: when the new one is full, it becomes the old one, and what is met again moves up."""

    def __init__(self, path: str, remember: int = REMEMBER):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.remember = remember
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.packed = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        # The byte-level alphabet: printable bytes stand for themselves, the rest for 256, 257, ... in order.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = [b for b in range(256) if b not in plain]
        self.table = [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]
        self.path = path

    @cached_property
    def merges(self) -> Merges | None:
        return Merges.of(self.path, self.table)

    def _whole(self, text: str) -> bytes:
        return b"".join([self.packed[i] for i in self.whole.encode(text, add_special_tokens=False).ids])

    def _letters(self, word: str, lead: str) -> bytes:
        """Ids of a word of letters alone, after a space or nothing: one word of the tokenizer's pattern."""
        table = self.table
        mapped = word if word.isascii() else "".join([table[b] for b in word.encode()])
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(lead + mapped)])

    def _chunk(self, word: str, spaced: bool) -> bytes:
        """Ids of a word after a space or nothing, without spaces at its ends."""
        lead = self.table[32] if spaced else ""
        if word.isalpha():
            return self._letters(word, lead)
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            stem = word[:-1]
            head = self.new.get(stem) if spaced else None
            return (head or self._letters(stem, lead)) + self._bare(word[-1])
        if "\n" in word:
            # A single line feed between visible characters is a word of the pattern by itself.
            parts = word.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in parts):
                head = self._remember(parts[0]) if spaced else self._bare(parts[0])
                feed = self._bare("\n")
                return head + b"".join([feed + self._bare(x) for x in parts[1:]])
        return self._whole(" " + word if spaced else word)

    def _bare(self, word: str) -> bytes:
        """Ids of a word after nothing."""
        if (ids := self.bare.get(word)) is None:
            ids = self._whole(word) if word == "\n" else self._chunk(word, False)
            if len(self.bare) >= self.remember // 4:
                self.bare = {}
            self.bare[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The text's ids, little-endian unsigned 32-bit each."""
        words = text.split(" ")
        if any(x in text and (" " in x or "\n" in x) for x in self.special):
            return self._whole(text)
        out = list(map(self.new.get, words))
        # The first chunk has no space before it; the others must be cut at a space between visible characters.
        out[0] = None
        if None in out[1:]:
            for i, ids in enumerate(out):
                if ids is None and i:
                    word = words[i]
                    if not word or word[0].isspace() or word[-1].isspace():
                        return self._slow(words)
                    out[i] = self._remember(word)
        if not words[0] or words[0][0].isspace() or words[0][-1].isspace():
            return self._slow(words)
        out[0] = self._bare(words[0])
        return b"".join(out)

    def column(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of texts one after the other, unsigned 32-bit, where each text's begin, with the end behind), the texts' UTF-8 bytes lying at offsets in data.

        The ids of ids(), none for an empty text, but each different word is looked up once, and those of letters are merged side by side."""
        n = len(offsets) - 1
        if not n or offsets[-1] == offsets[0]:
            return np.zeros(0, "<u4"), np.zeros(n + 1, np.int64)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        texts = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data))])
        # A line feed between visible characters is a word of the pattern by itself, so texts are cut before it as before a space.
        feeds = np.searchsorted(np.flatnonzero(data == 10), offsets)
        spaced = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets + feeds), pa.py_buffer(data.tobytes().replace(b"\n", b" \n"))])
        cut = pc.split_pattern(spaced, " ")
        heads = np.concatenate(([0], np.cumsum(np.array(pc.list_value_length(cut), np.int64))))
        every = cut.flatten()
        named = every.dictionary_encode()
        words, codes = named.dictionary.cast(pa.large_string()), np.array(named.indices, np.int64)
        pool, begins, sizes = self._merged(words)
        # As in ids(): texts with such words, or with a special token that holds white space, can't be taken apart.
        rest, odd = np.flatnonzero(sizes < 0), np.zeros(len(words), bool)
        found: list[bytes] = []
        for i, word in zip(rest.tolist(), words.take(pa.array(rest)).to_pylist()):
            own = word[1:] if word[:1] == "\n" else word
            odd[i] = not own or own[0].isspace() or own[-1].isspace()
            found.append(b"" if odd[i] else self._remember(word) if own is word else self._bare("\n") + self._bare(own))
        alone = np.add.reduceat(odd[codes], heads[:-1], dtype=np.int64) > 0
        for x in self.special:
            if " " in x or "\n" in x:
                alone |= np.array(pc.match_substring(texts, x), bool)
        # A text's first word has no space before it; a text that stands alone is one entry, with nothing for its other words.
        last = len(words) + n
        codes[np.repeat(alone, np.diff(heads))] = last
        codes[heads[:-1]] = np.arange(len(words), last)
        for i, word in enumerate(every.take(pa.array(heads[:-1])).to_pylist()):
            text = texts[i].as_py() if alone[i] else word
            found.append(b"" if not text else self.ids(text) if alone[i] else self._bare(word))
        found.append(b"")
        lengths = np.array(list(map(len, found)), np.int64) // 4
        at = len(pool) + np.cumsum(lengths) - lengths
        pool = np.concatenate((pool, np.frombuffer(b"".join(found), "<u4")))
        begins[rest], sizes[rest] = at[: len(rest)], lengths[: len(rest)]
        begins, sizes = np.concatenate((begins, at[len(rest) :])), np.concatenate((sizes, lengths[len(rest) :]))
        counts = sizes[codes]
        ends = np.cumsum(counts)
        places = np.repeat(begins[codes] - (ends - counts), counts)
        places += np.arange(len(places))
        return pool[places], np.concatenate(([0], ends))[heads]

    def _merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin, how many it has) of the words after a space (or a line feed, which they then start with) of LETTERS bytes at most,
        letters below U+0250 and one of . and , at most behind them. How many: -1 for the other words."""
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        start, stop = offsets[:-1], offsets[1:]
        begins, sizes = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        if self.merges is None or not len(data):
            return np.zeros(0, "<u4"), begins, sizes
        full = stop > start
        fed = full & (data[np.minimum(start, len(data) - 1)] == 10)
        tail = np.where(full, data[stop - 1], 0)
        marked = (tail == 46) | (tail == 44)
        first, end = start + fed, stop - marked
        # Bytes of 97 and B7 behind C3 are no letters; other bytes behind C3 to C8 are.
        other = ~LETTER[data]
        other[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        others = np.concatenate(([0], np.cumsum(other, dtype=np.int32)))
        size = end - first + ~fed
        fits = (end > first) & (size <= LETTERS) & (others[np.maximum(end, first)] == others[first])
        pools, at = [], 0
        lower = 0
        for upper in (4, 6, 8, 10, 12, 16, 24, LETTERS):
            own = np.flatnonzero(fits & (size > lower) & (size <= upper))
            lower = upper
            for own in np.split(own, range(1 << 16, len(own), 1 << 16)):
                if not len(own):
                    continue
                rows = np.arange(upper)[:, None]
                raw = data.take(first[own] - ~fed[own] + rows, mode="clip")
                raw[0, ~fed[own]] = 32
                merged = self.merges.apply(raw, rows < size[own])
                none = self.merges.none
                merged = np.concatenate((np.where(fed[own], self.merges.feed, none)[None], merged, np.where(marked[own], np.where(tail[own] == 46, self.merges.dot, self.merges.comma), none)[None])).T
                real = merged != none
                pools.append(merged[real].astype("<u4"))
                sizes[own] = real.sum(axis=1)
                begins[own] = at + np.cumsum(sizes[own]) - sizes[own]
                at += len(pools[-1])
        return np.concatenate(pools) if pools else np.zeros(0, "<u4"), begins, sizes

    def _remember(self, word: str) -> bytes:
        if (ids := self.new.get(word)) is None:
            if (ids := self.old.pop(word, None)) is None:
                ids = self._chunk(word, True)
            if len(self.new) >= self.remember:
                self.old, self.new = self.new, {}
            self.new[word] = ids
        return ids

    def _slow(self, words: list[str]) -> bytes:
        """Where some spaces stand beside white space: words that can't be cut apart stay together."""
        out, held, lead = [], words[0], False
        for word in words[1:]:
            if held and word and not held[-1].isspace() and not word[0].isspace():
                out.append(self._remember(held) if lead and not held[0].isspace() else self._chunk(held, lead))
                held, lead = word, True
            else:
                held = f"{held} {word}"
        out.append(self._chunk(held, lead))
        return b"".join(out)


_loaded: dict[str, WordwiseTokenizer] = {}


def tokenizer(path: str) -> WordwiseTokenizer:
    """One for each worker process, kept from task to task."""
    if path not in _loaded:
        _loaded[path] = WordwiseTokenizer(path)
    return _loaded[path]


def _pieces(path: str, full: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        end = np.array([end_id], "<u4").tobytes()
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                rows: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = (tok.ids(text) if text else b"") + end
                    n = len(ids) // 4
                    for start, length in binary_pieces(n, full):
                        rows.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], n, serial, 0, length.bit_length() - 1))
                        serial += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket"])

    return run


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket int"


def pack(docs: DataFrame, tokenizer_path: str, full: int = FULL, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of docs (doc_id, text): its ids (little-endian unsigned 32-bit), its sequence, offset and bucket (log2 of the length).

    sequence_id is unique: the task's number, then the piece's within the task."""
    if full < 1 or full & (full - 1):
        raise ValueError("full must be a power of two")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(tokenizer_path, full, end_id), PIECES)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The sequences as files, a folder for each length: a batch is then read from one bucket."""
    pieces.write.partitionBy("bucket").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the ids' CRC-32 in their place."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
