"""Each operator against brute force, on a small table with nulls, ties, repeated rows, very long texts and clashing columns."""

import hashlib
import math
import pickle
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from symreach.llm import langid, license, linededup, lm, minhash, mixing, packing, quality, sharding, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, _t string, key string, n long"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def rows():
    r = np.random.default_rng(3)
    vocab = {"en": ["the", "thing", "of", "And", "stone", "water", "light", "over", "under", "river", "house"], "fr": ["été", "le", "fenêtre", "où", "garçon", "pain", "élève", "rue", "être"]}
    out = []
    shared = "this very same line stands in many of the documents here"
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        lines = [" ".join(r.choice(vocab[lang], int(r.integers(5, 30)))) for _ in range(int(r.integers(1, 6)))]
        if i % 4 == 0:
            lines.insert(1, f"  {shared.upper() if i % 8 else shared}\t")
        out.append([i, "\n".join(lines), lang, f"src{i % 5}" if i % 7 else None])
    base = " ".join(r.choice(vocab["en"], 300))
    for k in range(12):
        w = base.split(" ")
        for j in r.integers(0, len(w), k):
            w[j] = f"x{k}"
        out.append([100 + k, " ".join(w), "en", "src0"])
    out += [[200 + k, base, "en", "src0"] for k in range(20)]
    out += [[300, None, "en", "src1"], [301, "", None, "src1"], [302, " \t\n", "en", None], [303, "one", "fr", "src2"], [304, "two words", None, "src2"], [305, "12 34 !?", "en", "src3"]]
    out += [[306, " ".join(r.choice(vocab["en"], 6000)), "en", "src3"], [306, "again the same id, another text of some words", "en", "src3"], [None, "a text without an id but with words", "en", "src3"]]
    out += [[307, "Released under the MIT License.\nwater over stone", "en", "src4"], [308, "a b c d e a b c d e f g h i j # $ %", "en", "src4"]] * 2
    return [tuple([*x, len(x[1] or ""), "s", "t", "u", "v", 1]) for x in out]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts):
    sets = [shingle_set(t) for _, t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and 100 * n >= 85 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: math.inf)
    for i, (doc, _) in enumerate(texts):
        if doc is not None:
            least[find(i)] = min(least[find(i)], doc)
    return sorted((repr(doc), len(sets[i]), repr(None if math.isinf(least[find(i)]) else least[find(i)])) for i, (doc, _) in enumerate(texts))


def test_near_duplicates_equal_brute_force(docs):
    got = minhash.near_duplicates(docs).collect()
    assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in got) == brute_components([(r[0], r[1]) for r in ROWS])
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_keep_one_keeps_one_of_each_group(docs):
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[100] == 1 and not any(ids[200 + k] for k in range(20)) and ids[307] == 1 and ids[300] == 1


def test_the_stage_takes_pairs_from_80_per_cent(spark):
    # The last m of 104 words differ, so 100 - m of 100 + m shingles are shared.
    data = []
    for i, m in enumerate((10, 11, 12)):
        w = [f"w{i}x{k}" for k in range(104)]
        data += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(w[: 104 - m] + [f"z{i}x{k}" for k in range(m)]))]
    sets = [shingle_set(t) for _, t in data]
    assert [round(len(a & b) / len(a | b), 2) for a, b in zip(sets[::2], sets[1::2])] == [0.82, 0.8, 0.79]
    d = spark.createDataFrame(data, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, d, "").collect()} == {0, 10, 20, 21}
    assert minhash.keep_one(d).count() == 6


def test_blocks_of_a_large_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    r = np.random.default_rng(5)
    base = [f"w{x}" for x in r.integers(0, 500, 260)]
    texts = []
    for k in range(40):
        w = list(base)
        for j in r.integers(0, len(w), int(r.integers(0, 7))):
            w[j] = f"z{k}"
        texts.append((k, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in got) == brute_components(texts)


def test_odd_sketches_estimate_similarity():
    r = np.random.default_rng(1)
    errors = []
    for same in (480, 450, 400):
        a = np.unique(r.integers(0, 2**63, 500, dtype=np.uint64))
        b = np.concatenate((a[:same], r.integers(0, 2**63, 500 - same, dtype=np.uint64)))
        s = minhash.odd_sketches(np.array([minhash.signature(a), minhash.signature(b)]))
        z = np.bitwise_count(s[0] ^ s[1]).sum()
        errors.append(abs(minhash.sketch_similarity(np.array([z]))[0] - same / (1000 - same)))
    assert max(errors) < 0.2


def brute_lines(data, least=5, chars=40):
    key = lambda x: lower(x.strip(SPACES))
    holders = defaultdict(set)
    for doc, text, *_ in data:
        for x in (text or "").split("\n"):
            if len(key(x)) >= chars:
                holders[key(x)].add(-1 if doc is None else doc)
    out = []
    for doc, text, *_ in data:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(key(x), ())) >= least and max(h) != (-1 if doc is None else doc))]
        out.append((repr(doc), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup_equals_brute_force(docs):
    got = linededup.line_report(docs).withColumn("sha", F.sha2("kept_text", 256)).collect()
    assert sorted((repr(r["doc_id"]), r["n_lines"], r["n_dropped"], r["sha"]) for r in got) == brute_lines(ROWS)
    assert sum(r["n_dropped"] for r in got) > 5


def test_line_dedup_keeps_columns(docs):
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)


def test_line_runs_are_levelled(spark):
    runs = linededup.LineRuns(spark, fan=2, buckets=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(1, 1, 10 - k, 0), (k + 2, 7, 10 - k, 0)], "h1 long, h2 long, doc_id long, mark long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    got = {(r["h1"], r["h2"]): (r["n"], r["keeper"]) for r in runs.merged().collect()}
    assert got[1, 1] == (5, 10) and got[6, 7] == (1, 6)
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_rows_without_ids_are_one_document(spark):
    line = "a line of more than forty characters that stands in all of them"
    texts = [(i, line) for i in range(4)] + [(None, f"own {k}\n{line}") for k in range(3)] + [(9, f"{line}\nlast")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = linededup.line_report(d).withColumn("sha", F.sha2("kept_text", 256)).collect()
    assert sorted((repr(r["doc_id"]), r["n_lines"], r["n_dropped"], r["sha"]) for r in got) == brute_lines(texts)


NAMES = ["row", "_", "_text", "_lost", "_stays", "_times", "kept", "lang_", "score", "mark", "id", "t1", "slot", "own", "lost", "n_lines", "times", "places", "all_slots", "kind"]


def test_stages_keep_columns_of_any_name(docs):
    from pyspark.sql import Row

    d = docs.limit(120).select("doc_id", "text", "lang", "source", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])
    for stage in (langid.keep_identified, linededup.dedup_lines, minhash.keep_one, mixing.mixed_documents):
        out = stage(d)
        assert out.columns == d.columns
        first = out.first()
        assert isinstance(first, Row) and [first[n] for n in NAMES] == list(range(len(NAMES)))


def test_very_long_texts(spark):
    long = "x" * 3_000_000
    words = " ".join(f"w{i % 977}" for i in range(400_000))
    d = spark.createDataFrame([(1, long, "en", "a"), (2, words, "en", "a"), (3, words + " end", "en", "b"), (4, "short text of words", "en", None)], "doc_id long, text string, lang string, source string").repartition(2)
    near = {r["doc_id"]: r for r in minhash.near_duplicates(d).collect()}
    assert near[3]["component_id"] == 2 and near[1]["n_shingles"] == 1
    assert {r["doc_id"]: r["n_dropped"] for r in linededup.line_report(d).collect()} == dict.fromkeys((1, 2, 3, 4), 0)
    assert {r["doc_id"]: r["size"] for r in mixing.mix(d).collect()} == {1: 1, 2: 400_000, 3: 400_001, 4: 4}
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(d).collect()}[4] in ("en", "und") and sharding.shard(d, shards=2).count() == 4

def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    pieces = packing.pack(docs, TOKENIZER, full=64).collect()
    assert len({r["sequence_id"] for r in pieces}) == len(pieces)
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 and r["offset"] == 0 and 1 << r["bucket"] == r["length"] for r in pieces)
    docs_ids = Counter()
    held = []
    for r in sorted(pieces, key=lambda r: r["sequence_id"]):
        if r["start"] == 0:
            held = []
        assert r["start"] == len(held)
        held += np.frombuffer(r["ids"], "<u4").tolist()
        if len(held) == r["doc_tokens"]:
            docs_ids[repr(r["doc_id"]), tuple(held)] += 1
    want = Counter((repr(r[0]), tuple([*t.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in ROWS)
    assert docs_ids == want
    one = packing.digest(packing.pack(docs, TOKENIZER)).where("doc_id = 303").collect()
    ids = [*t.encode("one", add_special_tokens=False).ids, 1]
    assert [r["ids_crc32"] for r in one] == [zlib.crc32(np.array(ids, "<u4").tobytes())]


def test_packing_refuses_other_lengths(docs):
    with pytest.raises(ValueError):
        packing.pack(docs, TOKENIZER, full=100)


@pytest.mark.parametrize("text", ["", " ", "a  b", "a\n b", "\n\n", "don't I'll 'tis", "a\tb c", "日本 語。 テ", "<|endoftext|> a <|endoftext|>b", "x.\ny, z.\n\nq", " lead", "trail ", "a \x1c b", "a b c  d"])
def test_wordwise_ids_are_the_tokenizers(text):
    w = packing.WordwiseTokenizer(TOKENIZER)
    for _ in range(2):
        assert np.frombuffer(w.ids(text), "<u4").tolist() == w.whole.encode(text, add_special_tokens=False).ids


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def brute_mix(got, want, block):
    """taken and first slot of each of mix()'s rows, from its keys alone."""
    total = sum(want.values())
    block = max(1, min(block, int(total // mixing.SLOTS)))
    names = [s for s in sorted(want, key=lambda s: (s is None, (s or "").encode())) if want[s] > 0]
    edges = np.cumsum([want[s] for s in names]) / total
    streams = defaultdict(list)
    for i, r in enumerate(got):
        streams[r["source"]].append(i)
    words = {}
    for s, own in streams.items():
        own.sort(key=lambda i: (got[i]["key"], got[i]["doc_id"] is not None, got[i]["doc_id"] or 0))
        words[s] = [i for _ in range(mixing.CAP) for i in own for _ in range(got[i]["size"])]
    taken, first, rank = Counter(), {}, Counter()
    for slot in range(math.ceil(total / block)):
        s = names[min(int(np.searchsorted(edges, slot * mixing.GOLDEN % 1.0, "right")), len(names) - 1)]
        for i in words[s][rank[s] * block : (rank[s] + 1) * block]:
            taken[i] += 1
            first.setdefault(i, slot)
        rank[s] += 1
    return [(taken[i], first.get(i)) for i in range(len(got))]


@pytest.mark.parametrize("slots, block", [(1 << 15, 16), (64, 100)])
def test_mixing_equals_brute_force(docs, monkeypatch, slots, block):
    monkeypatch.setattr(mixing, "SLOTS", slots)
    got = mixing.mix(docs, block=block).collect()
    assert len(got) == len(ROWS)
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = brute_targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and r["taken"] <= 2 * r["size"]
    # Rows that are alike in id and text may change places.
    kind = lambda r, x: repr((r["doc_id"], r["source"], r["mark"], x)) if r["doc_id"] not in (307, 308) else ""
    assert sorted(kind(r, (r["taken"], r["slot"])) for r in got) == sorted(kind(r, x) for r, x in zip(got, brute_mix(got, want, block)))
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    near = 3 * max(1, min(block, int(sum(want.values()) // slots)))
    assert all(abs(taken[s] - want[s]) <= near for s in sizes)
    again = mixing.mix(docs.repartition(3), block=block).collect()
    key = lambda r: repr((r["doc_id"], r["size"], r["taken"], r["slot"]))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_the_schedule_decides_the_mix(docs):
    key = lambda r: (repr(r["doc_id"]), r["mark"] or 0)
    own, other = ([(r["taken"], r["slot"]) for r in sorted(mixing.mix(docs, points=p).collect(), key=key)] for p in (mixing.golden, lambda slot: mixing.golden(slot) ** 2))
    assert sum(a[0] != b[0] for a, b in zip(own, other)) > 40 and sum(a[1] != b[1] for a, b in zip(own, other)) > 40


def test_mixed_documents_stand_in_the_order_of_their_slots(spark):
    d = spark.createDataFrame([(i, " ".join(["w"] * 40), f"s{i % 2}", i) for i in range(200)], "doc_id long, text string, source string, _slot long")
    plan = {r["doc_id"]: r for r in mixing.mix(d).collect()}
    seen, out = Counter(), []
    for r in mixing.mixed_documents(d).collect():
        out.append([x for x in plan[r["doc_id"]]["slots"] if x is not None][seen[r["doc_id"]]])
        seen[r["doc_id"]] += 1
    assert out == sorted(out) and len(out) == 300 and set(seen.values()) <= {1, 2}


def test_mixed_rows_that_are_alike(spark):
    d = spark.createDataFrame([(1, "a b c d", "x", k % 2) for k in range(7)] + [(2, "e f g h", "y", 5)], "doc_id long, text string, source string, `row` long")
    taken = {r["source"]: r["taken"] for r in mixing.mix(d).groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    out = Counter((r["doc_id"], r["row"]) for r in mixing.mixed_documents(d).collect())
    times = out[1, 0] + out[1, 1]
    assert abs(times - taken["x"] / 4) <= 3.5
    assert 4 * (times // 7) <= out[1, 0] <= 4 * -(-times // 7) and 3 * (times // 7) <= out[1, 1] <= 3 * -(-times // 7)


def test_mixed_documents_are_rows_of_the_input(docs):
    out = mixing.mixed_documents(docs, block=16)
    assert out.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in out.collect()} <= {(r[0], r[1]) for r in ROWS}


def test_language_id_tells_languages_apart(docs):
    got = langid.identify(docs).collect()
    lang = {r[0]: r[2] for r in ROWS if r[0] is not None and r[0] < 300}
    own = [r for r in got if r["doc_id"] in lang]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in own if r["held_out"]) >= 0.95 * sum(r["held_out"] for r in own)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (300, 301, 302, 305))
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(ROWS)


def test_bit_sliced_filters_hold_many_languages():
    names = [f"l{i:03}" for i in range(130)]
    f = langid.Filters(names, 1 << 14)
    grams = np.arange(1, 131, dtype=np.uint64) * np.uint64(7919)
    f.add(grams, np.arange(130))
    f.done()
    shares = f.shares(grams, np.arange(131))
    assert (shares.argmax(axis=1) == np.arange(130)).mean() > 0.97


def test_keep_identified_keeps_clean_rows(docs):
    out = langid.keep_identified(docs)
    assert out.columns == docs.columns
    ids = {r["doc_id"] for r in out.collect()}
    assert set(range(60)) <= ids and not ids & {300, 301, 302, 305}


def test_lm_base_equals_brute_force(docs):
    got = lm.lm_scores(docs, TOKENIZER, steps=20).collect()
    assert len(got) == len(ROWS)
    counts = Counter()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    for d, text, *_ in ROWS:
        if not held(d):
            counts.update(WORD.findall(lower(text or "")))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, text, *_ in ROWS:
        w = [*WORD.findall(lower(text or "")), None]
        want.append((repr(d), held(d), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)))
    assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(r["score"] < 0 for r in got)


def test_lm_base_joins_rare_words(docs):
    keyed = lm._keyed(docs)
    key = lambda r: (r["k1"], r["k2"], round(r["base_score"], 6), r["n_known"])
    assert sorted(map(key, lm.base_scores(keyed, frequent=3).collect())) == sorted(map(key, lm.base_scores(keyed).collect()))


def test_model_gradients_and_windows():
    r = np.random.default_rng(0)
    m = lm.ClassModel(r.integers(0, 50, lm.IDS + 1))
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    m.mask = m.mask.astype(np.float64)
    w, _ = lm.windows_of([r.integers(0, 900, 40), np.zeros(0, np.int64)])
    x, goal = m.input_of[w[:, :-1]], w[:, lm.CONTEXT + 1 :]
    real = np.concatenate((np.ones((len(w), 1), bool), goal[:, :-1] != lm.END), axis=1)
    _, grad = m.step(x, goal, real)
    for k, at in (("Q", (1, 2)), ("K", (0, 3)), ("V", (2, 2)), ("O", (1, 1)), ("S", (0, 0)), ("P", (5, 1)), ("W", (3, 3)), ("E", (int(x[0, 15]), 2))):
        old = m.p[k][at]
        m.p[k][at] = old + 1e-5
        up = m.step(x, goal, real)[0]
        m.p[k][at] = old - 1e-5
        down = m.step(x, goal, real)[0]
        m.p[k][at] = old
        assert (up - down) / 2e-5 == pytest.approx(grad[k][at], abs=1e-5)
    # Windows score each id once, END included: the probabilities of all ids and END sum to one for any prefix.
    ids = [np.arange(50), np.zeros(0, np.int64)]
    w, text = lm.windows_of(ids)
    scored = [x for row, t in zip(w, text) if t == 0 for x in row[lm.CONTEXT + 1 :]]
    assert scored[:51] == [*range(50), lm.END]


def test_what_the_model_is_fitted_on_grows(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARE", 0.5)
    monkeypatch.setattr(lm, "TRAINER_WINDOWS", 100)
    r = np.random.default_rng(8)
    texts = [r.integers(0, 40, n).astype(np.uint16) for n in [9_600, *[30] * 100, 0]]
    d = spark.createDataFrame([(True, int(r.integers(-(2**62), 2**62)), x.tobytes()) for x in texts], "learnt boolean, k1 long, ids binary")
    used = {}
    kept, fit = lm.ClassModel.__init__, lm.ClassModel.fit
    monkeypatch.setattr(lm.ClassModel, "__init__", lambda self, counts, pairs: used.update(counts=counts, pairs=pairs) or kept(self, counts, pairs))
    monkeypatch.setattr(lm.ClassModel, "fit", lambda self, rows, *a: used.update(rows=rows) or fit(self, rows, 2) and used.update(first=self.packed()) or self)
    model = lm.train(d, windows=16, steps=2)
    # 401 windows of the long text, two of each short one and one of the empty one.
    windows = lm.windows_of(texts)[0]
    assert len(windows) == 602 and 4 < len(used["rows"]) < 40
    assert {x.tobytes() for x in used["rows"].astype(np.int32)} <= {x.tobytes() for x in windows.astype(np.int32)}
    order = np.argsort(-used["counts"], kind="stable")
    pairs = Counter(p for x in texts for p in zip([lm.START, *x.tolist()], [*x.tolist(), lm.END]))
    a, b = int(order[0]), int(order[1])
    assert used["pairs"][0, 1] == pairs[a, b] and used["pairs"][1, 0] == pairs[b, a] and used["pairs"].sum() == sum(pairs.values())
    # Three trainers (half of 602 windows, 100 each) went on from the first fit.
    assert model.packed() != used["first"] and np.abs(np.frombuffer(model.packed(), np.float32) - np.frombuffer(used["first"], np.float32)).max() < 0.1


def test_a_trained_model_beats_the_word_counts(spark):
    r = np.random.default_rng(12)
    words = ["water", "house", "stone", "river", "light", "paper", "money", "music", "night", "world", "story", "table", "green", "white", "black", "young", "small", "large", "early", "often"]
    # Each word is followed by one of three.
    after = {w: r.choice(words, 3).tolist() for w in words}
    texts = []
    for i in range(600):
        w = [str(r.choice(words))]
        while len(w) < 40:
            w.append(after[w[-1]][int(r.integers(3))])
        texts.append((i, " ".join(w)))
    out = lm.lm_scores(spark.createDataFrame(texts, "doc_id long, text string"), TOKENIZER, steps=300).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    assert out["score"] > out["base"] + 0.05 * out["n"]


def test_case_does_not_matter_to_scores(spark):
    d = spark.createDataFrame([(i, t) for i in range(40) for t in ("The Water OVER stone", "the water over stone")], "doc_id long, text string")
    out = lm.lm_scores(d, TOKENIZER, steps=5).collect()
    assert len(out) == 80 and len({round(r["score"], 4) for r in out}) == 1 and len({r["n_tokens"] for r in out}) == 1


@pytest.mark.parametrize("scale", [1, 40])
def test_scoring_equals_the_trained_form(scale):
    r = np.random.default_rng(6)
    m = lm.ClassModel(r.integers(0, 50, lm.IDS + 1))
    for k in ("Q", "K", "W"):
        m.p[k] *= scale
    w, _ = lm.windows_of([r.integers(0, 5000, 200)])
    goal = w[:, lm.CONTEXT + 1 :]
    logits = m.forward(m.input_of[w[:, :-1]])[0].astype(float)
    own, last = m.rank[goal.ravel()], np.minimum(m.input_of[w[:, lm.CONTEXT : -1]], m.frequent).ravel()
    at = m.class_of[own]
    top = logits.max(axis=1)
    want = logits[np.arange(len(at)), at] - top - np.log(np.exp(logits - top[:, None]).sum(axis=1)) + m.after[last, own] + m.within[goal.ravel()]
    assert np.abs(m.log_probabilities(m.input_of[w[:, :-1]], goal).ravel() - want).max() < 2e-2 * scale


def test_model_is_a_distribution():
    m = lm.ClassModel(np.random.default_rng(0).integers(0, 50, lm.IDS + 1))
    w, _ = lm.windows_of([np.arange(5)])
    goal = np.repeat(w[:, lm.CONTEXT + 1 :], lm.IDS + 1, axis=0)
    goal[:, 0] = np.arange(lm.IDS + 1)
    total = sum(np.exp(m.log_probabilities(m.input_of[np.repeat(w[:, :-1], len(g), axis=0)], g)[:, 0].astype(float)).sum() for g in np.array_split(goal, 50))
    assert total == pytest.approx(1, abs=1e-3)


def test_shards_hold_the_law_and_the_groups(docs):
    got = sharding.shard(docs, shards=7).collect()
    per = Counter(r["shard"] for r in got)
    assert len(got) == len(ROWS) and set(per) == set(range(7)) and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(per[s]))
    want = sorted((repr(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    groups = defaultdict(set)
    for r in got:
        groups[r["text_crc32"]].add(r["shard"])
    assert sum(len(x) > 1 for x in groups.values()) <= 2 and all(r["law"] == "rows" and r["grown_shard"] is None for r in got)


def test_shards_of_one_group_alone(spark):
    d = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    per = Counter(r["shard"] for r in sharding.shard(d, shards=8).collect())
    assert sorted(per.values()) == [12] * 4 + [13] * 4


def cut_by_hand(rows, of):
    held = defaultdict(list)
    for r in rows:
        held[of[r["doc_id"]]].append(r["shard"])
    return sum(a != b for x in held.values() for i, a in enumerate(x) for b in x[:i])


def least_cut(sizes, shards):
    """The fewest cut pairs of any placement with counts at most one apart, by trying all."""
    total = sum(sizes)
    best = [math.inf]

    def place(i, room, lost):
        if lost >= best[0]:
            return
        if i == len(sizes):
            best[0] = lost
            return
        seen = set()

        def split(s, left, held):
            if s == len(room):
                if not left and (key := tuple(sorted(held, reverse=True))) is not None:
                    after = tuple(r - h for r, h in zip(room, held))
                    if (tuple(sorted(after)), key) not in seen:
                        seen.add((tuple(sorted(after)), key))
                        place(i + 1, list(after), lost + (sizes[i] ** 2 - sum(h * h for h in held)) // 2)
                return
            for h in range(min(left, room[s]) + 1):
                split(s + 1, left - h, [*held, h])

        split(0, sizes[i], [])

    q, r = divmod(total, shards)
    place(0, [q + (s < r) for s in range(shards)], 0)
    return best[0]


@pytest.mark.parametrize("sizes, shards", [((3, 3, 2, 1, 1, 1, 1), 3), ((4, 4, 2, 2), 3), ((2, 2, 2, 1, 1, 1, 1, 1, 1), 2), ((3, 3, 3, 3), 2)])
def test_propagation_reaches_the_least_cut_of_small_graphs(spark, sizes, shards):
    of = [g for g, n in enumerate(sizes) for _ in range(n)]
    d = spark.createDataFrame([(i, f"group {g}") for i, g in enumerate(of)], "doc_id long, text string")
    frame, history = sharding.placed(d, shards=shards, rounds=12)
    rows = frame.collect()
    per = Counter(r["shard"] for r in rows)
    assert max(per.values()) - min(per.values()) <= 1 and sum(per.values()) == len(of)
    assert cut_by_hand(rows, of) == min(history) == least_cut(sizes, shards)


def test_rounds_of_propagation_decide_the_shards(spark):
    of = [g for g in range(60) for _ in range(2)] + list(range(60, 120))
    d = spark.createDataFrame([(i, f"group {g}") for i, g in enumerate(of)], "doc_id long, text string")
    none, before = sharding.placed(d, shards=6, rounds=0)
    some, after = sharding.placed(d, shards=6)
    assert before == [cut_by_hand(none.collect(), of)] and before[0] > 35
    assert after[0] == before[0] and after[-1] == cut_by_hand(some.collect(), of) == 0


def test_a_group_larger_than_a_shard_fills_shards(spark):
    of = [0] * 50 + [1 + i // 2 for i in range(50)]
    d = spark.createDataFrame([(i, f"group {g}") for i, g in enumerate(of)], "doc_id long, text string")
    _, history = sharding.placed(d, shards=10, rounds=12)
    # Five units of ten documents, and 25 pairs.
    assert history[0] > 200 and min(history) <= history[0] / 4


def test_admitted_moves_keep_within_the_room():
    flow = sharding.admitted({(0, 1): 9, (1, 0): 4, (2, 1): 3}, [0, 2, 0])
    gain = [sum(n for (_, b), n in flow.items() if b == s) - sum(n for (a, _), n in flow.items() if a == s) for s in range(3)]
    assert all(g <= r for g, r in zip(gain, [0, 2, 0])) and flow[1, 0] == 4 and sum(flow.values()) == 10


def brute_top(vectors, k=20, every=20):
    ints = [(i, [math.floor(64 * x) if abs(x) < 2**52 else int(x) * 64 for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ints:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q)[:k]
            out += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(2)
    v = [(i, [float(np.float32(x)) for x in r.normal(size=8) / 3]) for i in range(300)]
    v += [(400, v[0][1]), (401, v[0][1]), (402, None), (403, [1.0, None]), (404, [float("nan")] * 8), (405, [float("inf")] * 8), (406, [0.5] * 3), (407, []), (None, v[0][1])]
    d = spark.createDataFrame([(i, x, 1) for i, x in v], "vec_id long, embedding array<float>, block int")
    got = topk.top_k(d, block=16, tile=2).collect()
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got) == brute_top(v)


def test_top_k_of_few(spark):
    d = spark.createDataFrame([(20, [1.0]), (21, [0.5]), (22, [-0.5])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(d).orderBy("rank").collect()] == [(1, 21, 2048), (2, 22, -2048)]
    assert topk.top_k(d.where("vec_id < 0")).count() == 0


def test_top_k_of_large_components(spark):
    v = [(20, [1e12, 3.0]), (40, [1e300, -1e300]), (1, [1e12, 1e12]), (2, [-1e30, 2.5]), (3, [1e38, 1e38]), (4, [0.5, 0.25]), (5, [3e307, 1.0])]
    d = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = topk.top_k(d).collect()
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got) == brute_top(v)


def test_pivots_keep_far_blocks_from_being_joined(spark):
    r = np.random.default_rng(4)
    v = np.concatenate([c + r.normal(size=(300, 6)) / 40 for c in r.normal(size=(12, 6)) / 2 / np.sqrt(6) * 3])
    d = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    rows = topk.search(d, block=32, tile=2).collect()
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in rows) == brute_top(list(enumerate(v.tolist())))
    queries = len(v) // 20
    assert len(rows) == 20 * queries and sum(x["seen"] for x in rows) < queries * len(v) / 3


def test_bounds_hold():
    r = np.random.default_rng(6)
    for scale in (1, 1000, 1e15):
        v = np.floor(r.normal(size=(300, 12)) * 60 * scale)
        p = topk.choose(v[:100], 20)
        d, n = topk.distances(v, p), (v * v).sum(axis=1)
        true = v @ v.T
        assert (topk.point_bounds(n, n, d, d) >= true).all()
        assert (topk.upper(n[:, None], n[None, :], topk.gaps(d, d, d)) >= true * (1 - 1e-12)).all()
        low, high = d.reshape(30, 10, -1).min(axis=1), d.reshape(30, 10, -1).max(axis=1)
        block = topk.upper(n[:, None], n.reshape(30, 10).max(axis=1)[None, :], topk.gaps(d, low, high))
        assert (block >= true.reshape(300, 30, 10).max(axis=2) * (1 - 1e-12)).all()


def brute_quality(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if x.strip(SPACES)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_base_equals_brute_force(docs, spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((repr(r["doc_id"]), *(r[f] for f in fields)) for r in got) == sorted((repr(r[0]), *brute_quality(r[1])) for r in ROWS)
    assert all(not r["kept"] for r in got if r["base_failed"]) and any(r["n_repeat_words"] for r in got)
    assert all(r["kept"] for r in got if not r["base_failed"])


def test_binomial_bound_is_exact(spark):
    cases = [(0, 1, 0.004), (0, 2000, 0.004), (3, 2000, 0.004), (40, 20000, 0.004), (7, 50, 0.2), (3000, 1_000_000, 0.004)]
    d = spark.createDataFrame(cases, "k long, n long, p double")
    for k, n, p in cases:
        got = d.where((F.col("k") == k) & (F.col("n") == n)).select(quality.binomial_below(F.col("k"), F.col("n"), p)).first()[0]
        terms = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k + 1)]
        assert got == pytest.approx(math.fsum(map(math.exp, terms)), rel=1e-6)


def test_thresholds_reject_only_at_low_risk(spark):
    good = [(i, "plain words stand here in a row of ten or more indeed " + "ab " * 0 + str(i), "en") for i in range(4000)]
    bad = [(10000 + i, "# $ % & * | < > # $ % plain words & * | < > " + str(i), "en") for i in range(50)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(4000)] + [(10000 + i, 0) for i in range(50)], "doc_id long, quality int")
    out = quality.judge(d, labels)
    assert out.where("doc_id < 10000 AND NOT kept").count() == 0
    assert out.where("doc_id >= 10000 AND kept").count() == 0


def test_small_strata_get_cutoffs(spark):
    # 300 good labels suffice for one verdict at 2 % in two strata, 150 don't.
    data, labels = [], []
    for at, lang, n in ((0, "es", 300), (10_000, "fr", 150)):
        data += [(at + i, f"plain words stand here in a row of ten or more indeed {i}", lang) for i in range(n)]
        data += [(at + 1000 + i, f"# $ % & * | < > plain words stand here in a row {i}", lang) for i in range(40)]
        data += [(at + 2000 + i, f"extraordinarily lengthened compositions notwithstanding incomprehensible characterisations everywhere throughout documentation {i}", lang) for i in range(40)]
        labels += [(at + i, 1) for i in range(n)] + [(at + k + i, 0) for k in (1000, 2000) for i in range(20)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    out = {(r["stratum"], r["k"]): r["n"] for r in quality.judge(d, spark.createDataFrame(labels, "doc_id long, quality int"), joint=True).where("NOT base_failed").groupBy("stratum", F.when(F.col("doc_id") % 10_000 < 1000, "good").otherwise("poor").alias("kind"), "kept").agg(F.count("*").alias("n")).select("stratum", F.concat_ws(" ", "kind", F.col("kept").cast("string")).alias("k"), "n").collect()}
    assert out == {("es", "good true"): 300, ("es", "poor false"): 80, ("fr", "good true"): 150, ("fr", "poor true"): 80}


def brute_licenses(text):
    words = lambda x: re.findall(r"[^\W_]+", x.lower())
    grams = lambda w: set(zip(w, w[1:])) if len(w) > 1 else set(w)
    t = {k: grams(words(v)) for k, v in license.TEMPLATES.items()}
    out = []
    for i, x in enumerate((text or "").split("\n")):
        g = grams(words(x))
        best = sorted((-2 * len(g & o) / (len(g) + len(o)), k) for k, o in t.items())
        if -best[0][0] >= 0.8:
            out.append(("line", i, best[0][1], -best[0][0]))
    return out


def test_license_scan_equals_brute_force(spark):
    mit = license.TEMPLATES["MIT"]
    data = [(1, f"intro\n{mit}\nLicensed under the Apache License, Version 2.0!"), (1, f"intro\n{mit}\nLicensed under the Apache License, Version 2.0!"), (2, None), (3, ""), (4, "nothing here\nreleased under the mit license"), (5, mit.replace("Software", "Program", 2) + "\nunrelated"), (6, "one"), (None, "Released under the BSD License.")]
    d = spark.createDataFrame(data, "doc_id long, text string")
    got = [r for r in license.scan(d).collect() if r["scope"] == "line"]
    want = sorted(repr((i, *x)) for i, t in data for x in brute_licenses(t))
    assert sorted(repr((r["doc_id"], r["scope"], r["unit"], r["license"], r["dice"])) for r in got) == want
    assert len(want) == 7


def test_license_paragraphs(spark):
    lines = license.TEMPLATES["ISC"].replace(". ", ".\n")
    d = spark.createDataFrame([(1, f"code\n\n{lines}\n\nmore code")], "doc_id long, text string")
    assert [(r["scope"], r["license"]) for r in license.scan(d).where("scope <> 'line'").collect()][0] == ("paragraph", "ISC")


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    frames = [license.scan(empty), minhash.near_duplicates(empty), linededup.line_report(empty), packing.pack(empty, TOKENIZER), mixing.mix(empty), langid.identify(empty), lm.lm_scores(empty, TOKENIZER, steps=2), sharding.shard(empty), topk.top_k(vectors), quality.judge(empty, labels), minhash.keep_one(empty), linededup.dedup_lines(empty), mixing.mixed_documents(empty), langid.keep_identified(empty)]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_top_k_in_rounds_keeps_vectors_once(spark):
    r = np.random.default_rng(8)
    v = [(i, x) for i, x in enumerate(r.normal(size=(400, 8)).tolist())]
    d = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = topk.search(d, block=16, tile=2, round_bytes=400)
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got.collect()) == brute_top(v)
    # No plan carries vectors beside the queries' rows: what is ranked has no binary column.
    assert "binary" not in got._jdf.queryExecution().analyzed().treeString() and not any(kind == "binary" for _, kind in spark.read.parquet(got.inputFiles()[0]).dtypes)


def test_packed_whole_numbers():
    for v in ([[1, -128]], [[1, 200]], [[2**40, 0]], [[2**70, -(10**320)]], [[0, 0], [127, -127]]):
        for kind in (object, np.int64) if max(abs(c) for row in v for c in row) < 2**62 else (object,):
            assert topk.unpacked(topk.packed(np.array(v, kind)), 2).tolist() == v
    assert topk.beyond(10**30) > topk.beyond(10**29) > topk.beyond(2**63 - 1) and topk.beyond(-(10**30)) < topk.beyond(-(10**29)) and topk.beyond(5) == ""


def test_trainers_learn_from_every_training_window(spark, monkeypatch):
    seen = []
    fit = lm.ClassModel.fit
    monkeypatch.setattr(lm.ClassModel, "step", lambda self, inputs, targets, real: (seen.append(len(inputs)), (0.0, {}))[1])
    model = lm.ClassModel(np.ones(lm.IDS + 1, np.int64), classes=4)
    w = np.zeros((1000, lm.LENGTH + 1), np.int32)
    fit(model, w, -(-len(w) // lm.BATCH), once=True)
    assert sum(seen) == len(w)
    monkeypatch.undo()
    # More windows than the first fit takes: trainers get all of them, not a share.
    dealt, some = [], lm._some_windows
    monkeypatch.setattr(lm, "_some_windows", lambda rate: (dealt.append(rate), some(rate))[1])
    rows = [(True, i, np.arange(i, i + 60, dtype="<u2").tobytes()) for i in range(40)]
    lm.train(spark.createDataFrame(rows, "learnt boolean, k1 long, ids binary"), windows=20, steps=2)
    assert dealt[1:] == [1.0]


def test_windows_dealt_out_are_those_of_the_texts():
    ids = [np.arange(n, dtype="<u2") for n in (0, 1, 22, 23, 24, 25, 47, 48, 500, *[30] * 200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ids))), pa.array([x.tobytes() for x in ids], pa.binary())], ["k1", "ids"])
    got = pa.Table.from_batches(list(lm._some_windows(1.0)([batch])))
    windows, text = lm.windows_of(ids)
    assert got["window"].to_pylist() == [w.astype("<u2").tobytes() for w in windows] and got["k1"].to_pylist() == text.tolist()


def test_trainers_run_side_by_side(spark, monkeypatch):
    rows = [(True, i, np.arange(i, i + 60, dtype="<u2").tobytes()) for i in range(40)]
    d = spark.createDataFrame(rows, "learnt boolean, k1 long, ids binary")
    jobs = []
    # One trainer, then fifteen: no more jobs, of which the driver runs one after the other.
    for each in (120, 8):
        monkeypatch.setattr(lm, "TRAINER_WINDOWS", each)
        spark.sparkContext.setJobGroup(f"trainers of {each}", "")
        lm.train(d, windows=20, steps=2)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trainers of {each}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1] > 0


def test_lost_lines_meet_texts_by_a_merge_join_at_any_size(spark):
    d = spark.createDataFrame([(i, "a line that is long enough to count as one of its own\nx") for i in range(8)], "doc_id long, text string")
    assert "strategy=merge" in linededup.line_report(d)._jdf.queryExecution().optimizedPlan().toString()


def test_trainers_read_windows_by_column():
    r = np.random.default_rng(3)
    windows = r.integers(0, 300, (700, lm.LENGTH + 1)).astype("<u2")
    rows = [w.tobytes() for w in windows]
    for kind in (pa.binary(), pa.large_binary()):
        assert (lm.packed_rows(pa.array(rows, kind).slice(5, 90)) == windows[5:95]).all() and lm.packed_rows(pa.array([], kind)).shape == (0, lm.LENGTH + 1)

    class Shared:
        value = lm.ClassModel(np.ones(lm.IDS + 1, np.int64), classes=4)

    column = lambda a, b: pa.RecordBatch.from_arrays([pa.array([3] * 400 + [8] * 300, pa.int64()).slice(a, b - a), pa.array(rows, pa.binary()).slice(a, b - a)], ["trainer", "window"])
    one = [x.to_pylist()[0] for x in lm._trainers(Shared)(iter([column(0, 700)]))]
    cut_up = [x.to_pylist()[0] for x in lm._trainers(Shared)(iter([column(0, 250), column(250, 250), column(250, 420), column(420, 700)]))]
    assert one == cut_up and [(x["trainer"], x["n"]) for x in one] == [(3, 400), (8, 300)] and one[0]["weights"] != one[1]["weights"]


@pytest.mark.parametrize("scale", [1, 40])
def test_training_step_equals_plain_softmax(scale):
    """The loss is that of the probabilities that score texts, and where exp() would pass single precision gradients stay finite."""
    r = np.random.default_rng(6)
    m = lm.ClassModel(r.integers(0, 50, lm.IDS + 1))
    for k in ("Q", "K", "W"):
        m.p[k] *= scale
    w, _ = lm.windows_of([r.integers(0, 5000, 400)])
    x, goal = m.input_of[w[:, :-1]], w[:, lm.CONTEXT + 1 :]
    real = np.concatenate((np.ones((len(w), 1), bool), goal[:, :-1] != lm.END), axis=1)
    loss, grad = m.step(x, goal, real)
    last, own = np.minimum(x[:, lm.CONTEXT :], m.frequent), m.rank[goal]
    of_class = m.log_probabilities(x, goal) - m.after[last, own] - m.within[goal]
    assert loss == pytest.approx(-of_class[real].mean(), abs=1e-3 * scale) and all(np.isfinite(g).all() for g in grad.values())


def test_dealt_rows_hold_every_window_once():
    ids = [np.arange(i, i + n, dtype="<u2") for i, n in enumerate((0, 1, 24, 500, *[70] * 90))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ids))), pa.array([x.tobytes() for x in ids], pa.binary())], ["k1", "ids"])
    windows = lm.windows_of(ids)[0].astype("<u2")

    def dealt(batches):
        rows = [r for out in lm._dealt(lm._some_windows(1.0), 3, 2)(iter(batches)) for r in out.to_pylist()]
        assert all(len(r["window"]) % (2 * (lm.LENGTH + 1)) == 0 for r in rows)
        return rows, sorted((r["trainer"], r["block"], r["window"][a : a + 2 * (lm.LENGTH + 1)]) for r in rows for a in range(0, len(r["window"]), 2 * (lm.LENGTH + 1)))

    rows, one = dealt([batch])
    # A row for each trainer's block, whatever the number of windows; where a window goes does not depend on its batch.
    assert len(rows) == 6 and sorted(w for _, _, w in one) == sorted(w.tobytes() for w in windows)
    assert dealt([batch.slice(50), batch.slice(0, 50)])[1] == one

    class Shared:
        value = lm.ClassModel(np.ones(lm.IDS + 1, np.int64), classes=4)

    rows.sort(key=lambda r: (r["trainer"], r["block"]))
    column = lambda names: [pa.RecordBatch.from_arrays([pa.array([r[n] for r in names], kind) for n, kind in (("trainer", pa.int64()), ("window", pa.binary()), ("block", pa.int64()))], ["trainer", "window", "block"])]
    whole = [x.to_pylist()[0] for x in lm._trainers(Shared)(iter(column(rows)))]
    halves = [{**r, "window": part} for r in rows for k in [len(r["window"]) // 132 * 66] for part in (r["window"][k:], r["window"][:k])]
    # In what order a block's rows come does not matter.
    assert [x.to_pylist()[0] for x in lm._trainers(Shared)(iter(column(halves)))] == whole and sum(x["n"] for x in whole) == len(windows)


def test_training_step_of_an_unpickled_model():
    """Arrays that were pickled have a dtype object of their own, with which sums by index take many times as long; steps leave no trace in the arrays they share."""
    r = np.random.default_rng(2)
    m = pickle.loads(pickle.dumps(lm.ClassModel(r.integers(0, 50, lm.IDS + 1))))
    w, _ = lm.windows_of([r.integers(0, 900, 400)])
    x, goal = m.input_of[w[:, :-1]], w[:, lm.CONTEXT + 1 :]
    real = np.ones(goal.shape, bool)
    loss, grad = m.step(x, goal, real)
    assert grad["E"].dtype is np.dtype(np.float32)
    kept = {k: v.copy() for k, v in grad.items()}
    few = m.log_probabilities(x[:3], goal[:3])
    m.step(x[5:], goal[5:], real[5:])
    assert all((kept[k] == grad[k]).all() for k in kept) and np.abs(m.log_probabilities(x, goal)[:3] - few).max() < 1e-4 and m.step(x, goal, real)[0] == loss


def test_ids_by_column_are_the_tokenizers():
    """Texts at once, each different word merged or looked up once: the ids of the tokenizer itself, whatever stands beside a word."""
    r = np.random.default_rng(4)
    words = ["".join(r.choice(list("abcdeéßñüžǆthouie"), r.integers(1, 45))) + str(r.choice(["", ".", ",", "!", "×", "÷"])) for _ in range(800)]
    odd = ["", " ", "a  b", "a\n b", "\n\n", "\n", "don't I'll 'tis", "a\tb c", "日本 語。 テ", "<|endoftext|> a <|endoftext|>b", "x.\ny, z.\n\nq", " lead", "trail ", "trail\n", "\nlead a", "a \x1c b", "a b c  d", ". , .\n,", "naïve café.\nÉté, × a×b ÷", "aaaa aaaaaaaaa.\naaaaaaa", "ǅ ɐ ɏ я.", "b \nc"]
    texts = [*odd, *["".join(w + str(r.choice([" ", "\n"], p=[0.9, 0.1])) for w in r.choice(words, 60)).strip() for _ in range(60)]]
    data, offsets = "".join(texts).encode(), np.cumsum([0, *[len(t.encode()) for t in texts]])
    w = packing.WordwiseTokenizer(TOKENIZER)
    assert w.merges is not None
    for _ in range(2):
        ids, bounds = w.column(np.frombuffer(data, np.uint8), offsets)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [w.whole.encode(t, add_special_tokens=False).ids for t in texts]
    # Words of letters are merged side by side and not remembered one by one.
    few = packing.WordwiseTokenizer(TOKENIZER)
    few.column(np.frombuffer(b"water stone. house\nriver, light", np.uint8), np.array([0, 31]))
    assert not few.new
    assert [len(x) for x in w.column(np.zeros(0, np.uint8), np.zeros(3, np.int64))] == [0, 3] and [len(x) for x in w.column(np.zeros(0, np.uint8), np.zeros(1, np.int64))] == [0, 1]


def test_bounded_products_are_not_scanned():
    """Where the lengths of queries and keys bound their products no array is searched for large ones; where they do not, one is."""
    m = lm.ClassModel(np.random.default_rng(0).integers(0, 50, lm.IDS + 1))
    bound = lambda: np.abs((m.p["E"][:, None] + m.p["P"]).reshape(-1, lm.WIDTH)[:4000] @ m.products()[0] @ (m.p["E"][:500] + m.p["P"][3]).T).max()
    m.p["E"] *= 0.3
    assert not m.tables()[5] and bound() <= lm.SAFE
    m.p["Q"] *= 400
    assert m.tables()[5] and bound() > lm.SAFE


def test_places_are_those_of_a_binary_search():
    r = np.random.default_rng(5)
    for n in (0, 1, 7, 5000):
        words = np.unique(np.concatenate((r.integers(0, 2**64, n, dtype=np.uint64), np.arange(n // 2, dtype=np.uint64))))
        own = np.concatenate((words, r.integers(0, 2**64, 500, dtype=np.uint64), np.array([0, 3, 2**64 - 1], np.uint64)))
        assert (lm.Places(words).of(own) == np.searchsorted(words, own)).all()
