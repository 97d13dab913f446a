"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Base rules: too few words, or too many words in repeated five-word windows. Beyond them, each rule maps a document to a level
0 to LEVELS - 1, and a stratum (language) has a cutoff for each rule: levels at or above it are rejected.
Labelled documents of good quality that pass the base rules are the holdout. A rule's cutoff goes down
from the highest level as long as the exact binomial test P(X <= k | n, RISK / rules) <= ERROR / tests
holds, for k of n good documents at or above it; this is the Clopper-Pearson bound of the false
rejection rate staying below RISK / rules. The sequence is fixed, so only strata and rules count as
multiple tests (Bonferroni). With probability 1 - ERROR all strata reject less than RISK of good documents. Strata with too few labels reject nothing.

With joint, a stratum has one verdict over all rules and one sequence of steps; a step lowers one rule's cutoff. The sequence is read from
the documents outside the holdout, labelled poor or not labelled, so it is fixed beforehand: first the levels of poor documents whose tails hold no less
of the poor than the stratum does, by falling share of poor documents in the tail, then all other levels, rule by rule (of these
only what rejects no further good document). The test is P(X <= k | n, RISK) <= ERROR / strata, for k of n good documents that any rule rejects.
With k = 0, ln(strata / ERROR) / -ln(1 - RISK) good labels are needed: 217 for four strata, against 1,495 for each rule by itself.
The SQL of op10 states the cutoffs of each rule by itself, so joint is not what the query takes.

Null or empty text: no words, base_failed. Null lang: a stratum of its own. Null doc_id: no label. Repeated rows: each
judged. Several labels of one doc_id: the lowest counts. Other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import NOT_SPACE, SPACE_CHARS, cut

LEVELS, RISK, ERROR, WINDOW, MIN_WORDS, MOST_REPEATED = 64, 0.02, 0.05, 5, 10, 20
SYMBOLS = "#*$%&|<>"
#: Terms of a binomial tail that are summed one by one; the rest is bounded by a geometric series.
TERMS = 2000
RULES = ("symbols", "dup_lines", "repeats", "long_words", "short_words")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and each rule's level."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), text.alias("_t"))
    d = d.select("doc_id", "stratum", "_t", F.regexp_extract_all("_t", F.lit(f"({NOT_SPACE})"), 1).alias("_w"), F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0).alias("_l"))
    d = d.select(
        "doc_id",
        "stratum",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    grams = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_words") - WINDOW), lambda i: F.xxhash64(*[F.get("_h", (i + k).cast("int")) for k in range(WINDOW)]))
    d = d.withColumn("_g", F.when(F.col("n_words") >= WINDOW, grams).otherwise(F.array().cast("array<bigint>"))).drop("_h")
    repeated = F.size(F.array_distinct("_g")) < F.size("_g")
    d = d.withColumn("_s", F.when(repeated, F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))).drop("_g")
    same = lambda x, j: F.get("_s", j)["g"] == x["g"]
    at = F.array_sort(F.transform(F.filter("_s", lambda x, i: (F.when(i > 0, same(x, i - 1)).otherwise(False)) | F.coalesce(same(x, i + 1), F.lit(False))), lambda x: x["i"].cast("long")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate(at, start, lambda a, p: F.struct((a["n"] + WINDOW - F.greatest(a["end"] - p, F.lit(0))).cast("long").alias("n"), (p + WINDOW).cast("long").alias("end")), lambda a: a["n"])
    d = d.withColumn("n_repeat_words", F.when(F.col("_s").isNull(), F.lit(0)).otherwise(covered).cast("long")).drop("_s")
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    share = lambda a, b, steps: F.least(F.lit(LEVELS - 1), F.floor(F.col(a) * steps / F.greatest(F.col(b), F.lit(1)))).cast("int")
    levels = {"symbols": share("n_symbols", "word_chars", 200), "dup_lines": share("n_dup_lines", "_lines", LEVELS), "repeats": share("n_repeat_words", "n_words", 300), "long_words": share("word_chars", "n_words", 2), "short_words": share("n_words", "word_chars", LEVELS)}
    return d.withColumns({f"level_{k}": v for k, v in levels.items()}).drop("_lines")


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1, to about 1e-12: Stirling's series beyond a shift by eight."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return series - F.log(product)


def binomial_below(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial with n trials, for k <= p n; never below the exact value, but for rounding."""
    k, n = k.cast("double"), n.cast("double")
    log_top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    step = lambda j: j * (1 - p) / ((n - j + 1) * p)
    zero = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))
    few = F.least(k, F.lit(float(TERMS))).cast("int")
    tail = F.aggregate(F.when(few > 0, F.sequence(F.lit(0), few - 1)).otherwise(F.array().cast("array<int>")), zero, lambda a, i: F.struct((a["sum"] + a["term"] * step(k - i)).alias("sum"), (a["term"] * step(k - i)).alias("term")))
    left = F.greatest(k - few, F.lit(0.0))
    ratio = F.least(step(left), F.lit(1 - 1e-9))
    rest = F.when(left > 0, tail["term"] * ratio / (1 - ratio)).otherwise(0.0)
    return F.exp(log_top + F.log(tail["sum"] + rest))


def thresholds(rated: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum, rule, cutoff, n and k, where a cutoff holds the risk; rated: features() of all documents."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    held = rated.where("NOT base_failed").join(good, "doc_id", "left_semi")
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"level_{r}").alias("level")) for r in RULES]))
    counts = cut(held.select("stratum", pairs.alias("x")).groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.level").alias("level")).agg(F.count("*").alias("c")))
    tests = max(1, counts.select("stratum", "rule").distinct().count())
    total = counts.groupBy("stratum", "rule").agg(F.sum("c").alias("n"))
    grid = total.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(LEVELS - 1)))).join(counts.where("level > 0"), ["stratum", "rule", "level"], "left")
    down = W.partitionBy("stratum", "rule").orderBy(F.desc("level"))
    grid = grid.withColumn("k", F.sum(F.coalesce("c", F.lit(0))).over(down))
    p = risk / len(RULES)
    chance = F.when(F.col("k") <= F.col("n") * p, binomial_below(F.col("k"), F.col("n"), p)).otherwise(1.0)
    passed = grid.where(chance <= error / tests)
    return passed.groupBy("stratum", "rule").agg(F.min("level").alias("cutoff"), F.first("n").alias("n"), F.max("k").alias("k"))


def _levels(d: DataFrame) -> DataFrame:
    """stratum, rule, level and poor of each row and rule."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"level_{r}").alias("level")) for r in RULES]))
    return d.select("stratum", "poor", pairs.alias("x")).select("stratum", "poor", "x.rule", "x.level")


def steps(others: DataFrame) -> DataFrame:
    """stratum, rule, level and share of the levels that come first, by falling share; others: features() with poor, none of the holdout.

    A level's share of poor documents is the best of the tails that it helps to make: a lower cutoff takes the higher levels along."""
    cells = cut(_levels(others).groupBy("stratum", "rule", "level").agg(F.sum("poor").alias("poor"), F.count("*").alias("all")))
    rule = W.partitionBy("stratum", "rule")
    whole, tail = rule.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), rule.orderBy(F.desc("level"))
    d = cells.select("stratum", "rule", "level", "poor", *[F.sum(c).over(w).alias(f"{c}_{n}") for c in ("poor", "all") for w, n in ((whole, "whole"), (tail, "tail"))])
    d = d.where((F.col("level") > 0) & (F.col("poor") > 0) & (F.col("poor_tail") * F.col("all_whole") >= F.col("poor_whole") * F.col("all_tail")))
    return d.select("stratum", "rule", "level", F.max(F.col("poor_tail") / (F.col("all_tail") + 1)).over(rule.orderBy("level")).alias("share"))


def joint_thresholds(rated: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum, rule, cutoff, n and k (of the stratum's whole verdict), where cutoffs hold the risk; rated: features() of all documents."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"))
    marked = rated.where("NOT base_failed").join(marks, "doc_id", "left")
    good = F.coalesce(F.col("q") == 1, F.lit(False))
    held = marked.where(good)
    known = steps(marked.where(~good).withColumn("poor", F.coalesce(F.col("q") == 0, F.lit(False)).cast("long")))
    totals = cut(held.groupBy("stratum").agg(F.count("*").alias("n")))
    tests = max(1, totals.count())
    place = F.create_map(*[x for i, r in enumerate(RULES) for x in (F.lit(r), F.lit(i))])
    every = totals.select("stratum", F.explode(F.array(*map(F.lit, RULES))).alias("rule")).withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(LEVELS - 1))))
    every = every.join(known, ["stratum", "rule", "level"], "left")
    order = W.partitionBy("stratum").orderBy(F.desc_nulls_last("share"), F.when(F.col("share").isNull(), place[F.col("rule")]), F.desc("level"), "rule")
    path = cut(every.select("stratum", "rule", "level", F.col("share").isNotNull().alias("known"), F.row_number().over(order).alias("step")))
    # The first step that rejects a level of a rule: the earliest of the cutoffs at or below it.
    first = path.withColumn("first", F.min("step").over(W.partitionBy("stratum", "rule").orderBy("level")))
    maps = F.broadcast(first.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "rule", "level"), "first"))).alias("_at")))
    never = F.lit(len(RULES) * LEVELS)
    own = F.least(*[F.coalesce(F.element_at("_at", F.concat(F.lit(f"{r} "), F.col(f"level_{r}").cast("string"))), never) for r in RULES])
    hits = held.join(maps, "stratum").groupBy("stratum", own.alias("step")).agg(F.count("*").alias("c"))
    up = W.partitionBy("stratum").orderBy("step")
    d = path.join(hits, ["stratum", "step"], "left").join(totals, "stratum").withColumn("k", F.sum(F.coalesce("c", F.lit(0))).over(up))
    chance = F.when(F.col("k") <= F.col("n") * risk, binomial_below(F.col("k"), F.col("n"), risk)).otherwise(1.0)
    # The chance does not fall along the sequence, as k does not: the steps that hold come before all that do not.
    passed = d.where(chance <= error / tests)
    spent = F.max(F.when(F.col("known"), F.col("k")).otherwise(0)).over(W.partitionBy("stratum"))
    passed = passed.withColumn("_spent", spent).where("k <= _spent")
    return passed.groupBy("stratum", "rule").agg(F.min("level").alias("cutoff"), F.first("n").alias("n"), F.first("_spent").alias("k"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, joint: bool = False) -> DataFrame:
    """features() of docs (doc_id, text, lang) with kept; labels: doc_id, quality. joint: one verdict over all rules for each stratum."""
    rated = cut(features(docs))
    limits = (joint_thresholds if joint else thresholds)(rated, labels, risk, error).groupBy("stratum").pivot("rule", list(RULES)).agg(F.min("cutoff"))
    d = rated.join(limits, "stratum", "left")
    hit = F.lit(False)
    for r in RULES:
        hit = hit | F.coalesce(F.col(f"level_{r}") >= F.col(r), F.lit(False))
    return d.withColumn("kept", ~F.col("base_failed") & ~hit).drop(*RULES)
