"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Targets: sources in code-point order, null last, weigh 3, 1, 2, repeating, and share SHARE times all words; a target
stops at CAP times its source's words, and the excess is shared again by weight until none is above.
Schedule: slot i stands at frac(i * golden ratio); the sources' cumulative shares of the targets map it to a source,
and slots are ranked per source. A source's documents, shuffled by a hash, make a stream of words, read
up to CAP times over and cut into blocks of equal words; the slot of rank r takes block r. The points alone decide what is
taken: a source gets as many blocks as slots fall to it, which is within a few blocks of its target, and a document's place in the mix is that
of the first slot that takes words of it. A block has BLOCK words, or 1 / SLOTS of all words to take if that is less, so that a
small mix is cut finely enough too.

Null or empty text: size 0, nothing taken. Null source: a source of its own, the last. Repeated rows: each is
a row of its own. Null doc_id: kept. A source without words: target 0. Ties of the shuffling hash go by doc_id, text hash and size.
Very long texts: only their words are counted; one document may span many blocks. Empty tables: no rows. Other columns, of any
name, are ignored by mix() and kept by mixed_documents()."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import NOT_SPACE, cut, half_range, running, two_level

WEIGHTS, SHARE, CAP, BLOCK, SLOTS, SEED = (3, 1, 2), 1.5, 2, 256, 1 << 15, 20
GOLDEN = 0.6180339887498949
#: frac(GOLDEN * 2 ** 20), for slot numbers beyond a double's reach.
GOLDEN_20 = 0.607787409740351
#: Parts in which a source's rows meet its target.
SALTS = 64


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> tuple[DataFrame, float, int]:
    """(source, source_size, source_rows, s (the source's number) and target from rows (source, size), a row for each source; the sum of the targets; how many sources)."""
    total = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows")))
    words, sources = total.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    weight = float(sources // len(weights) * sum(weights) + sum(weights[: sources % len(weights)]))
    d = running(total, [F.col("source").asc_nulls_last()]).withColumnRenamed("i", "s")
    d = d.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int")).cast("double"))
    d = d.withColumn("_cap", (F.col("source_size") * cap).cast("double")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    d = cut(running(d, [F.col("_ratio"), F.col("s")], cap=F.col("_cap"), w=F.col("_w")))
    # The level if all sources that fill up earlier are full and this one is not; the first such source sets it.
    d = d.withColumn("_level", (F.lit(float(words) * share) - F.col("before_cap")) / (F.lit(weight) - F.col("before_w")))
    at = d.where(F.col("_ratio") > F.col("_level")).agg(F.min(F.struct("_ratio", "s", "_level")).alias("at")).first()["at"]
    goal = F.col("_cap")
    if at is not None:
        full = (F.col("_ratio") < F.lit(at["_ratio"])) | ((F.col("_ratio") == F.lit(at["_ratio"])) & (F.col("s") < F.lit(at["s"])))
        goal = F.when(full, F.col("_cap")).otherwise(F.lit(at["_level"]) * F.col("_w"))
    return d.select("source", "source_size", "source_rows", "s", goal.alias("target")), float(words) * (share if at is not None else cap), sources


def _stream(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source and size of each row, with the key that shuffles it."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")
    mark = F.xxhash64(F.lit(seed), text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), mark).alias("key"), mark.alias("mark"))


def golden(slot):
    """frac(slot * golden ratio), for whole numbers up to 2 ** 40."""
    high, low = F.floor(slot / (1 << 20)), slot % (1 << 20)
    return (high * GOLDEN_20 + low * GOLDEN) % 1.0


def _schedule(goal: DataFrame, total: float, sources: int, block: int, points=golden) -> DataFrame:
    """slot, s, block: which block of which source each slot takes. goal: s, target; a row for each source."""
    spark = goal.sparkSession
    shares = running(goal.where("target > 0").select("s", "target"), [F.col("s")], target=F.col("target"))
    n, whole = int(-(-total // block)), F.lit(total or 1.0)
    shares = shares.select("s", (F.col("before_target") / whole).alias("lo"), ((F.col("before_target") + F.col("target")) / whole).alias("hi"))
    # The last share ends at 1, whatever the rounding of sums gives.
    shares = shares.withColumn("hi", F.when(F.col("hi") > 1 - 1e-9, 1.0).otherwise(F.col("hi")))
    # A point and the shares that may hold it meet in a cell of a grid.
    grid = max(4096, 1 << (4 * max(sources, 1)).bit_length())
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * grid), F.least(F.floor(F.col("hi") * grid), F.lit(grid - 1)))))
    slots = spark.range(n).select(F.col("id").alias("slot"), points(F.col("id")).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * grid)).join(cells, "cell").where("lo <= u AND u < hi").select("slot", "s")
    step = max(1, int(n**0.5))
    return two_level(slots, "s", F.floor(F.col("slot") / step), [F.col("slot")], F.lit(1)).select("slot", "s", F.col("pos").alias("block"))


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED, points=golden) -> DataFrame:
    """A row for each row of docs (doc_id, text, source): doc_id, size, source, source_size, target, taken, slot (the
    first that takes words of it, null without one), slots (that of each reading), all_slots, key and mark.

    points maps slot numbers to [0, 1); another set of points gives another mix."""
    rows = cut(_stream(docs, seed))
    goal, total, sources = targets(rows)
    block = max(1, min(block, int(total // SLOTS)))
    schedule = _schedule(goal, total, sources, block, points)
    # A hot source's rows meet its target in SALTS parts.
    salted = goal.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "_source")
    d = rows.withColumn("_salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(salted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_part"))).select(*rows.columns, "s", "source_size", "source_rows", "target")
    d = two_level(d, "s", half_range(F.col("key"), F.col("source_rows")), [F.col("key"), F.col("doc_id"), F.col("mark"), F.col("size")], F.col("size"))
    turns = F.transform(F.sequence(F.lit(0), F.lit(CAP - 1)), lambda e: F.struct(e.alias("turn"), (e * F.col("source_size") + F.col("before")).alias("a"), (e * F.col("source_size") + F.col("before") + F.col("size")).alias("b")))
    spans = F.flatten(F.transform(F.filter(turns, lambda t: t["a"] < t["b"]), lambda t: F.transform(F.sequence(F.floor(t["a"] / block), F.floor((t["b"] - 1) / block)), lambda k: F.struct(t["turn"].alias("turn"), k.alias("block"), (F.least(t["b"], (k + 1) * block) - F.greatest(t["a"], k * block)).alias("n")))))
    d = d.withColumn("span", F.explode_outer(spans)).withColumn("block", F.col("span.block")).withColumn("n", F.col("span.n")).withColumn("turn", F.col("span.turn"))
    # A hot source's rows spread by block as well.
    d = d.join(schedule, ["s", "block"], "left")
    taken = F.when(F.col("slot").isNotNull(), F.col("n"))
    readings = F.array(*[F.min(F.when(F.col("turn") == e, F.col("slot"))) for e in range(CAP)])
    out = d.groupBy("s", "pos", "doc_id", "source", "size", "source_size", "target", "key", "mark").agg(F.coalesce(F.sum(taken), F.lit(0)).cast("long").alias("taken"), F.min("slot").alias("slot"), readings.alias("slots"))
    return out.withColumn("all_slots", F.lit(int(-(-total // block))).cast("long")).drop("s", "pos")


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED, points=golden) -> DataFrame:
    """The rows of docs as often as the mix takes them (taken / size, to the nearest whole number, a half rounds up), in the
    order of the slots that take them: partitions are runs of slots, each sorted.

    Rows alike in id, text and source can't be told apart in the mix: what it takes of them is dealt out evenly among them, and
    from the second copy on their places are spread over all slots by a hash."""
    times = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("long")
    places = F.filter(F.col("slots"), lambda x: x.isNotNull())
    plan = mix(docs, block, seed, points).where("taken > 0").select(F.col("doc_id").alias("id"), "mark", "source", times.alias("times"), places.alias("places"), "slot", "all_slots")
    plan = plan.groupBy("id", "mark", "source").agg(F.sum("times").alias("times"), F.count("*").alias("rows"), F.min("slot").alias("slot"), F.min("places").alias("places"), F.first("all_slots").alias("all_slots")).where("times > 0")
    text = F.col("text").cast("string")
    # The whole row is one column, so no name of docs can clash.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.lit(seed), text).alias("own_mark"), F.col("source").cast("string").alias("own_source"))
    whole = whole.join(plan, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_mark") == F.col("mark")) & F.col("own_source").eqNullSafe(F.col("source")))
    spread = lambda k: F.pmod(F.xxhash64("id", "mark", k), F.col("all_slots"))
    alone = whole.where("rows = 1").select("row", "all_slots", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("times") - 1), lambda k: F.coalesce(F.get("places", k.cast("int")), spread(k)))).alias("slot"))
    # Rows alike are counted by their other columns first, so that none gathers them; of r rows with t times in all, each stands ceil(t / r) or floor(t / r) times.
    kinds = whole.where("rows > 1").withColumn("kind", F.xxhash64(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ("text", "doc_id", "source")], F.lit(0)))
    kinds = kinds.groupBy("id", "mark", "source", "kind").agg(F.count("*").alias("n"), F.first("row").alias("row"), F.first("times").alias("times"), F.first("rows").alias("rows"), F.first("slot").alias("slot"), F.first("all_slots").alias("all_slots"))
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("id", "mark", "source").orderBy("kind").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    copies = F.col("n") * F.floor(F.col("times") / F.col("rows")) + F.greatest(F.lit(0), F.least(F.col("n"), F.col("times") % F.col("rows") - ahead))
    kinds = kinds.withColumn("copies", copies).withColumn("ahead", ahead).where("copies > 0")
    alike = kinds.select("row", "all_slots", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda k: F.when((k == 0) & (F.col("ahead") == 0), F.col("slot")).otherwise(spread(k + F.col("ahead") * CAP)))).alias("slot"))
    both = alone.unionByName(alike)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.least(F.floor(F.col("slot") * parts / F.col("all_slots")), F.lit(parts - 1)).cast("int")
    return both.repartitionById(parts, place).sortWithinPartitions("slot").select("row.*")
