"""Balanced label propagation into shards under capacity quotas (DataFrame functions only).

Law `rows`: shard sizes in documents differ by one at most. Linked documents (equal texts) form a group; a group of more documents
than a shard holds is cut into units of a shard's size, any other group is one unit. A cut edge is a pair of documents of one unit
in different shards.

Start: the linked documents, in the order of a hash of their ids that knows nothing of groups, are dealt to the shards in equal
runs, so nearly every unit is cut. Rounds of propagation, each a few joins over one row for each (unit, shard): a unit's parts ask to move to the shard that holds
most of it (ties by a hash that changes with the round) or, where none of its shards has room, in every second round to one
that has. For each pair of shards the driver admits as many documents as keep every shard within its quota (a matrix of shards x
shards; inflow may exceed outflow by the room left for documents without links), the largest parts
first. Of the units of which nothing could move, some ask again and parts of the others give way to them, one document for
one. Rounds end when no unit is cut or ROUNDS have run. Documents without links have no edges and fill what is left.

Null text: size 16, one group with other null texts. Repeated rows: each is placed. Null doc_id: placed. Ties of the hash go by doc_id and
group. Very long texts: only their hashes and lengths go on. Fewer documents than shards: the first shards get one each. Empty tables: no rows. Other columns, of
any name, are ignored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, half_range, key_range, two_level

SHARDS, OVERHEAD, ROUNDS, SEED = 40, 16, 8, 8
#: Documents of a unit that meet its placement in one task.
CHUNK = 256
#: Cycles that the driver looks for in a matrix of shards x shards, at most; each step is lawful by itself.
CYCLES = 20_000


def _grouped(docs: DataFrame, seed: int) -> DataFrame:
    """A narrow row for each document: its ids, size, group (g1, g2) and a key that spreads the group."""
    text = F.col("text").cast("string")
    full = F.coalesce(text, F.lit(""))
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(full) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(full, "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), text.isNull(), full).alias("g1"),
        F.xxhash64(F.lit(seed + 1), text.isNull(), full).alias("g2"),
    )
    return d.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "g2"))


def _start(linked: DataFrame, total: int, shards: int) -> DataFrame:
    """g1, g2, unit, shard, n: how many documents of each unit the start deals to each shard. linked: rows of groups with more than one.

    Units are ranges of the key, so the start takes another hash of it."""
    linked = linked.withColumn("key", F.xxhash64(F.lit(SEED + 2), "key"))
    d = two_level(linked.withColumn("_all", F.lit(0)), "_all", key_range(F.col("key")), [F.col("key"), F.col("doc_id"), F.col("g1")], F.lit(1))
    q, r = divmod(total, shards)
    edge = r * (q + 1)
    shard = F.when(F.col("pos") < edge, F.floor(F.col("pos") / (q + 1))).otherwise(r + F.floor((F.col("pos") - edge) / max(q, 1)))
    return d.withColumn("shard", shard.cast("int")).groupBy("g1", "g2", "unit", "shard").agg(F.count("*").alias("n"))


def admitted(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the wanted moves (from, to) may go so that no shard gains more than its room: as many in sum as can.

    Starts from the moves that swap between two shards and augments along cycles that let more in than they take back, over the
    shards and one node more that stands for the room left. Every step is lawful; without such a cycle the sum is the most."""
    n = len(room)
    want = np.zeros((n, n), np.int64)
    for (a, b), k in wanted.items():
        want[a, b] = k
    flow = np.minimum(want, want.T)
    for _ in range(CYCLES):
        gain = flow.sum(axis=0) - flow.sum(axis=1)
        # A step along (a, b) lets a move in (-1), takes one of (b, a) back (+1), uses room or frees it (0).
        cost = np.full((n + 1, n + 1), np.inf)
        cost[:n, :n] = np.where(want > flow, -1.0, np.where(flow.T > 0, 1.0, np.inf))
        cost[:n, n] = np.where(np.array(room) > gain, 0.0, np.inf)
        cost[n, :n] = 0.0
        far, come, last = np.zeros(n + 1), np.zeros(n + 1, np.int64), None
        for _ in range(n + 1):
            by = far[:, None] + cost
            now = by.min(axis=0)
            closer = now < far
            come = np.where(closer, by.argmin(axis=0), come)
            far = np.minimum(far, now)
            last = np.flatnonzero(closer)
            if not len(last):
                break
        if not len(last):
            break
        at = int(last[0])
        for _ in range(n + 1):
            at = int(come[at])
        cycle, x = [], at
        while not cycle or x != at:
            cycle.append((int(come[x]), x))
            x = int(come[x])
        least = min(int(want[a, b] - flow[a, b]) if a < n > b and cost[a, b] < 0 else int(flow[b, a]) if a < n > b else int(room[a] - gain[a]) if b == n else 1 << 62 for a, b in cycle)
        for a, b in cycle:
            if a < n > b:
                if cost[a, b] < 0:
                    flow[a, b] += least
                else:
                    flow[b, a] -= least
    return {(int(a), int(b)): int(flow[a, b]) for a, b in np.argwhere(flow > 0)}


def cut_pairs(parts: DataFrame) -> int:
    """Pairs of documents of one unit that lie in different shards. parts: g1, g2, unit, shard, n."""
    per = parts.groupBy("g1", "g2", "unit").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return int(per.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.lit(0.0))).first()[0])


def _admitted_parts(ranked: DataFrame, flow: dict[tuple[int, int], int], shards: int) -> DataFrame:
    """g1, g2, unit, shard, goal, n: how many documents of each asking part its stream's quota lets go, in the order of the ranks."""
    if not flow:
        return ranked.select("g1", "g2", "unit", "shard", "goal", "n").where("false")
    quota = F.create_map(*[x for (a, b), n in flow.items() for x in (F.lit(a * shards + b), F.lit(n))])
    goes = F.greatest(F.lit(0), F.least(F.col("n"), F.coalesce(F.try_element_at(quota, F.col("stream")), F.lit(0)) - F.col("before")))
    return ranked.withColumn("goes", goes.cast("long")).where("goes > 0").select("g1", "g2", "unit", "shard", "goal", F.col("goes").alias("n"))


def _yields(parts: DataFrame, unmet: dict[tuple[int, int], int], most: dict[int, int], seed: int) -> DataFrame:
    """g1, g2, unit, shard, goal, n: parts in a shard that others could not enter, the smallest first, which change places with those.

    A part that moves as one cuts no more pairs; it is split only where it is no larger than the largest core that asks (most)."""
    unit = ["g1", "g2", "unit"]
    at, ends = {s: 0 for _, s in unmet}, []
    for (a, s), n in sorted(unmet.items(), key=lambda x: (x[0][1], -x[1], x[0])):
        ends.append((s, F.struct(F.lit(at[s]).alias("low"), F.lit(at[s] + n).alias("high"), F.lit(a).alias("goal"))))
        at[s] += n
    per = F.create_map(*[x for s in at for x in (F.lit(s), F.array(*[e for t, e in ends if t == s]))])
    ranked = two_level(parts.where(F.col("shard").isin(list(at))), "shard", F.floor(F.log2("n")).cast("int") * 256 + F.pmod(F.xxhash64(F.lit(seed), *unit), F.lit(256)), [F.col(c) for c in unit], F.col("n"))
    core = F.try_element_at(F.create_map(*[x for s, n in most.items() for x in (F.lit(s), F.lit(n))]), F.col("shard"))
    until = F.col("before") + F.col("n")
    meets = F.filter(F.try_element_at(per, F.col("shard")), lambda e: (e["low"] < until) & (F.col("before") < e["high"]))
    met = ranked.select("*", core.alias("core"), F.explode(meets).alias("e"))
    part = F.least(F.col("e.high"), until) - F.greatest(F.col("e.low"), F.col("before"))
    return met.withColumn("part", part.cast("long")).where("part = n OR n <= core").select(*unit, "shard", F.col("e.goal").alias("goal"), F.col("part").alias("n"))


def _round(parts: DataFrame, holds: list[int], turn: int, seed: int) -> DataFrame:
    """parts after one round. holds: how many documents each shard may hold."""
    unit = ["g1", "g2", "unit"]
    shards = len(holds)
    now = {r["shard"]: r["n"] for r in parts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    room = [holds[s] - now.get(s, 0) for s in range(shards)]
    open_ = [s for s in range(shards) if room[s] > 0]
    luck = F.xxhash64(F.lit(seed + turn), *unit, "shard")
    has_room = F.col("shard").isin(open_) if open_ else F.lit(False)
    per = parts.groupBy(*unit).agg(F.count("*").alias("parts"), F.max(has_room).alias("roomy"), F.max(F.struct("n", luck.alias("luck"), "shard")).alias("best"), F.max("n").alias("most")).where("parts > 1")
    goal = F.col("best.shard")
    if open_ and turn % 2:
        elsewhere = F.element_at(F.array(*map(F.lit, open_)), (F.pmod(F.xxhash64(F.lit(seed + turn), *unit), F.lit(len(open_))) + 1).cast("int"))
        goal = F.when(F.col("roomy"), goal).otherwise(elsewhere)
    goals = per.select(*unit, goal.cast("int").alias("goal"), "most")
    asks = cut(parts.join(goals, unit).where("shard <> goal"))
    wanted = {(r["shard"], r["goal"]): r["n"] for r in asks.groupBy("shard", "goal").agg(F.sum("n").alias("n")).collect()}
    flow = admitted(wanted, room)
    # Within a stream from shard to shard, parts of units with a larger core go first.
    order = F.floor(F.log2("most")).cast("int") * -256 + F.pmod(F.xxhash64(*unit), F.lit(256))
    asks = asks.withColumn("stream", F.col("shard") * shards + F.col("goal"))
    moved = _admitted_parts(two_level(asks, "stream", order, [F.col(c) for c in unit], F.col("n")), flow, shards)
    if any(n > flow.get(k, 0) for k, n in wanted.items()):
        # Of the units of which nothing moves, some (the largest core of each shard and, by a hash, half of the others) ask again
        # and the others give way, so no part does both and shards change places one for one.
        moved = cut(moved)
        asks = asks.join(moved.select(*unit).distinct(), unit, "left_anti").withColumn("toss", F.xxhash64(F.lit(seed - turn), *unit))
        firm = asks.groupBy("goal").agg(F.max(F.struct("most", "toss")).alias("firm"))
        asks = cut(asks.join(F.broadcast(firm), "goal").where((F.struct("most", "toss") == F.col("firm")) | (F.pmod("toss", F.lit(2)) == 0)).drop("toss", "firm"))
        unmet = {(r["shard"], r["goal"]): r["n"] for r in asks.groupBy("shard", "goal").agg(F.sum("n").alias("n")).collect()}
        if unmet:
            rest = parts.join(moved.select(*unit).unionByName(asks.select(*unit)).distinct(), unit, "left_anti")
            most = {r["goal"]: r["most"] for r in asks.groupBy("goal").agg(F.max("most").alias("most")).collect()}
            yields = cut(_yields(rest, unmet, most, seed + turn))
            swaps = {(r["goal"], r["shard"]): r["n"] for r in yields.groupBy("shard", "goal").agg(F.sum("n").alias("n")).collect()}
            enters = _admitted_parts(two_level(asks, "stream", order, [F.col(c) for c in unit], F.col("n")), swaps, shards)
            moved = moved.unionByName(yields).unionByName(enters)
    change = moved.select(*unit, F.col("goal").alias("shard"), "n").unionByName(moved.select(*unit, "shard", (-F.col("n")).alias("n")))
    return cut(parts.unionByName(change).groupBy(*unit, "shard").agg(F.sum("n").alias("n")).where("n > 0"))


def propagate(parts: DataFrame, holds: list[int], rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[int]]:
    """The parts with the fewest cut pairs that the rounds gave, and the cut pairs before the first and after each."""
    history, best = [cut_pairs(parts)], parts
    for turn in range(rounds):
        if not history[-1]:
            break
        # Where nothing could move, the next round's hash breaks ties otherwise.
        parts = _round(parts, holds, turn, seed)
        history.append(cut_pairs(parts))
        if history[-1] < min(history[:-1]):
            best = parts
    return best, history


def placed(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[int]]:
    """(shard()'s rows, the cut pairs before the first round and after each)."""
    d = cut(_grouped(docs, seed))
    groups = cut(d.groupBy("g1", "g2").agg(F.count("*").alias("all")))
    total, most = groups.agg(F.coalesce(F.sum("all"), F.lit(0)), F.coalesce(F.max("all"), F.lit(0))).first()
    q, r = divmod(total, shards)
    holds = [q + (s < r) for s in range(shards)]
    whole = max(q, 1)
    unit = ["g1", "g2", "unit"]
    # Rows of large groups are dealt over several keys; rows of one group are ranked in about sqrt(n) parts.
    d = d.join(groups, ["g1", "g2"]) if most < CHUNK else d.withColumn("_salt", F.pmod("key", F.lit(64)).cast("int")).join(groups.withColumn("_salt", F.explode(F.when(F.col("all") < CHUNK, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(63))))).select("g1", "g2", "all", "_salt").withColumnRenamed("_salt", "_own"), ["g1", "g2"]).where("_own = -1 OR _own = _salt").drop("_own", "_salt")
    linked = d.where("all > 1").withColumn("g", F.struct("g1", "g2"))
    linked = two_level(linked, "g", half_range(F.col("key"), F.col("all")), [F.col("key"), F.col("doc_id")], F.lit(1)).drop("g", "before")
    linked = cut(linked.withColumn("unit", F.floor(F.col("pos") / whole)).withColumn("at", F.col("pos") % whole).drop("pos"))
    parts, history = propagate(cut(_start(linked, linked.count(), shards)), holds, rounds, seed)
    # A unit's parts in order; each takes as many of its documents as it has.
    ahead = W.partitionBy(*unit).orderBy(F.desc("n"), "shard").rowsBetween(W.unboundedPreceding, 0)
    spans = parts.withColumn("end", F.sum("n").over(ahead)).select(*unit, "shard", (F.col("end") - F.col("n")).alias("low"), F.col("end").alias("high"))
    spans = spans.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("low") / CHUNK), F.floor((F.col("high") - 1) / CHUNK))))
    linked = linked.withColumn("chunk", F.floor(F.col("at") / CHUNK)).join(spans, [*unit, "chunk"]).where("low <= at AND at < high")
    columns = ["doc_id", "size", "text_crc32", "key", "g1", "shard"]
    # Documents without links, in the order of their keys, fill the shards.
    now = {x["shard"]: x["n"] for x in parts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    ends, end = [], 0
    for s in range(shards):
        end += holds[s] - now.get(s, 0)
        ends.append(end)
    single = two_level(d.where("all = 1").withColumn("_all", F.lit(0)), "_all", key_range(F.col("key")), [F.col("key"), F.col("doc_id")], F.lit(1))
    single = single.withColumn("shard", F.coalesce(*[F.when(F.col("pos") < e, F.lit(s)) for s, e in enumerate(ends)]))
    out = linked.select(*columns).unionByName(single.select(*columns))
    # Documents without links lie in ranges of the key; another hash spreads them over a shard's slots.
    out = out.withColumn("key", F.xxhash64(F.lit(seed), "key"))
    out = two_level(out, "shard", half_range(F.col("key"), F.lit(whole)), [F.col("key"), F.col("doc_id"), F.col("g1")], F.lit(1))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("pos").alias("slot"), F.lit(None).cast("int").alias("grown_shard")), history


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard and slot (gapless from 0 in the shard) of each row of docs (doc_id, text)."""
    return placed(docs, shards, rounds, seed)[0]
