"""Mixing sources to target weights: equal blocks of every source with release time and deadline, interleaved by earliest deadline."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.runtime import cut

#: Documents that one window group of prefix sums gets, about.
GROUP_ROWS = 50_000
#: A target table is a list of sources; more rows than this are refused rather than broadcast.
MAX_SOURCES = 10_000
#: Blocks of a mixture; blocks are larger where there would be more, so the timetable has a bounded length.
MAX_BLOCKS = 1 << 18


def reachable_total(available: dict[str, int], targets: dict[str, tuple[float, int]]) -> float:
    """The largest total in which every source that has tokens gets its share within its repeats."""
    live = {s: t for s, t in targets.items() if available.get(s) and t[0] > 0 and t[1] > 0}
    weight = sum(t[0] for t in live.values())
    return min((available[s] * r * weight / w for s, (w, r) in live.items()), default=0.0)


def allot(available: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens due to each source. Without ``total``: the largest mixture with exact shares. With one that is too large for some
    sources, these give all they may and the rest is shared by the others in proportion to their targets."""
    caps = {s: float(available.get(s, 0) * r) for s, (w, r) in targets.items() if w > 0 and r > 0 and available.get(s)}
    left = reachable_total(available, targets) if total is None else float(total)
    due: dict[str, float] = {}
    while caps:
        weight = sum(targets[s][0] for s in caps)
        full = [s for s in caps if targets[s][0] / weight * left > caps[s] * (1 + 1e-12)]
        if not full:
            return due | {s: min(caps[s], targets[s][0] / weight * left) for s in caps}
        for s in full:
            due[s] = caps.pop(s)
            left -= due[s]
    return due


def timetable(due: dict[str, int], blocks: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """``(source, block, slot, release, deadline)`` of every block, one block a slot.

    Source s has the weight w = due[s] / sum of all due. Its block k is released at slot floor(k / w) and has to be taken before slot
    ceil((k + 1) / w). Of the released blocks the one with the earliest deadline is taken, on ties that of the source first by name. Weights
    add up to 1, so every block meets its deadline, and after any number t of slots a source is less than one block off t * w.
    Times are whole numbers, computed without rounding errors.
    """
    whole = sum(due.values())
    release = lambda s, k: k * whole // due[s]
    deadline = lambda s, k: -(-(k + 1) * whole // due[s])
    waiting = [(0, s, 0) for s in sorted(due) if blocks[s]]
    ready: list[tuple[int, str, int]] = []
    out, slot = [], 0
    while waiting or ready:
        if not ready and waiting[0][0] > slot:
            slot = waiting[0][0]
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(s, k), s, k))
        end, s, k = heapq.heappop(ready)
        out.append((s, k, slot, release(s, k), end))
        slot += 1
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, (max(slot, release(s, k + 1)), s, k + 1))
    return out


def mix(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", size: str = "n_tokens", total: float | None = None, seed: int = 7, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, shares).

    Selection: ``(turn BIGINT, <key>, source, use INT, n_tokens BIGINT, block BIGINT, slot BIGINT, release BIGINT, deadline BIGINT)``. Each source gives its
    documents in random but fixed order, all of them before any is used again, as many as fit into its due tokens. This stream is cut into
    blocks of ``block`` tokens (by default those of the largest document, or the mixture's ``MAX_BLOCKS``-th part if that is more); a document goes with the
    block that holds its middle. ``timetable`` gives every block its slot between release and deadline, and documents come by slot (``turn`` from 0).
    So after any slot each source is less than one block off its weight, counted in blocks; in tokens the documents that straddle block borders come on top.

    Shares: ``(source, target_share, max_repeats, available BIGINT, taken BIGINT, reached_share, most_uses)``, one row per target.

    A document without tokens has no block; null sources and sources without a target aren't mixed; a target without documents reaches
    0 and its share falls to the others in proportion. Of repeated targets the largest share counts. A null share or repeat counts as 0. Rows with
    the same key are documents of their own, a null key too. Other columns are ignored. Empty tables give an empty selection.
    Prefix sums are taken in buckets of hashed order and then within, so no source is ever in one task; the timetable has at most ``MAX_BLOCKS`` + sources rows.
    """
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r")).where("source is not null").limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    goal = {r.source: (float(r.w or 0), int(r.r or 0)) for r in wanted}
    spark = sizes.sparkSession
    docs = sizes.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(size).alias("_n")).where((F.col("_n") > 0) & F.col("_source").isNotNull())
    docs = cut(docs.withColumn("_h", F.xxhash64("_key", F.lit(seed))))
    known = F.broadcast(spark.createDataFrame([(s,) for s in goal], "_source string"))
    stats = {r._source: r for r in docs.join(known, "_source").groupBy("_source").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("_n").alias("most")).collect()}
    available = {s: r.n for s, r in stats.items()}
    due = {s: int(t + 1e-6) for s, t in allot(available, goal, total).items()}
    due = {s: t for s, t in due.items() if t}
    end = sum(due.values())
    block = max(block or max([stats[s].most for s in due], default=1), -(-end // MAX_BLOCKS))
    slots = spark.createDataFrame(timetable(due, {s: -(-t // block) for s, t in due.items()}), "_source string, _block bigint, _slot bigint, _release bigint, _deadline bigint")

    bits = max(1, (max([r.rows for r in stats.values()] or [1]) // GROUP_ROWS).bit_length())
    plan = spark.createDataFrame([(s, t, int(available[s]), int(min(goal[s][1], -(-t // available[s])))) for s, t in due.items()], "_source string, _due bigint, _all bigint, _uses int")
    placed = docs.join(F.broadcast(plan), "_source").withColumn("_bucket", F.shiftrightunsigned("_h", 64 - bits))
    sums = placed.groupBy("_source", "_bucket").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    # Unsigned order of the hash within a bucket is its signed order: bits above are equal.
    within = Window.partitionBy("_source", "_bucket").orderBy("_h", "_key").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_upto", F.sum("_n").over(within)).join(starts, ["_source", "_bucket"])
    used = placed.withColumn("_use", F.explode(F.sequence(F.lit(0), F.col("_uses") - 1))).withColumn("_to", F.col("_use") * F.col("_all") + F.col("_start") + F.col("_upto"))
    used = used.where("_to <= _due").withColumn("_block", F.floor((F.col("_to") - F.col("_n") / 2) / block))
    used = cut(used.join(F.broadcast(slots), ["_source", "_block"]).select("_key", "_source", "_use", "_n", "_to", "_block", "_slot", "_release", "_deadline"))

    # A slot holds one block of one source, so turns are counts of earlier slots, at most MAX_BLOCKS + sources of them, and places in the block.
    counts = used.groupBy("_slot").agg(F.count(F.lit(1)).alias("_c"))
    offset = counts.select("_slot", F.coalesce(F.sum("_c").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_slot").orderBy("_to", "_key"))
    turned = used.withColumn("_rank", rank).join(F.broadcast(offset), "_slot")
    selection = turned.select(
        (F.col("_before") + F.col("_rank") - 1).alias("turn"), F.col("_key").alias(key), F.col("_source").alias("source"), (F.col("_use") + 1).cast("int").alias("use"), F.col("_n").alias("n_tokens"),
        F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_release").alias("release"), F.col("_deadline").alias("deadline"),
    )

    taken = used.groupBy("_source").agg(F.sum("_n").alias("taken"), F.max("_use").alias("use"))
    base = spark.createDataFrame([(s, w, r, int(available.get(s, 0))) for s, (w, r) in goal.items()], "source string, target_share double, max_repeats int, available bigint")
    whole = taken.agg(F.sum("taken").alias("whole"))
    shares = base.join(taken.withColumnRenamed("_source", "source"), "source", "left").join(F.broadcast(whole), how="left")
    n = F.coalesce("taken", F.lit(0))
    return selection, shares.select("source", "target_share", "max_repeats", "available", n.alias("taken"), F.when(F.col("whole") > 0, n / F.col("whole")).otherwise(0.0).alias("reached_share"), F.coalesce(F.col("use") + 1, F.lit(0)).cast("int").alias("most_uses"))
