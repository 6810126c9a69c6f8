"""References to records that don't exist at the time of the reference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.runtime import bare, cut, join_unique, partitions

#: Later than every time, in microseconds, and what stands for no time.
FAR, NEVER = 1 << 62, -(1 << 62)
#: Keys of a range of the dictionary, which its bitmaps cover.
RANGE = 1 << 15
#: Members of a bitmap up to which it is a sorted list of two bytes each rather than a bit for each key of the range.
SPARSE = RANGE // 16
#: Rows of one (key, period) that a single task may get; hotter ones are broadcast or salted.
HOT_ROWS = 100_000
#: Lives of a key in one period that are carried to its references; where there are more, references and lives are put in order.
LIVES = 256


class Bitmap:
    """A set of codes below ``RANGE``, as a sorted list where it is sparse, else as bits."""

    __slots__ = ("codes", "bits")

    def __init__(self, codes: np.ndarray):
        codes = np.unique(codes).astype(np.uint16)
        self.codes = self.bits = None
        if len(codes) <= SPARSE:
            self.codes = codes
        else:
            flags = np.zeros(RANGE, bool)
            flags[codes] = True
            self.bits = np.packbits(flags, bitorder="little")

    def decoded(self) -> np.ndarray:
        return self.codes if self.bits is None else np.flatnonzero(np.unpackbits(self.bits, bitorder="little")).astype(np.uint16)

    def holds(self, codes: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return (self.bits[codes >> 3] >> (codes & 7).astype(np.uint8) & 1).astype(bool)
        at = np.searchsorted(self.codes, codes)
        return (self.codes[np.minimum(at, len(self.codes) - 1)] == codes) if len(self.codes) else np.zeros(len(codes), bool)

    def and_not(self, other: Bitmap) -> np.ndarray:
        """Codes of this set that the other lacks."""
        if self.bits is not None and other.bits is not None:
            return np.flatnonzero(np.unpackbits(self.bits & ~other.bits, bitorder="little")).astype(np.uint16)
        codes = self.decoded()
        return codes[~other.holds(codes)]


def _merged(begin: np.ndarray, end: np.ndarray) -> list[dict]:
    """Lives of one key without overlaps, in order."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.r_[True, begin[1:] > reach[:-1]]
    return [{"a": int(a), "z": int(z)} for a, z in zip(begin[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(reach) - 1]])]


LEFT = "_key string, _at bigint, _sure boolean, _n bigint, _known boolean, _first bigint, _lives array<struct<a:bigint,z:bigint>>"
_ARROW = pa.schema([("_key", pa.string()), ("_at", pa.int64()), ("_sure", pa.bool_()), ("_n", pa.int64()), ("_known", pa.bool_()), ("_first", pa.int64()), ("_lives", pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())])))])


def _orphaned(keys: list[str], use: np.ndarray, live: np.ndarray, known: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What is left of one range of keys: references AND NOT lives, period by period.

    ``use``: code, begin and end of the period (begin ``NEVER``: no time), number of references; ``live``: code, begin, end of a life.
    """
    every = Bitmap(np.flatnonzero(known))
    for at in np.unique(use[:, 1]):
        asked = use[use[:, 1] == at]
        ref, end = Bitmap(asked[:, 0]), asked[0, 2]
        if at == NEVER:
            sure, unsure, near = ref.and_not(every), np.zeros(0, np.uint16), live[:0]
        else:
            near = live[(live[:, 1] < end) & (live[:, 2] > at)]
            some, whole = Bitmap(near[:, 0]), Bitmap(near[(near[:, 1] <= at) & (near[:, 2] >= end), 0])
            sure = ref.and_not(some)
            unsure = Bitmap(np.setdiff1d(ref.decoded(), sure, assume_unique=True)).and_not(whole)
        n = np.zeros(RANGE, np.int64)
        n[asked[:, 0]] = asked[:, 3]
        near = near[np.argsort(near[:, 0], kind="stable")]
        lo, hi = np.searchsorted(near[:, 0], unsure), np.searchsorted(near[:, 0], unsure, side="right")
        lives = [[]] * len(sure) + [_merged(np.maximum(near[a:z, 1], at), near[a:z, 2]) for a, z in zip(lo.tolist(), hi.tolist())]
        for codes in np.array_split(np.arange(len(lives)), len(lives) // 10_000 + 1):
            code = np.r_[sure, unsure][codes]
            yield pa.RecordBatch.from_arrays([
                pa.array([keys[c] for c in code.tolist()], pa.string()), pa.repeat(pa.scalar(int(at), pa.int64()), len(code)), pa.array(codes < len(sure)), pa.array(n[code]), pa.array(known[code]),
                pa.array(first[code], mask=first[code] == FAR), pa.array([lives[k] for k in codes.tolist()], _ARROW.field("_lives").type),
            ], schema=_ARROW)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes for the keys of a task, which come in order, and what is left of every ``RANGE`` of them. Rows (key, of parents or not, begin, end, n)."""
    keys: list[str] = []
    parts: list[np.ndarray] = []

    def left() -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(parts)
        parent = rows[:, 1] == 1
        lives = rows[parent]
        known, first = np.zeros(RANGE, bool), np.full(RANGE, FAR, np.int64)
        known[lives[:, 0]] = True
        np.minimum.at(first, lives[:, 0], lives[:, 2])
        yield from _orphaned(keys, rows[~parent][:, [0, 2, 3, 4]], lives[lives[:, 2] < lives[:, 3]][:, [0, 2, 3]], known, first)

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0)
        names = key.to_numpy(zero_copy_only=False)
        new = np.r_[not keys or names[0] != keys[-1], names[1:] != names[:-1]]
        code = len(keys) - 1 + np.cumsum(new)
        rows = np.column_stack([code, *(batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(1, 5))])
        keys.extend(names[new].tolist())
        while len(keys) > RANGE:
            here = rows[:, 0] < RANGE
            parts.append(rows[here])
            yield from left()
            keys, parts = keys[RANGE:], []
            rows = rows[~here]
            rows[:, 0] -= RANGE
        parts.append(rows)
    if parts:
        yield from left()


def orphan_references(refs: DataFrame, ref_id: str, ref_key: str, ref_time: str, parents: DataFrame, parent_key: str, added: str, deleted: str, period: str = "month", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of ``refs`` whose key has no live parent at ``ref_time``: ``(<ref_id>, key, period, reason)``.

    References, counted by key and period, and lives of parents are partitioned by ranges of keys once. A task numbers its keys in order; for each
    ``RANGE`` of them and period, one bitmap has the referenced keys, one the keys with a parent that lives through the whole period, one those with a parent at some
    time of it, as sorted lists where they are sparse. Referenced AND NOT any is surely orphaned; any AND NOT whole is decided by time, row by
    row, with the key's lives in that period. Only surviving bits are decoded, and joined with the references.

    ``reason``: ``missing`` if no parent ever has the key, ``late`` if the first is added after the reference, else ``deleted``.
    Keys of references are compared without white space at the ends; null and empty ones refer to nothing. A parent row with a
    null ``added`` never lives but makes its key known; a null ``deleted`` is still live; a null parent key is ignored. A reference without
    a time is an orphan only if its key is missing. Repeated parents change nothing, repeated references come out as often as they come.
    An empty parent table makes every reference missing. Other columns are ignored. A key may have any number of lives; they pass one task as three numbers each.
    """
    parts = partitions(refs.sparkSession)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = refs.select(F.col(ref_id).alias("_id"), bare(ref_key).alias("_key"), F.col(ref_time).cast("timestamp").alias("_t")).where("_key is not null").withColumn("_period", F.date_trunc(period, "_t"))
    used = rows.groupBy("_key", "_period").agg(F.count(F.lit(1)).alias("_n"))
    end = F.date_trunc(period, F.col("_period") + F.expr(f"interval 1 {period}"))
    used = used.select("_key", F.lit(0).alias("_parent"), F.coalesce(micros(F.col("_period")), F.lit(NEVER)).alias("_a"), F.coalesce(micros(end), F.lit(NEVER)).alias("_z"), "_n")
    never = F.lit(FAR)
    lives = parents.where(F.col(parent_key).isNotNull()).select(F.col(parent_key).cast("string").alias("_key"), F.coalesce(micros(F.col(added)), never).alias("_a"), F.coalesce(micros(F.col(deleted)), never).alias("_z"))
    lives = lives.groupBy("_key", "_a").agg(F.max("_z").alias("_z")).select("_key", F.lit(1).alias("_parent"), "_a", "_z", F.lit(0).cast("bigint").alias("_n"))
    events = cut(used.unionByName(lives))
    total = events.agg(F.sum("_n")).first()[0] or 0
    hot_rows = max(hot_rows, total // 2000)
    left = cut(events.repartitionByRange(parts, "_key").sortWithinPartitions("_key").mapInArrow(_ranges, LEFT))

    at = F.coalesce(micros(F.col("_period")), F.lit(NEVER))
    found = join_unique(rows.withColumn("_at", at), left, ["_key", "_at"], "_n", hot_rows)
    t = micros(F.col("_t"))
    known = F.size("_lives") <= LIVES
    dead = found.where(F.col("_sure") | (known & ~F.exists("_lives", lambda x: (x["a"] <= t) & (t < x["z"]))))
    columns = ["_id", "_key", "_t", "_period", "_first", "_known"]
    dead = dead.select(*columns)
    many = left.where(~F.col("_sure") & ~known)
    if not many.isEmpty():
        dead = dead.unionByName(_dead_at(found.where(~F.col("_sure") & ~known), many, hot_rows).select(*columns))
    reason = F.when(~F.col("_known"), "missing").when(F.col("_first") > t, "late").otherwise("deleted")
    return dead.select(F.col("_id").alias(ref_id), F.col("_key").alias("key"), F.col("_period").alias("period"), reason.alias("reason"))


def _dead_at(rows: DataFrame, many: DataFrame, hot_rows: int) -> DataFrame:
    """Of rows whose key has many lives in the period: those outside every one.

    Lives and references form one stream of events by key and period; the latest end seen so far decides.
    A hot key and period is dealt to several groups, each of which gets all its lives.
    """
    salts = F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int")
    lives = many.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("_key", "_at", "_salt", F.explode("_lives").alias("_x"))
    lives = lives.select("_key", "_at", "_salt", F.col("_x.a").alias("_when"), F.col("_x.z").alias("_until"), F.lit(False).alias("_asked"))
    asked = rows.drop("_lives").withColumn("_salt", F.pmod(F.xxhash64("_id"), salts).cast("int")).withColumn("_when", F.unix_micros("_t")).withColumn("_asked", F.lit(True))
    w = Window.partitionBy("_key", "_at", "_salt").orderBy("_when", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    seen = asked.unionByName(lives, allowMissingColumns=True).withColumn("_last", F.max("_until").over(w))
    return seen.where("_asked and (_last is null or _last <= _when)")


def orphan_report(orphans: DataFrame, table: str) -> DataFrame:
    """Orphans counted by table, period and reason."""
    return orphans.groupBy("period", "reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit(table).alias("table_name"), "period", "reason", "n")
