"""Exact spans that occur in more than one record, found from fixed-block anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.runtime import cut

#: Letters hashed at once inside a task, and letters of a segment of a long record.
CHUNK, SEGMENT = 1 << 20, 1 << 16
#: Bits of a filter of anchors at most (32 MB).
FILTER_BITS = 1 << 28
SEED = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(letters: np.ndarray, width: int, seed: int) -> np.ndarray:
    """64-bit hash of each window of ``width`` letters (code points), as int64; windows of powers of two are joined pairwise."""
    n = len(letters) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    power, size, done, out = _mix(letters.astype(np.uint64) + np.uint64(seed)), 1, 0, None
    while True:
        if width & size:
            part = power[done : done + n]
            out = part.copy() if out is None else _mix(out * np.uint64(seed | 1) + part)
            done += size
        if size * 2 > width:
            return out.view(np.int64)
        power = _mix(power[:-size] * np.uint64(seed | 1) + (power[size:] ^ np.uint64(size)))
        size *= 2


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(batches: Iterator[pa.RecordBatch], segment: int, over: int) -> Iterator[tuple[int, int, str]]:
    """(record, segment, letters) of every segment of every text, with the ``over`` letters behind it."""
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            for b, text in zip(*(c.slice(k, 64).to_pylist() for c in batch.columns[:2])):
                for n, at in enumerate(range(0, len(text), segment)):
                    yield b, n, text[at : at + segment + over]


def _runs(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows (.., .., letters, ...) in lists of about CHUNK letters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _joined(rows: list[tuple], segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all rows one after another; of each letter its row, its place in the segment (-1 behind the segment) and how many letters are left from it on."""
    texts = [_letters(r[2]) for r in rows]
    lens = np.array([len(t) for t in texts])
    row = np.repeat(np.arange(len(rows)), lens)
    place = np.arange(lens.sum()) - (np.cumsum(lens) - lens)[row]
    return np.concatenate(texts), row, np.where(place < segment, place, -1), lens[row] - place


def _bits(h: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    u = h.view(np.uint64)
    return (u & np.uint64(mask)).astype(np.int64), (u >> np.uint64(32) & np.uint64(mask)).astype(np.int64)


def _holds(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each hash; False is sure."""
    a, b = _bits(h, len(bitmap) * 8 - 1)
    return (bitmap[a >> 3] >> (a & 7).astype(np.uint8) & bitmap[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)


def _filters(anchors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two bits for each hash of ``anchors(h, lo, hi)`` in a bitmap of 16 bits a hash, at most ``FILTER_BITS`` altogether; one of all, one of those in several records. Tasks set the bits; the driver gets the bitmaps only."""
    n = anchors.count()
    size = min(FILTER_BITS, max(1 << 15, 1 << (16 * n - 1).bit_length() if n else 0))
    at = F.explode(F.array(F.col("h").bitwiseAND(size - 1) + 1, F.shiftrightunsigned("h", 32).bitwiseAND(size - 1) + 1))
    place = F.bitmap_bit_position("x")
    rows = anchors.select(at.alias("x"), (F.col("lo") != F.col("hi")).alias("several")).groupBy(F.bitmap_bucket_number("x").alias("k"))
    every, several = np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)
    for r in rows.agg(F.bitmap_construct_agg(place).alias("every"), F.bitmap_construct_agg(F.when(F.col("several"), place)).alias("several")).collect():
        for bitmap, bits in ((every, r.every), (several, r.several)):
            bitmap[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bits, np.uint8)
    return every, several


def _anchors(records: DataFrame, width: int, segment: int) -> DataFrame:
    """(h, b) of the blocks of ``width`` letters at multiples of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(_pieces(batches, segment, 0)):
            letters, row, place, left = _joined(rows, segment)
            h = window_hashes(letters, width, SEED)
            ok = np.flatnonzero((left[: len(h)] >= width) & (place[: len(h)] % width == 0))
            yield pa.RecordBatch.from_arrays([pa.array(h[ok]), pa.array(np.array([r[0] for r in rows], np.int64)[row[ok]])], names=["h", "b"])

    return records.mapInArrow(run, "h bigint, b bigint")


def _probes(records: DataFrame, width: int, segment: int, every, repeated) -> DataFrame:
    """(h, b, wi) of the rolling windows that may meet an anchor: any for windows between anchors, one of several records for those that are anchors themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_any, of_several = every.value, repeated.value
        for rows in _runs(_pieces(batches, segment, width - 1)):
            letters, row, place, left = _joined(rows, segment)
            h = window_hashes(letters, width, SEED)
            here = place[: len(h)]
            ok = np.flatnonzero((left[: len(h)] >= width) & (here >= 0))
            own = here[ok] % width == 0
            keep = np.zeros(len(ok), bool)
            keep[own] = _holds(of_several, h[ok[own]])
            keep[~own] = _holds(of_any, h[ok[~own]])
            ok = ok[keep]
            ids, at = np.array([r[0] for r in rows], np.int64), np.array([r[1] * segment for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[ok]), pa.array(ids[row[ok]]), pa.array((at[row[ok]] + here[ok]).astype(np.int32))], names=["h", "b", "wi"])

    return records.mapInArrow(run, "h bigint, b bigint, wi int")


def _segments(records: DataFrame, segment: int, over: int) -> DataFrame:
    """(b, seg, letters)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(_pieces(batches, segment, over)):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["b", "seg", "letters"])

    return records.mapInArrow(run, "b bigint, seg bigint, letters string")


def _extended(met: DataFrame, width: int, least: int, segment: int) -> DataFrame:
    """(letters, b, wi) of the windows of ``least`` letters around hits; input (b, seg, letters, places of hits in the record)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b, seg, text, hits = (c[k].as_py() for c in batch.columns)
                n = min(segment, len(text) - least + 1)
                if n <= 0:
                    continue
                change = np.zeros(n + 1, np.int32)
                hits = np.asarray(hits, np.int64) - seg * segment
                np.add.at(change, np.clip(hits - (least - width), 0, n), 1)
                np.add.at(change, np.clip(hits + 1, 0, n), -1)
                ok = np.flatnonzero(np.cumsum(change)[:n] > 0)
                for part in range(0, len(ok), 16_384):
                    at = ok[part : part + 16_384]
                    yield pa.RecordBatch.from_arrays([pa.array([text[p : p + least] for p in at.tolist()], pa.string()), pa.array(np.full(len(at), b, np.int64)), pa.array((at + seg * segment).astype(np.int32))], names=["letters", "b", "wi"])

    return met.mapInArrow(run, "letters string, b bigint, wi int")


def shared_spans(records: DataFrame, key: str, text: str, least: int = 50, segment: int = SEGMENT) -> DataFrame:
    """``(<key>, wi_from INT, wi_to INT)``: maximal runs of letters that lie in spans of ``least`` letters or more found in another record too.

    Anchors are the blocks of ``least // 2`` letters at every multiple of that width: any span of ``least`` letters holds a whole one.
    All rolling windows of all records probe them. A filter of two bits for each anchor, broadcast and never larger than ``FILTER_BITS``, lets only likely
    hits leave a task; it loses none, but thins out less when there are more anchors than it has room for. A hit counts if the anchor stands in another
    record (matched by 64 bits: a wrong match only costs time). Hits are extended on both sides to all spans of ``least`` letters around them; these meet by
    their letters, and those of two records or more join to maximal repeats. Copies aren't expanded into pairs: of each anchor and each
    span only the smallest and the largest key go on, so a text held by a third of all records costs one row a place.

    Texts are worked on in segments of ``segment`` letters with the letters behind, so no task holds what is found in a whole long record.
    Every code point is a letter, cases differ. Null, empty or shorter texts have no runs; neither has a record
    with a null key. Rows with the same key are one record (a repeat isn't another record); if their texts differ, runs of both come out. Whole texts are read.
    Other columns are ignored. An empty table gives no rows.
    """
    context = records.sparkSession.sparkContext
    width = max(1, least // 2)
    segment = -(-segment // width) * width
    kept = records.select(F.col(key).cast("bigint").alias("b"), F.col(text).alias("text")).where(F.col("b").isNotNull() & (F.length("text") >= least))
    both = [F.min("b").alias("lo"), F.max("b").alias("hi")]
    anchors = cut(_anchors(kept, width, segment).groupBy("h").agg(*both))
    filters = map(context.broadcast, _filters(anchors))
    hits = _probes(kept, width, segment, *filters).join(anchors, "h").where("lo <> b or hi <> b")
    seg = lambda at: F.floor(at / segment)
    near = F.explode(F.array_distinct(F.array(seg(F.greatest(F.lit(0), F.col("wi") - (least - width))), seg(F.col("wi")))))
    places = hits.select("b", near.alias("seg"), "wi").groupBy("b", "seg").agg(F.collect_set("wi").alias("places"))
    windows = cut(_extended(_segments(kept, segment, least - 1).join(places, ["b", "seg"]), width, least, segment))
    repeats = windows.groupBy("letters").agg(*both).where("lo <> hi").select("letters")
    found = windows.join(repeats, "letters").select("b", "wi").distinct().withColumn("seg", seg(F.col("wi")))
    w = Window.partitionBy("b", "seg").orderBy("wi")
    fresh = F.coalesce(F.col("wi") > F.lag("wi").over(w) + least, F.lit(True))
    parts = found.withColumn("run", F.sum(fresh.cast("int")).over(w)).groupBy("b", "seg", "run").agg(F.min("wi").alias("wi_from"), (F.max("wi") + least).alias("wi_to"))
    # Runs of a segment that reach into the next one's first run go on in it.
    v = Window.partitionBy("b").orderBy("wi_from")
    fresh = F.coalesce(F.col("wi_from") > F.lag("wi_to").over(v), F.lit(True))
    runs = parts.withColumn("run", F.sum(fresh.cast("int")).over(v)).groupBy("b", "run").agg(F.min("wi_from").alias("wi_from"), F.max("wi_to").alias("wi_to"))
    return runs.select(F.col("b").alias(key), "wi_from", "wi_to")


def shared_report(records: DataFrame, key: str, text: str, runs: DataFrame) -> DataFrame:
    """``(<key>, n_letters BIGINT, n_shared BIGINT, share DOUBLE)``: for each record how much of it is shared elsewhere."""
    each = runs.groupBy(key).agg(F.sum(F.col("wi_to") - F.col("wi_from")).alias("n"))
    whole = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.length(F.coalesce(text, F.lit("")))).cast("bigint").alias("n_letters"))
    n = F.coalesce("n", F.lit(0))
    return whole.join(each, key, "left").select(key, "n_letters", n.alias("n_shared"), F.when(F.col("n_letters") > 0, n / F.col("n_letters")).otherwise(0.0).alias("share"))
