"""Peaks of the smoothed scores, their k-mers, and the text intervals they merge to."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.operators.filters import grid_rows, median_gini, relative_gini
from strandwise.operators.smoothing import ROWS, haloed, smooth, smooth_spatial
from strandwise.operators.text import AHEAD, text_at
from strandwise.runtime import cut

COLUMNS = ["i", "s", "kmer", "khat", "block", "wi", "gini", "spatialGini", "score", "windowed", "spatialWindowed", "kmax", "halfWindow", "minGini", "theta", "spatialLength", "minSpatialGini", "spatialTheta"]


def with_neighbours(smoothed: DataFrame, rows: int = ROWS) -> DataFrame:
    """Adds ``before`` and ``after``: windowed at places s - 1 and s + 1 (its own at the ends), in chunks of places."""
    w = Window.partitionBy("_c").orderBy("s")
    near = haloed(smoothed, "s", 1, 1, rows)
    both = near.withColumn("before", F.coalesce(F.lag("windowed").over(w), "windowed")).withColumn("after", F.coalesce(F.lead("windowed").over(w), "windowed"))
    return both.where(F.floor(F.col("s") / rows) == F.col("_c")).drop("_c")


def passing(theta: float | None, min_gini: float | None, spatial_theta: float | None, min_spatial_gini: float | None) -> Column:
    """Rows at or above the thresholds. A null theta excludes nothing; spatial thresholds apply only with a spatial theta, and then besides the Gini threshold."""
    ok = F.lit(True) if theta is None else F.col("windowed") >= F.lit(theta).cast("float")
    ok = ok if min_gini is None else ok & (F.col("gini") >= F.lit(min_gini))
    if spatial_theta is not None:
        ok = ok & (F.col("spatial_windowed") >= F.lit(spatial_theta).cast("float"))
        ok = ok if min_spatial_gini is None else ok & (F.col("spatial_gini") >= F.lit(min_spatial_gini))
    return ok


def stages(suffixes: DataFrame, blocks: DataFrame, grid: DataFrame, limits: DataFrame | None = None) -> list[tuple[dict, DataFrame, float | None]]:
    """(parameters with thresholds, smoothed rows, median Gini) for each parameter row; one smoothing for each distinct window."""
    n = suffixes.count()
    scored = suffixes.join(blocks.select("b", "score"), "b")
    found = {r.f: r for r in limits.collect()} if limits is not None else {}
    by_half: dict[int, tuple[DataFrame, float | None]] = {}
    out = []
    for x in grid_rows(grid):
        half = x["half_window"]
        if half not in by_half:
            base = cut(smooth(scored, half, n))
            by_half[half] = base, median_gini(base)
        base, median = by_half[half]
        limit = found.get(x["f"])
        x = x | {"theta": limit.theta if limit else x.get("theta"), "spatial_theta": limit.spatial_theta if limit else x.get("spatial_theta"), "n": n}
        out.append((x, smooth_spatial(base, x["spatial_length"], n), median))
    return out


def call_peaks(smoothed: DataFrame, x: dict, median: float | None, peakify: bool = True) -> DataFrame:
    """Rows that pass; with ``peakify`` only those whose windowed value isn't exceeded at the place before or behind."""
    rows = with_neighbours(smoothed) if peakify else smoothed
    kept = rows.where(passing(x["theta"], relative_gini(median, x["min_gini"]), x["spatial_theta"], relative_gini(median, x["min_spatial_gini"])))
    return kept.where("before <= windowed and after <= windowed").drop("before", "after") if peakify else kept


def kmer_lengths(rows: DataFrame, suffixes: DataFrame, blocks: DataFrame, half: int, kmax: int) -> DataFrame:
    """Adds ``khat FLOAT``: the mean length, at most ``kmax``, of the prefix that a suffix has in common with the others in its window.

    The sum runs over the window's ranks but its own and is divided by 2 * half also where the text's ends cut the window. Null if half is 0.
    """
    near = rows.select("i").distinct().withColumn("j", F.explode(F.sequence(F.col("i") - half, F.col("i") + half)))
    pairs = near.join(suffixes.select(F.col("i").alias("j"), F.col("s")), "j")
    texts = cut(text_at(pairs, blocks, "s", kmax, "t"))
    own = texts.where("i = j").select("i", F.col("t").alias("own"))
    # Letters until the first difference: agreement of ever longer prefixes, summed.
    common = F.aggregate(F.sequence(F.lit(1), F.lit(kmax)), F.lit(0), lambda n, k: F.when((n == k - 1) & (F.length("t") >= k) & (F.length("own") >= k) & (F.col("t").substr(k, F.lit(1)) == F.col("own").substr(k, F.lit(1))), k).otherwise(n))
    each = texts.where("i <> j").join(own, "i").groupBy("i").agg(F.sum(common).alias("_sum"))
    khat = (F.coalesce("_sum", F.lit(0)) / (2 * half) if half else F.lit(None)).cast("float")
    return rows.join(each, "i", "left").withColumn("khat", khat).drop("_sum")


def described(rows: DataFrame, x: dict, suffixes: DataFrame, blocks: DataFrame, kmax: int) -> DataFrame:
    """Rows ``(i, s, b, windowed, gini, spatial_windowed, spatial_gini)`` as the table of peaks; the k-mer has round(khat) letters, halves up, and may run into the next block."""
    long = kmer_lengths(rows, suffixes, blocks, x["half_window"], kmax)
    named = text_at(long, blocks, "s", F.coalesce(F.round("khat"), F.lit(0)).cast("int"), "kmer", short=kmax <= AHEAD)
    return _table(named, x, blocks, kmax)


def _table(named: DataFrame, x: dict, blocks: DataFrame, kmax: int) -> DataFrame:
    told = named.join(blocks.select("b", F.col("seq_id").alias("block"), "score", "offset"), "b")
    lit = lambda v, kind: F.lit(v).cast(kind)
    return told.select(
        "i", "s", "kmer", "khat", "block", (F.col("s") - F.col("offset")).cast("int").alias("wi"), "gini", F.col("spatial_gini").alias("spatialGini"), F.col("score").cast("float").alias("score"), "windowed", F.col("spatial_windowed").alias("spatialWindowed"),
        F.lit(kmax).alias("kmax"), lit(x["half_window"], "int").alias("halfWindow"), lit(x["min_gini"], "double").alias("minGini"), lit(x["theta"], "float").alias("theta"), lit(x["spatial_length"], "int").alias("spatialLength"), lit(x["min_spatial_gini"], "double").alias("minSpatialGini"), lit(x["spatial_theta"], "float").alias("spatialTheta"),
    )


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kmer_peaks(suffixes: DataFrame, blocks: DataFrame, grid: DataFrame, limits: DataFrame | None, peakify: bool = True, kmax: int = 12) -> DataFrame:
    """The table of peaks of every parameter row."""
    return _united([described(cut(call_peaks(rows, x, median, peakify)), x, suffixes, blocks, kmax) for x, rows, median in stages(suffixes, blocks, grid, limits)])


def block_info(suffixes: DataFrame, blocks: DataFrame, names: DataFrame, grid: DataFrame, limits: DataFrame | None = None, kmax: int = 12) -> DataFrame:
    """Every place of the blocks ``names(seq_id)``, closing letter included, as a table of peaks."""
    wanted = blocks.join(names.select("seq_id").distinct(), "seq_id", "left_semi").select("b")
    return _united([described(cut(rows.join(wanted, "b")), x, suffixes, blocks, kmax) for x, rows, _ in stages(suffixes, blocks, grid, limits)])


def sub_peaks(peaks: DataFrame, smoothed: DataFrame, x: dict, rows: int = ROWS) -> DataFrame:
    """Places below the spatial windows of peaks whose own windowed value reaches theta.

    Without spatial smoothing the peaks themselves. A place is left out if the one before it lies in no peak's window and yet reaches theta:
    a run that began outside doesn't begin anew. The first place of the text has none before it.
    """
    if x["spatial_length"] < 2:
        return peaks.select("i", "s", "b", "windowed", "gini", "spatial_windowed", "spatial_gini")
    covered = peaks.select(F.explode(F.sequence("s", F.least(F.col("s") + x["spatial_length"], F.lit(x["n"])) - 1)).alias("s")).distinct()
    level = F.lit(x["spatial_theta"] if x["theta"] is None else x["theta"]).cast("float")
    before = covered.select((F.col("s") + 1).alias("s"), F.lit(True).alias("_in"))
    last = smoothed.select((F.col("s") + 1).alias("s"), F.col("windowed").alias("_last"))
    kept = covered.join(smoothed, "s").where(F.col("windowed") >= level).join(before, "s", "left").join(last, "s", "left")
    return kept.where((F.col("_in").isNotNull()) | F.col("_last").isNull() | (F.col("_last") < level)).select("i", "s", "b", "windowed", "gini", "spatial_windowed", "spatial_gini")


def islands(rows: DataFrame, at: str, group: list[str] = (), size: int = ROWS) -> DataFrame:
    """Adds ``island``: the first of each run of consecutive distinct values of ``at``.

    A run's first value is the last value up to here whose predecessor is missing; found within buckets of values and carried from bucket to bucket. Buckets have
    at least as many values as there are buckets.
    """
    keys = [*group]
    size = max(size, math.isqrt(max(0, rows.agg(F.max(at)).first()[0] or 0)))
    begins = rows.join(rows.select(*keys, (F.col(at) + 1).alias(at), F.lit(True).alias("_has")).distinct(), [*keys, at], "left").withColumn("_begin", F.when(F.col("_has").isNull(), F.col(at))).drop("_has").withColumn("_k", F.floor(F.col(at) / size))
    tops = begins.groupBy(*keys, "_k").agg(F.max("_begin").alias("_top"))
    carry = tops.select(*keys, "_k", F.last("_top", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    inside = F.last("_begin", ignorenulls=True).over(Window.partitionBy(*keys, "_k").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return begins.withColumn("_inside", inside).join(carry.withColumn("_carry", F.col("_carry")), [*keys, "_k"]).withColumn("island", F.coalesce("_inside", "_carry")).drop("_begin", "_inside", "_carry", "_k")


def merged_intervals(rows: DataFrame, n: int) -> DataFrame:
    """``(s_start, s_end)``: runs of consecutive places; each ends where its farthest k-mer ends, at the text's end at the latest. ``rows(s, khat)``."""
    end = F.col("s") + F.coalesce(F.round("khat"), F.lit(0)).cast("bigint")
    return islands(rows, "s").groupBy("island").agg(F.least(F.max(end), F.lit(n)).alias("s_end")).select(F.col("island").alias("s_start"), "s_end")


def merged_sub_peaks(suffixes: DataFrame, blocks: DataFrame, grid: DataFrame, limits: DataFrame | None, peakify: bool = True, kmax: int = 12) -> DataFrame:
    """Merged intervals of the sub-peaks of every parameter row, as a table of peaks: values of the interval's first place, ``kmer`` its whole text.

    Intervals may be of any length.
    """
    parts = []
    for x, rows, median in stages(suffixes, blocks, grid, limits):
        inner = cut(sub_peaks(call_peaks(rows, x, median, peakify), rows, x))
        long = cut(kmer_lengths(inner, suffixes, blocks, x["half_window"], kmax))
        spans = merged_intervals(long, x["n"])
        joined = text_at(spans.withColumnRenamed("s_start", "s"), blocks, "s", F.col("s_end") - F.col("s"), "kmer").select("s", "kmer")
        parts.append(_table(long.join(joined, "s"), x, blocks, kmax))
    return _united(parts)


def merged_kmers(merged: DataFrame) -> DataFrame:
    """Distinct interval texts, sorted."""
    return merged.select("kmer").distinct().orderBy("kmer")
