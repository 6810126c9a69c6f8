"""Permutation nulls of the smoothed maxima, thresholds, false positives."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.operators.filters import grid_rows, relative_gini
from strandwise.operators.ordering import ordered
from strandwise.operators.smoothing import gini_counts
from strandwise.runtime import PIECE, Vector, cut, filed, only, partitions

#: Repetitions computed in one pass over the text, and permuted scores that a pass holds in a file; fewer repetitions of more blocks.
REPS_AT_ONCE, SCORES_AT_ONCE = 128, 1 << 27
#: Places worked on at once, and at most in a task.
STEP, TASK = 1 << 10, 1 << 19


class JavaRandom:
    """The documented 48-bit linear congruential generator of java.util.Random, for shuffles that others can repeat."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.state >> (48 - n)

    def below(self, bound: int) -> int:
        r = self.bits(31)
        if bound & (bound - 1) == 0:
            return (bound * r) >> 31
        u = r
        while u - (r := u % bound) + bound - 1 > 0x7FFFFFFF:
            u = self.bits(31)
        return r


def java_permutations(reps: int, n: int, seed: int) -> list[list[int]]:
    """``reps`` shuffles of 0 .. n - 1 from one generator, from the end as java.util.Collections.shuffle does it."""
    random, out = JavaRandom(seed), []
    for _ in range(reps):
        row = list(range(n))
        for k in range(n, 1, -1):
            j = random.below(k)
            row[k - 1], row[j] = row[j], row[k - 1]
        out.append(row)
    return out


def permutations(blocks: DataFrame, reps: int, seed: int, compatible: bool = False) -> DataFrame:
    """``(rep INT, b BIGINT, score DOUBLE)``: in every repetition the scores dealt anew to the blocks.

    Each repetition ranks the blocks by the md5 of ``seed:rep:b``, which others can compute as well, and gives rank p the score of block p; one range sort for all.
    ``compatible`` repeats java.util shuffles of small block tables instead (refused above 100,000 blocks: they are sequential).
    """
    spark = blocks.sparkSession
    base = blocks.select("b", "score")
    if compatible:
        n = base.count()
        if n > 100_000:
            raise ValueError("compatible shuffles are sequential; use hashed ones for more than 100,000 blocks")
        dealt = spark.createDataFrame([(rep, b, to) for rep, row in enumerate(java_permutations(reps, n, seed)) for b, to in enumerate(row)], "rep int, b bigint, to bigint")
        return dealt.join(base, "b").select("rep", F.col("to").alias("b"), "score")
    each = base.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    hashed = ordered(each.select("rep", "b", F.md5(F.concat_ws(":", F.lit(seed), "rep", "b")).alias("h")), ["rep", "h", "b"], keep=["rep", "b"])
    first = hashed.groupBy("rep").agg(F.min("pos").alias("base"))
    return hashed.join(F.broadcast(first), "rep").select("rep", F.col("b").alias("to"), (F.col("pos") - F.col("base")).alias("b")).join(base, "b").select("rep", F.col("to").alias("b"), "score")


def _rows(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(matrix.ravel()), type=pa.list_(pa.field("element", pa.float32())))


def _means(values: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """Means of ``width`` rows from each of ``begin`` on."""
    sums = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    return np.round((sums[begin + width] - sums[begin]) / width, 9).astype(np.float32)


def _most(values: np.ndarray, ok: np.ndarray) -> np.ndarray:
    return values.max(axis=0) if ok.all() else values[ok].max(axis=0) if ok.any() else np.full(values.shape[1], -np.inf, np.float32)


def _maxima(rank: Vector, block: Vector, ginis: dict[int, tuple[Vector, float | None]], matrix: Vector, filters: list[dict], many: int, rows: int | None) -> DataFrame:
    """``(f, kind, m ARRAY<FLOAT>)``: of every task and filter the largest means of ``many`` repetitions that aren't masked.

    A step takes places in a row: of each its rank, the blocks in the window around it, and their permuted scores, a row of ``matrix`` each. Windows
    have what the narrower ones have and more, so the sums go on from one half window to the next. Nothing shuffles.
    """
    spark, n = SparkSession.active(), rank.n
    lengths = {half: dict.fromkeys(x["spatial_length"] for x in filters if x["half_window"] == half and 1 < x["spatial_length"] <= n) for half in sorted(ginis)}
    longest = max([1, *(length for of in lengths.values() for length in of)])
    step = rows or max(STEP, 16 * longest)
    low_gini = {x["f"]: tuple(relative_gini(ginis[x["half_window"]][1], x[c]) for c in ("min_gini", "min_spatial_gini")) for x in filters}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, blocks, scores, known = rank.load(), block.load(), matrix.load().reshape(-1, many), {half: v.load() for half, (v, _) in ginis.items() if n > 2 * half}
        most: dict[tuple, np.ndarray] = {}

        def told(x: dict, kind: str, means: np.ndarray, ok: np.ndarray) -> None:
            new = _most(means, ok)
            most[x["f"], kind] = np.maximum(most.get((x["f"], kind), new), new)

        for low in (k * step for batch in batches for k in batch.column(0).to_pylist()):
            high = min(n, low + step)
            begin = max(0, min(low, n - longest))
            own = slice(low - begin, high - begin)
            i = ranks[begin : min(n, high + longest - 1)].astype(np.int64)
            sums, one, last, done = np.zeros((len(i), many)), np.empty((len(i), many)), None, -1
            for half in lengths:
                centre = np.clip(i, half, max(half, n - 1 - half))
                if last is None or not np.array_equal(centre, last):
                    sums[:], done = 0, -1
                near = [o for o in range(-half, half + 1) if abs(o) > done]
                for column in blocks[np.minimum(centre[:, None] + np.array(near), n - 1)].T:
                    np.take(scores, column, axis=0, out=one, mode="clip")
                    sums += one
                last, done = centre, half
                mean = np.round(sums / (2 * half + 1), 9).astype(np.float32)
                gini = known[half][i][:, None] if half in known else np.full((len(i), 1), np.nan, np.float32)
                wide = {length: [_means(v, np.minimum(np.arange(low, high), n - length) - begin, length) for v in (mean, gini)] for length in lengths[half]}
                for x in (x for x in filters if x["half_window"] == half):
                    means, wide_gini = wide.get(x["spatial_length"], (None, None))
                    ok = np.full(high - low, half in known)
                    for values, least in zip((gini[own], wide_gini), low_gini[x["f"]]):
                        if values is not None and least is not None:
                            ok &= ~(values[:, 0].astype(np.float64) < least)
                    told(x, "max_windowed", mean[own], ok)
                    if means is not None:
                        told(x, "max_spatial", means, ok)
        if most:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in most], pa.int32()), pa.array([kind for _, kind in most]), _rows(np.stack(list(most.values())))], names=["f", "kind", "m"])

    steps = -(-n // step)
    tasks = max(1, min(steps, max(partitions(spark), -(-n // TASK))))
    return spark.range(0, steps, 1, tasks).mapInArrow(run, "f int, kind string, m array<float>")


def _gini(block: Vector, half: int) -> tuple[Vector, float | None]:
    """Gini impurity of blocks around each rank, as ``smooth`` has it, and the median; the text has a full window. Pieces are made from the file of blocks, without a shuffle."""
    spark, n, width = SparkSession.active(), block.n, 2 * half + 1
    out = Vector(f"{block.uri}/gini{half}", n, "float32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = block.load()
        for k in (k for batch in batches for k in batch.column(0).to_pylist()):
            centre = np.clip(np.arange(k * PIECE, min(n, (k + 1) * PIECE)), half, n - 1 - half)
            a, z = int(centre[0]), int(centre[-1])
            squares = gini_counts(np.asarray(blocks[a - half : z + half + 1]), half, z - a + 1 + half, half)[centre - a]
            piece = (1 - squares / width**2).astype(np.float32)
            out.put(k, piece)
            values, often = np.unique(piece, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(often)], names=["gini", "n"])

    pieces = -(-n // PIECE)
    found = cut(spark.range(0, pieces, 1, min(pieces, 4 * partitions(spark))).mapInArrow(run, "gini float, n bigint"))
    return out, found.groupBy("gini").agg(F.sum("n").alias("n")).agg(F.expr("percentile(gini, 0.5, n)")).first()[0]


def permutation_distribution(suffixes: DataFrame, blocks: DataFrame, grid: DataFrame, perms: DataFrame, reps: int, rows: int | None = None) -> DataFrame:
    """``(f INT, rep INT, max_windowed FLOAT, max_spatial FLOAT)``: per parameter row and repetition the largest smoothed values of permuted scores.

    Rows masked by either Gini test count for neither maximum; all masked, or a text shorter than a window, gives -infinity; ``max_spatial`` is null where
    spatial smoothing isn't active. Gini values are computed once for each half window. Ranks, blocks, Gini values and permuted scores lie in files that tasks
    map into memory: windowed means of permuted scores are never written, and only maxima leave the tasks. Repetitions go through the text in groups.
    """
    filters = grid_rows(grid)
    if len(filters) > 31:
        raise ValueError("a grid has at most 31 rows; larger ones are worked on in parts")
    return only(suffixes.sparkSession, lambda: _distribution(suffixes, blocks, filters, perms, reps, rows))


def _distribution(suffixes: DataFrame, blocks: DataFrame, filters: list[dict], perms: DataFrame, reps: int, rows: int | None) -> DataFrame:
    spark, n, n_blocks = suffixes.sparkSession, suffixes.count(), blocks.count()
    rank = filed(suffixes, "s", "i", n, "uint32" if n < 1 << 32 else "int64")
    block = filed(suffixes, "i", "b", n, "int32" if n_blocks < 1 << 31 else "int64")
    ginis = {half: _gini(block, half) if n > 2 * half else (block, None) for half in dict.fromkeys(x["half_window"] for x in filters)}
    found, at_once = None, max(1, min(REPS_AT_ONCE, SCORES_AT_ONCE // max(1, n_blocks)))
    for first in range(0, reps, at_once):
        many = min(at_once, reps - first)

        def maxima(first: int = first, many: int = many) -> DataFrame:
            mine = perms.where((F.col("rep") >= first) & (F.col("rep") < first + many))
            matrix = filed(mine, F.col("b") * many + F.col("rep") - first, "score", n_blocks * many, "float64")
            part = _maxima(rank, block, ginis, matrix, filters, many, rows)
            return part.select("f", "kind", F.posexplode("m").alias("rep", "max")).groupBy("f", "kind", "rep").agg(F.max("max").alias("max")).withColumn("rep", F.col("rep") + first)

        part = only(spark, maxima)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("f", "rep").pivot("kind", ["max_windowed", "max_spatial"]).agg(F.max("max"))


def thresholds(permdist: DataFrame, n_sigma: float = 4.0) -> DataFrame:
    """``(f, theta FLOAT, spatial_theta FLOAT)``: mean + n_sigma * standard deviation (n - 1) of the maxima. Where spatial maxima exist only ``spatial_theta`` is set."""
    level = lambda c: (F.avg(c) + n_sigma * F.stddev_samp(c)).cast("float")
    each = permdist.groupBy("f").agg(level("max_windowed").alias("t"), level("max_spatial").alias("spatial_theta"), F.count("max_spatial").alias("n"))
    return each.select("f", F.when(F.col("n") == 0, F.col("t")).alias("theta"), "spatial_theta")


def false_positives(permdist: DataFrame, limits: DataFrame) -> DataFrame:
    """``(fp BIGINT, n BIGINT)``: repetitions in which any parameter row reaches its threshold."""
    hit = (F.coalesce(F.col("max_windowed") >= F.col("theta"), F.lit(False))) | (F.coalesce(F.col("max_spatial") >= F.col("spatial_theta"), F.lit(False)))
    each = permdist.join(F.broadcast(limits), "f").groupBy("rep").agg(F.max(hit.cast("int")).alias("hit"))
    return each.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("fp"), F.count(F.lit(1)).alias("n"))


def binomial_interval(hits: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Clopper-Pearson interval, by bisection on the binomial distribution."""

    def at_most(k: int, p: float) -> float:
        if p <= 0 or p >= 1:
            return 1.0 if p <= 0 or k >= n else 0.0
        return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))

    def root(f) -> float:
        low, high = 0.0, 1.0
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) else (low, mid)
        return (low + high) / 2

    tail = (1 - level) / 2
    lower = 0.0 if hits == 0 else root(lambda p: 1 - at_most(hits - 1, p) < tail)
    upper = 1.0 if hits == n else root(lambda p: at_most(hits, p) > tail)
    return lower, upper


def false_positive_rate(permdist: DataFrame, limits: DataFrame, level: float = 0.95) -> DataFrame:
    """``(fp, n, mean, lower, upper)`` with an exact binomial interval. The permutations should come from another seed than those of the thresholds."""
    spark: SparkSession = permdist.sparkSession
    fp, n = false_positives(permdist, limits).first()
    lower, upper = binomial_interval(fp, n, level) if n else (0.0, 1.0)
    return spark.createDataFrame([(fp, n, fp / n if n else None, lower, upper)], "fp bigint, n bigint, mean double, lower double, upper double")


def estimate_false_positive_rate(suffixes: DataFrame, blocks: DataFrame, grid: DataFrame, limits: DataFrame, reps: int, seed: int, level: float = 0.95, compatible: bool = False) -> tuple[DataFrame, DataFrame]:
    """(``false_positive_rate`` of thresholds ``limits`` under new permutations, their distribution). ``seed`` should differ from that of the thresholds' permutations."""
    perms = only(blocks.sparkSession, lambda: permutations(blocks, reps, seed, compatible))
    null = cut(permutation_distribution(suffixes, blocks, grid, perms, reps))
    return false_positive_rate(null, limits, level), null


def zrank(peaks: DataFrame, permdist: DataFrame, grid: DataFrame, best_only: bool = True) -> DataFrame:
    """``(kmer, half_window, min_gini, zmax)``: the largest (windowed - mean) / sd of each k-mer against its parameter row without spatial smoothing; ``best_only`` keeps each k-mer's best row."""
    null = permdist.groupBy("f").agg(F.avg("max_windowed").alias("mean"), F.stddev_samp("max_windowed").alias("sd"))
    return _zrank(peaks, null.join(grid.where("spatial_length < 2"), "f"), best_only)


def zrank_selection(peaks: DataFrame, null: DataFrame, best_only: bool = True) -> DataFrame:
    """``zrank`` of the tables of a selection run: peaks and maxima (``halfWindow, minGini, .., max``) without spatial smoothing."""
    named = [F.col("halfWindow").alias("half_window"), F.col("minGini").alias("min_gini")]
    return _zrank(peaks.select("kmer", *named, "windowed"), null.groupBy(*named).agg(F.avg("max").alias("mean"), F.stddev_samp("max").alias("sd")), best_only)


def _zrank(peaks: DataFrame, level: DataFrame, best_only: bool) -> DataFrame:
    level = F.broadcast(level.select("half_window", "min_gini", "mean", "sd"))  # a grid of parameters
    # Maxima that are all the same have no deviation: infinite above and below them, not a number at them (the greatest in order).
    above = F.col("windowed") - F.col("mean")
    flat = F.when(above == 0, F.lit(float("nan"))).otherwise(F.signum(above) * F.lit(float("inf")))
    z = peaks.join(level, ["half_window", "min_gini"]).groupBy("kmer", "half_window", "min_gini").agg(F.max(F.when(F.col("sd") == 0, flat).otherwise(above / F.nullif("sd", F.lit(0.0)))).alias("zmax"))
    if not best_only:
        return z
    best = F.max_by(F.struct("half_window", "min_gini", "zmax"), F.struct("zmax", -F.col("half_window"), -F.col("min_gini"))).alias("_b")
    return z.groupBy("kmer").agg(best).select("kmer", "_b.half_window", "_b.min_gini", "_b.zmax")
