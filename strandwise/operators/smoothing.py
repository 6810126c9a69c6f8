"""Smoothing over suffix ranks and over text places, in chunks with halos."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a chunk without its halo; the unit of work of a task.
ROWS = 1 << 16
#: Windows that are laid out at once.
STEP = 1 << 12


def haloed(df: DataFrame, at: str, before: int, after: int, rows: int = ROWS) -> DataFrame:
    """Each row in its chunk ``_c`` of ``at`` and in those whose halo (``before`` rows in front, ``after`` behind) it lies in."""
    low = F.greatest(F.lit(0), F.floor((F.col(at) - after) / rows))
    return df.withColumn("_c", F.explode(F.sequence(low, F.floor((F.col(at) + before) / rows))))


def _chunked(df: DataFrame, at: str, before: int, after: int, kernel: Callable, schema: str, rows: int = ROWS) -> DataFrame:
    """Run ``kernel(sorted columns, first place, first and last place wanted)`` on every chunk with its halo; it gets at most rows + before + after rows."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        c = key[0].as_py()
        table = table.sort_by(at)
        places = table.column(at).to_numpy()
        low, high = np.searchsorted(places, [c * rows, (c + 1) * rows])
        if low == high:
            return empty
        return kernel(table, int(low), int(high))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    return haloed(df, at, before, after, rows).groupBy("_c").applyInArrow(run, schema)


def gini_counts(b: np.ndarray, low: int, high: int, half: int) -> np.ndarray:
    """Sum of squared block counts in the windows around rows low..high-1, of 2 * half + 1 rows each; all rows they need are in ``b``.

    A pair of rows of one block at distance d <= 2 * half lies in the windows centred from its later row - half to its earlier row + half.
    """
    n = len(b)
    order = np.lexsort((np.arange(n), b))
    blocks, change = b[order], np.zeros(n + 1, np.int64)
    alive = np.arange(n)
    lag = 1
    while len(alive):
        alive = alive[alive + lag < n]
        early, late = order[alive], order[np.minimum(alive + lag, n - 1)]
        ok = (blocks[alive] == blocks[np.minimum(alive + lag, n - 1)]) & (late - early <= 2 * half)
        alive, early, late = alive[ok], early[ok], late[ok]
        change += np.bincount(np.maximum(late - half, 0), minlength=n + 1)[: n + 1]
        change -= np.bincount(np.minimum(early + half + 1, n), minlength=n + 1)[: n + 1]
        lag += 1
    return (2 * half + 1) + 2 * np.cumsum(change[:n])[low:high]


def smooth(scored: DataFrame, half: int, n: int, rows: int = ROWS) -> DataFrame:
    """``scored(i, s, b, score)`` with ``windowed FLOAT, gini FLOAT``: mean score and Gini impurity of blocks over ranks i - half .. i + half.

    The first and last ``half`` ranks take the value of the nearest full window. ``n`` is the number of ranks; a text shorter than a window has no value.
    """
    width = 2 * half + 1

    def kernel(table: pa.Table, low: int, high: int) -> pa.Table:
        i = table.column("i").to_numpy()
        sums = np.concatenate([[0.0], np.cumsum(table.column("score").to_numpy())])
        centre = np.clip(i[low:high], half, n - 1 - half) - i[0]
        mean = np.round((sums[centre + half + 1] - sums[centre - half]) / width, 9)
        a, z = int(centre.min()), int(centre.max()) + 1
        squares = gini_counts(table.column("b").to_numpy(), a, z, half)[centre - a]
        part = table.slice(low, high - low).select(["i", "s", "b"])
        return part.append_column("windowed", pa.array(mean.astype(np.float32))).append_column("gini", pa.array((1 - squares / width**2).astype(np.float32)))

    if n < width:
        return scored.select("i", "s", "b", F.lit(None).cast("float").alias("windowed"), F.lit(None).cast("float").alias("gini"))
    # A row at an end needs the nearest full window, which may begin 2 * half rows off.
    return _chunked(scored.select("i", "s", "b", "score"), "i", 2 * half, 2 * half, kernel, "i bigint, s bigint, b bigint, windowed float, gini float", rows)


def smooth_spatial(smoothed: DataFrame, length: int, n: int, rows: int = ROWS) -> DataFrame:
    """Adds ``spatial_windowed, spatial_gini``: means of windowed and gini over places s .. s + length - 1. The last places take the last full window.
    Not active (null) for a length under 2."""
    if length < 2 or n < length:
        return smoothed.withColumn("spatial_windowed", F.lit(None).cast("float")).withColumn("spatial_gini", F.lit(None).cast("float"))

    def kernel(table: pa.Table, low: int, high: int) -> pa.Table:
        s = table.column("s").to_numpy()
        begin = np.minimum(s[low:high], n - length) - s[0]
        part = table.slice(low, high - low).select(["i", "s", "b", "windowed", "gini"])
        for name, of in (("spatial_windowed", "windowed"), ("spatial_gini", "gini")):
            sums = np.concatenate([[0.0], np.cumsum(table.column(of).to_numpy().astype(np.float64))])
            part = part.append_column(name, pa.array(np.round((sums[begin + length] - sums[begin]) / length, 9).astype(np.float32)))
        return part

    return _chunked(smoothed.select("i", "s", "b", "windowed", "gini"), "s", length, length, kernel, "i bigint, s bigint, b bigint, windowed float, gini float, spatial_windowed float, spatial_gini float", rows)


def gini_impurity(counts: Column | str) -> Column:
    """1 - sum of squared shares of an array of counts; 0 where they add up to 0."""
    add = lambda f: F.aggregate(counts, F.lit(0).cast("double"), lambda s, x: s + f(x))
    total = add(lambda x: x)
    return F.when(total > 0, 1 - add(lambda x: x * x.cast("double")) / (total * total)).otherwise(0.0)


def window_block_counts(scored: DataFrame, centres: DataFrame, half: int) -> DataFrame:
    """``(centre, b, n)``: how often each block occurs in the windows around some ranks ``centres(centre)``."""
    near = centres.withColumn("i", F.explode(F.sequence(F.col("centre") - half, F.col("centre") + half)))
    return near.join(scored.select("i", "b"), "i").groupBy("centre", "b").agg(F.count(F.lit(1)).alias("n"))


def window_summaries(suffixes: DataFrame, half: int, n: int, rows: int = ROWS) -> DataFrame:
    """``(centre, n_blocks, most, gini DOUBLE)`` of every full window of 2 * half + 1 ranks: how many blocks it has, the most rows of one, and the Gini impurity of their counts.

    In chunks of ranks with halos: a row shuffles once, not once for every window that it lies in. ``suffixes(i, b)`` has ``n`` ranks.
    """
    width = 2 * half + 1

    def kernel(table: pa.Table, low: int, high: int) -> pa.Table:
        i, b = table.column("i").to_numpy(), table.column("b").to_numpy()
        low, high = max(low, half - int(i[0])), min(high, n - half - int(i[0]))
        parts = [np.empty((4, 0))]
        for k in range(low, high, STEP):
            windows = np.sort(np.lib.stride_tricks.sliding_window_view(b[k - half : min(high, k + STEP) + half], width), axis=1)
            run = np.ones(len(windows), np.int64)
            distinct, most, pairs = run.copy(), run.copy(), np.zeros_like(run)
            for same in (windows[:, 1:] == windows[:, :-1]).T:
                run = np.where(same, run + 1, 1)
                distinct, most, pairs = distinct + ~same, np.maximum(most, run), pairs + run - 1
            parts.append(np.stack([i[k : k + len(windows)], distinct, most, 1 - (width + 2 * pairs) / width**2]))
        centre, distinct, most, gini = np.concatenate(parts, axis=1)
        return pa.table({"centre": centre.astype(np.int64), "n_blocks": distinct.astype(np.int64), "most": most.astype(np.int64), "gini": gini})

    return _chunked(suffixes.select("i", "b"), "i", half, half, kernel, "centre bigint, n_blocks bigint, most bigint, gini double", rows)
