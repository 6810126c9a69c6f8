"""The grid of smoothing parameters, Gini thresholds, and which rows pass them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parameter_grid(spark: SparkSession, half_windows: list[int], spatial_lengths: list[int] = (0,), min_ginis: list[float | None] = (1.1,)) -> DataFrame:
    """``(f INT, half_window, spatial_length, min_gini, min_spatial_gini)``: all combinations, half windows slowest, Gini thresholds fastest."""
    rows = [(k, length, gini) for k in half_windows for length in spatial_lengths for gini in min_ginis]
    return spark.createDataFrame([(f, *r, r[2] if r[1] > 1 else None) for f, r in enumerate(rows)], "f int, half_window int, spatial_length int, min_gini double, min_spatial_gini double")


def grid_rows(grid: DataFrame) -> list[dict]:
    """A grid is a handful of parameters; stages are planned for each distinct one."""
    return [r.asDict() for r in grid.orderBy("f").collect()]


def relative_gini(median: float | None, min_gini: float | None) -> float | None:
    """A threshold of 1 or more is relative to the median m of all Gini values: 1 - (1 - m) * threshold."""
    if min_gini is None or min_gini < 1 or median is None:
        return min_gini
    return 1 - (1 - median) * min_gini


def median_gini(smoothed: DataFrame) -> float | None:
    """Exact median, the mean of the two middle values. Gini values are few distinct numbers, so they are counted first."""
    return smoothed.groupBy("gini").agg(F.count(F.lit(1)).alias("n")).agg(F.expr("percentile(gini, 0.5, n)")).first()[0]


def gini_mask(min_gini: float | None, min_spatial_gini: float | None, spatial: bool) -> Column:
    """True where a row is masked: either Gini value is below its threshold. Without a threshold there is no test."""
    mask = F.lit(False) if min_gini is None else F.col("gini") < F.lit(min_gini)
    return mask if min_spatial_gini is None or not spatial else mask | (F.col("spatial_gini") < F.lit(min_spatial_gini))
