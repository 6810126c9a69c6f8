"""Writers of the result tables as tab-separated files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, single: bool = False) -> None:
    """A folder of tab-separated parts with header, ``null`` for null; ``single`` writes one part (for tables of bounded size)."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="null", emptyValue="")


def place(root: str, name: str) -> str:
    """``root/name`` for a folder, ``root_name`` for a prefix."""
    return f"{root}{name}" if root.endswith("/") else f"{root}_{name}"


def permutation_table(permdist: DataFrame, grid: DataFrame, spatial: bool) -> DataFrame:
    """``halfWindow, minGini, spatialLength, minSpatialGini, rep, max`` by parameter row, then repetition."""
    value = F.col("max_spatial" if spatial else "max_windowed")
    rows = permdist.join(F.broadcast(grid.select("f", "half_window", "min_gini", "spatial_length", "min_spatial_gini")), "f").orderBy("f", "rep")
    return rows.select(F.col("half_window").alias("halfWindow"), F.col("min_gini").alias("minGini"), F.col("spatial_length").alias("spatialLength"), F.col("min_spatial_gini").alias("minSpatialGini"), "rep", value.alias("max"))


def write_permutations(permdist: DataFrame, grid: DataFrame, root: str) -> None:
    write_table(permutation_table(permdist, grid, False), place(root, "windowed.tsv"))
    write_table(permutation_table(permdist, grid, True), place(root, "spatial_windowed.tsv"))


def threshold_table(limits: DataFrame, grid: DataFrame) -> DataFrame:
    rows = grid.select("f", "half_window", "min_gini", "spatial_length", "min_spatial_gini").join(limits, "f").orderBy("f")
    return rows.select(F.col("half_window").alias("halfWindow"), F.col("min_gini").alias("minGini"), F.col("spatial_length").alias("spatialLength"), F.col("min_spatial_gini").alias("minSpatialGini"), "theta", F.col("spatial_theta").alias("spatialTheta"))


def write_thresholds(limits: DataFrame, grid: DataFrame, root: str) -> None:
    write_table(threshold_table(limits, grid), place(root, "theta.tsv"), single=True)


def write_peaks(peaks: DataFrame, path: str) -> None:
    write_table(peaks.orderBy("halfWindow", "spatialLength", "minGini", "i"), path)


def cluster_text(clusters: DataFrame) -> str:
    """``Cluster N: name`` and its members, largest cluster first; a list of motifs, so it is text for the driver."""
    groups: dict[str, list[str]] = {}
    for r in clusters.orderBy("cluster", "kmer").collect():
        groups.setdefault(r.cluster, []).append(r.kmer)
    order = sorted(groups.items(), key=lambda x: (-len(x[1]), x[0]))
    return "".join(f"Cluster {n}: {name}\n" + "".join(f"{k}\n" for k in members) + "\n" for n, (name, members) in enumerate(order, 1))
