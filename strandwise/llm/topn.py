"""Top N items of every group, with row groups skipped by their statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandwise.runtime import fresh_path, partitions

#: Rows of a row group of the clustered files, the unit that is read or skipped, and of a file.
ROW_GROUP_ROWS, FILE_ROWS = 2_000, 1 << 19


def cluster_by_group(items: DataFrame, groups: list[str], score: str, ties: list[str], path: str, rows: int = ROW_GROUP_ROWS, file_rows: int = FILE_ROWS) -> DataFrame:
    """Write the items ordered by group, best score first, in small row groups, and return the table of files.

    The range partitioning covers score and ties as well, so a hot group is cut into several files at score borders.
    """
    spark = items.sparkSession
    order = [F.col(c).asc_nulls_first() for c in groups] + [F.col(score).desc()] + [F.col(c).asc_nulls_last() for c in ties]
    ranged = items.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranged.write.option("parquet.block.row.count.limit", rows).option("maxRecordsPerFile", file_rows).option("compression", "zstd").parquet(path)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")


def _group_of(meta: pq.RowGroupMetaData, columns: list[int]) -> tuple | None:
    """The group of a row group that holds a single one; else None."""
    found = []
    for k in columns:
        stats = meta.column(k).statistics
        if stats is None or stats.null_count is None:
            return None
        if stats.null_count == meta.num_rows:
            found.append(None)
        elif stats.null_count or not stats.has_min_max or stats.min != stats.max:
            return None
        else:
            found.append(stats.min)
    return tuple(found)


def _fresh(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before; nulls are equal."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return new


def best_of_file(file: pq.ParquetFile, groups: list[str], score: str, ties: list[str], n: int) -> Iterator[pa.Table]:
    """Rows (group..., score, ties...) that hold the n best of every group in this file, one table for each row group read.

    Row groups come in descending maximum score. One is skipped if its maximum is strictly below the n-th score so far of the
    group it holds. One in which another group begins holds that group's best, which can't be below it, and is read. Of each run of a group its first
    n different rows are kept, as rows stand best first.
    """
    columns = [file.schema_arrow.get_field_index(c) for c in groups]
    at = file.schema_arrow.get_field_index(score)
    todo = []
    for k in range(file.num_row_groups):
        meta = file.metadata.row_group(k)
        stats = meta.column(at).statistics
        todo.append((stats.max if stats is not None and stats.has_min_max else None, k, _group_of(meta, columns)))
    # Scores so far of the groups that fill row groups; such a group is the first or the last of any other row group it is in.
    best: dict[tuple, list] = {only: [] for _, _, only in todo if only is not None}
    highest = max((top for top, _, _ in todo if top is not None), default=0)
    for top, k, only in sorted(todo, key=lambda x: (-(highest if x[0] is None else x[0]), x[1])):
        if only is not None and top is not None and len(seen := best[only]) >= n and top < seen[n - 1]:
            continue
        data = file.read_row_group(k, columns=[*groups, score, *ties]).combine_chunks()
        parts = [data.column(c).combine_chunks() if data.column(c).num_chunks != 1 else data.column(c).chunk(0) for c in data.column_names]
        begins = _fresh(parts[: len(groups)])
        different = begins | _fresh(parts[len(groups) :])
        run = np.cumsum(begins) - 1
        count = np.cumsum(different)
        place = count - count[np.flatnonzero(begins)][run]  # 0 for the best of a run
        kept = different & (place < n)
        data = data.filter(pa.array(kept))
        if best:
            run = run[kept]
            for edge in {run[0], run[-1]}:
                rows = np.flatnonzero(run == edge)
                group = tuple(data.column(c)[int(rows[0])].as_py() for c in groups)
                if group in best:
                    best[group] = sorted([*best[group], *data.column(score).take(pa.array(rows)).to_pylist()], reverse=True)[:n]
        yield data


def _opened(uri: str) -> pq.ParquetFile:
    where, name = fs.FileSystem.from_uri(uri if "//" in uri else uri.replace("file:/", "file:///"))
    return pq.ParquetFile(where.open_input_file(name))


def row_groups(files: DataFrame, groups: list[str], score: str, ties: list[str], n: int) -> DataFrame:
    """``(path, n_read INT, n_all INT)``: how many row groups of each file the best rows take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                file = _opened(uri)
                read = sum(1 for _ in best_of_file(file, groups, score, ties, n))
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([read], pa.int32()), pa.array([file.num_row_groups], pa.int32())], names=["path", "n_read", "n_all"])

    return files.select("path").repartition(partitions(files.sparkSession), "path").mapInArrow(run, "path string, n_read int, n_all int")


def top_n(items: DataFrame, groups: list[str], score: str, ties: list[str], n: int, rows: int = ROW_GROUP_ROWS) -> DataFrame:
    """The ``n`` items of each group with the highest score, on equal scores those first by ``ties``: ``(groups..., score, ties..., place)``.

    Items whose score is null or NaN don't take part; 0.0 and -0.0 are equal in scores and groups; null is a group like any other;
    rows alike in all these columns count once; null ties come last. ``ties`` should end with a key, else equal rows merge. The score is a number
    of any type, groups and ties may be anything that can be ordered. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = items.sparkSession
    real = lambda c: isinstance(items.schema[c].dataType, (T.FloatType, T.DoubleType))
    if not isinstance(items.schema[score].dataType, T.NumericType):
        raise ValueError(f"{score} is no number")
    plain = lambda c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)).cast(items.schema[c].dataType).alias(c) if real(c) else F.col(c)
    wanted = items.select(*[plain(c) for c in [*groups, score, *ties]]).where(F.col(score).isNotNull() & (~F.isnan(score) if real(score) else F.lit(True)))
    files = cluster_by_group(wanted, groups, score, ties, fresh_path(spark, "topn"), rows)
    arrow = to_arrow_schema(wanted.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                for table in best_of_file(_opened(uri), groups, score, ties, n):
                    yield from table.cast(arrow).to_batches()

    # What is left has at most n rows of a group for each row group read that holds it; rows alike may stand in two.
    near = files.select("path").repartition(partitions(spark), "path").mapInArrow(run, wanted.schema)
    near = near.repartition(partitions(spark), *groups).dropDuplicates()
    w = Window.partitionBy(*groups).orderBy(F.col(score).desc(), *[F.col(c).asc_nulls_last() for c in ties])
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
