"""Shared helpers: where intermediate tables live, how lineage is cut, how hot keys are joined."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters stripped from both ends of a key or term: space, tab, line breaks, no-break space.
BARE_CHARS = " \t\n\r "


#: Whether Spark removes the shuffle files of an action when it has ended, not when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Entries of a vector that a task writes at once; whole pages of a file for any type.
PIECE = 1 << 18

_WRITTEN: list[str] = []
_KEPT: dict[tuple, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``. Only a local master, which has no other machines, may leave it unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext._jsc.sc()
    if not where:
        if context.getCheckpointDir().isDefined():
            return context.getCheckpointDir().get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of actions inside this block go when the action ends: nothing reads them again."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the shared folder, so that later stages survive lost executors without recomputing.

    The table goes when the driver ends, with ``drop_tables``, or at the end of a ``scratch`` block; the shuffle files that made it go at once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "cut")
    with freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make()`` returns, cut; all that was written on the way goes. ``make`` mustn't call ``kept``."""
    before = set(_WRITTEN)
    rows = make()
    passing = [p for p in _WRITTEN if p not in before]
    made = cut(rows)
    for path in passing:
        _WRITTEN.remove(path)
        _remove(spark, path)
    return made


@dataclass(frozen=True)
class Vector:
    """Numbers by their places, in one file of the shared folder where it is mounted, else in one for each piece."""

    uri: str
    n: int
    dtype: str

    def put(self, k: int, piece: np.ndarray) -> None:
        where, path = fs.FileSystem.from_uri(self.uri)
        where.create_dir(path)
        if isinstance(where, fs.LocalFileSystem):
            with os.fdopen(os.open(f"{path}/all", os.O_CREAT | os.O_WRONLY, 0o666), "wb") as f:
                f.seek(k * PIECE * piece.itemsize)
                f.write(piece.tobytes())
        else:
            with where.open_output_stream(f"{path}/{k}") as f:
                f.write(piece.tobytes())

    def load(self) -> np.ndarray:
        """Mapped into memory where the shared folder is mounted, else read."""
        where, path = fs.FileSystem.from_uri(self.uri)
        if isinstance(where, fs.LocalFileSystem):
            return np.memmap(f"{path}/all", self.dtype, "r", shape=(self.n,))
        out = np.empty(self.n, self.dtype)
        for k in range(0, self.n, PIECE):
            with where.open_input_file(f"{path}/{k // PIECE}") as f:
                out[k : k + PIECE] = np.frombuffer(f.read(), self.dtype)
        return out


def filed(df: DataFrame, at: F.Column | str, value: str, n: int, dtype: str) -> Vector:
    """Column ``value`` as a vector of ``n`` numbers, each at its place ``at``; every place has one. A task writes pieces, so none sees it all."""
    uri = fresh_path(df.sparkSession, "vector")
    vector = Vector(uri if "//" in uri else "file://" + uri.removeprefix("file:"), n, dtype)
    at = F.col(at) if isinstance(at, str) else at

    def run(key: tuple, table: pa.Table) -> pa.Table:
        k = key[0].as_py()
        piece = np.zeros(min(PIECE, n - k * PIECE), dtype)
        piece[table.column("p").to_numpy() - k * PIECE] = table.column("x").to_numpy()
        vector.put(k, piece)
        return pa.table({"k": pa.array([k])})

    with freed(df.sparkSession):
        df.select(F.floor(at / PIECE).alias("k"), at.alias("p"), F.col(value).alias("x")).groupBy("k").applyInArrow(run, "k bigint").collect()
    return vector


def drop_tables(spark: SparkSession) -> None:
    """Remove every table written so far; no DataFrame made from them can be used afterwards."""
    _KEPT.clear()
    while _WRITTEN:
        _remove(spark, _WRITTEN.pop())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside this block go at its end, when its results have been written or collected."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in [p for p in _WRITTEN if p not in before]:
            _WRITTEN.remove(path)
            _remove(spark, path)
        _KEPT.clear()


def files_of(df: DataFrame) -> tuple:
    """The files behind a table with their sizes and times."""
    spark, found = df.sparkSession, []
    for f in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append((f, status.getLen(), status.getModificationTime()))
    return tuple(found)


def kept(name: str, of: DataFrame, make):
    """What ``make()`` returned for this application, name and files of ``of``; made anew when a file has changed and after ``drop_tables``."""
    key = (of.sparkSession.sparkContext.applicationId, name)
    files = files_of(of)
    if key not in _KEPT or _KEPT[key][0] != files:
        _KEPT[key] = files, make()
    return _KEPT[key][1]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(drop_tables, spark)
    _WRITTEN.append(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session is already gone; the folder belongs to it
        pass


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def bare(column) -> F.Column:
    """The column without white space at either end; an empty result is null."""
    c = F.btrim(F.col(column) if isinstance(column, str) else column, F.lit(BARE_CHARS))
    return F.when(c != "", c)


def join_unique(big: DataFrame, small: DataFrame, on: list[str], n_col: str, hot_rows: int, how: str = "inner") -> DataFrame:
    """Join ``big`` with ``small``, which has each key once and in ``n_col`` how many rows of ``big`` have it.

    Keys with more than ``hot_rows`` rows are joined by broadcast, so no task gets a whole hot key: there are at most
    rows(big) / hot_rows of them, and callers let ``hot_rows`` grow with the input. The rest is an ordinary shuffle join.
    """
    hot = small.where(F.col(n_col) > hot_rows)
    if hot.isEmpty():
        return big.join(small, on, how)
    cold = small.where(F.col(n_col) <= hot_rows)
    return big.join(F.broadcast(hot), on, how).unionByName(big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how))
