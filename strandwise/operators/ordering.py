"""A total order over a whole table, without a single task that sees it all."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandwise.runtime import cut, partitions


def ordered(df: DataFrame, keys: list[str], then: list[str] = (), keep: list[str] | None = None) -> DataFrame:
    """The rows with ``pos``, their 0-based place in the order of ``keys`` (then of ``then``), ``first``, the place of the first row with equal keys, and ``tied``, whether there are others.

    Range-partitioned by ``keys`` and ``then`` and sorted, so rows with equal keys may fill several tasks if ``then`` tells them apart. Each task numbers its rows and
    tells how many there are and its first and last keys, two rows a task; from these the driver makes out what goes before a task and which runs of equal keys
    go on from one task to the next. Nulls come first.
    """
    columns = df.columns if keep is None else keep
    parts = partitions(df.sparkSession)
    ranged = df.repartitionByRange(parts, *keys, *then).sortWithinPartitions(*keys, *then).select(*columns, *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)])
    fields = [T.StructField("_task", T.IntegerType()), T.StructField("_row", T.LongType()), T.StructField("_first", T.LongType()), T.StructField("_tied", T.BooleanType()), T.StructField("_keys", T.BinaryType())]
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in columns], *fields])
    width, arrow = len(columns), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, begin, held, head = TaskContext.get().partitionId(), 0, 0, None, None

        def told(batch: pa.RecordBatch, first: np.ndarray, tied: np.ndarray) -> pa.RecordBatch:
            """All rows but the last, which waits for the next batch."""
            n = batch.num_rows - 1
            made = [pa.array(np.full(n, task, np.int32)), pa.array(seen + np.arange(n)), pa.array(first[:n]), pa.array(tied[:n]), pa.nulls(n, pa.binary())]
            return pa.RecordBatch.from_arrays([*[c.slice(0, n) for c in batch.columns[:width]], *made], schema=arrow)

        joined, reached = False, 0  # whether the row held is tied to the one before, and its first
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is None:
                head = [c[0].as_py() for c in batch.columns[width:]]
            else:
                batch = pa.Table.from_batches([held, batch.cast(held.schema)]).combine_chunks().to_batches()[0]
            n = batch.num_rows
            new = np.ones(n, bool)
            new[0] = not joined
            same = np.ones(n - 1, bool)
            for c in batch.columns[width:]:
                x, y = c.slice(1), c.slice(0, n - 1)
                same &= pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)
            new[1:] = ~same
            first = np.maximum.accumulate(np.where(new, seen + np.arange(n), reached))
            tied = ~new
            tied[:-1] |= same
            if n > 1:
                yield told(batch, first, tied)
            held, joined, reached = batch.slice(n - 1), bool(tied[-1]), int(first[-1])
            seen += n - 1
        if held is not None:
            last = [c[0].as_py() for c in held.columns[width:]]
            final = [[held.columns[k][0].as_py(), None, None] for k in range(width)]
            rows = [*final, [task] * 3, [seen, -1, -2], [reached, seen + 1, reached], [joined, None, None], [None, pickle.dumps(head), pickle.dumps(last)]]
            yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, arrow)], schema=arrow)

    numbered = cut(ranged.mapInArrow(run, schema))
    ends: dict[int, dict] = {}
    for r in numbered.where("_row < 0").select("_task", "_row", "_first", "_keys").collect():
        ends.setdefault(r._task, {})[r._row] = (r._first, pickle.loads(r._keys))
    plan, total, tail = [], 0, None  # tail: keys of the last row so far and the place of the first row with them
    for task in sorted(ends):
        (n, head), (begin, last) = ends[task][-1], ends[task][-2]
        carry = tail[1] if tail is not None and tail[0] == head else None
        if carry is not None:
            plan[-1][3] = tail[2]
        tail = (last, carry if carry is not None and begin == 0 else total + begin, begin)
        plan.append([task, total, carry, None])
        total += n
    names = ["_task", "_before", "_carry", "_tail"]
    offsets = df.sparkSession.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in (zip(*plan) if plan else [[]] * 4)], names=names))
    carried = (F.col("_first") == 0) & F.col("_carry").isNotNull()
    first = F.when(carried, F.col("_carry")).otherwise(F.col("_before") + F.col("_first"))
    tied = F.col("_tied") | carried | F.coalesce(F.col("_first") == F.col("_tail"), F.lit(False))
    return numbered.where("_row >= 0").join(F.broadcast(offsets), "_task").select(*columns, (F.col("_before") + F.col("_row")).alias("pos"), first.alias("first"), tied.alias("tied"))
