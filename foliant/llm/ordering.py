"""Running totals and last marks over a global order, without a single task that sees all rows.

Rows that are equal in the order's columns get places next to one another, in no stated order.
An empty table gives no rows; nulls stand where the order's columns put them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import materialize


def running_offsets(df: DataFrame, order: list[Column], length: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``length`` over all rows that come before in ``order``.

    Range partitions are sorted and summed on their own; only one total a partition comes to the driver.
    """
    columns = df.columns
    at = columns.index(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, part = 0, TaskContext.get().partitionId()
        for b in batches:
            sizes = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = done + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - sizes), pa.array(np.full(b.num_rows, part, np.int32))], [*columns, "__start", "__part"])
            done = int(ends[-1]) if b.num_rows else done

    schema = T.StructType([*df.schema.fields, T.StructField("__start", T.LongType()), T.StructField("__part", T.IntegerType())])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, schema))
    totals = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.sum(length).alias("n")).collect()}
    base, rows = 0, []
    for part in sorted(totals):
        rows += [F.lit(part), F.lit(base).cast("long")]
        base += totals[part]
    start = F.col("__start") + (F.element_at(F.create_map(*rows), F.col("__part")) if rows else F.lit(0))
    return placed.withColumn(name, start.cast("long")).drop("__start", "__part")


def last_marks(df: DataFrame, order: list[Column], mark: str, name: str) -> DataFrame:
    """``df`` with ``name``: the last non-null ``mark`` (a long) at or before the row in ``order``; null before the first one.

    Of each range partition only its last mark comes to the driver.
    """
    columns = df.columns
    at = columns.index(mark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, rows, part = None, 0, TaskContext.get().partitionId()
        for b in batches:
            own = pa.concat_arrays([pa.array([done], pa.int64()), b.column(at).cast(pa.int64())])
            filled = pc.fill_null_forward(own).slice(1)
            places = np.arange(rows, rows + b.num_rows, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, filled, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(places)], [*columns, "__last", "__part", "__n"])
            done, rows = (filled[-1].as_py() if b.num_rows else done), rows + b.num_rows

    schema = T.StructType([*df.schema.fields, T.StructField("__last", T.LongType()), T.StructField("__part", T.IntegerType()), T.StructField("__n", T.LongType())])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, schema))
    ends = {r["__part"]: r["last"] for r in placed.groupBy("__part").agg(F.max_by("__last", "__n").alias("last")).collect()}
    rows, carried = [], None
    for part in sorted(ends):
        if carried is not None:
            rows += [F.lit(part), F.lit(carried).cast("long")]
        carried = carried if ends[part] is None else ends[part]
    before = F.element_at(F.create_map(*rows), F.col("__part")) if rows else F.lit(None).cast("long")
    return placed.withColumn(name, F.coalesce("__last", before)).drop("__last", "__part", "__n")
