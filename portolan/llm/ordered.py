"""Rows in one global order, dealt over tasks by ranges of that order: running sums of groups that may span any number of tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.textio import bounded_batches, written


def ranged(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` sorted by ``order`` (nulls first), each task with one range of it; rows equal in all of ``order`` are in one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def running_sums(rows: DataFrame, order: Sequence[str], group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``rows`` with a column ``<value>_before`` for each of ``values`` (longs): its sum over the rows of the group before this one.

    ``order`` must begin with ``group``. A group's rows may lie in any number of tasks: each task sums its own range, and what the
    ranges before hold of its first group (at most one row a task) is added afterwards. Rows equal in all of ``order`` come in any order.
    """
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema

    keep, before = rows.columns, [f"{v}_before" for v in values]
    run = F.xxhash64(*group) if group else F.lit(0).cast("long")
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"`{b}` bigint" for b in before), "_part int", "_first boolean"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, first, so_far = TaskContext.get().partitionId(), None, True, [0] * len(values)
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = batch.column(len(keep)).to_numpy()
            starts = np.flatnonzero(np.diff(runs, prepend=runs[0])) if runs[0] == last else np.r_[0, 1 + np.flatnonzero(np.diff(runs))]
            if last is None:
                starts = starts[1:]  # the task's first run starts with no sum of its own
            at = np.searchsorted(starts, np.arange(batch.num_rows), side="right")  # 0: still the run of the batch before
            columns = []
            for k, v in enumerate(values):
                x = batch.column(keep.index(v)).to_numpy()
                total = np.cumsum(x) - x
                base = np.r_[-so_far[k], total[starts]]
                columns.append(total - base[at])
                so_far[k] = int(columns[-1][-1] + x[-1])
            is_first = (at == 0) if first else np.zeros(batch.num_rows, bool)
            first, last = first and not len(starts), runs[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, columns), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(is_first)], schema=target)

    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(shape))
    local = written(bounded_batches(ranged(rows.withColumn("_run", run), order)).mapInArrow(sums, shape))
    ends = local.groupBy("_part", *group).agg(*(F.sum(v).alias(v) for v in values), F.max("_first").alias("_first"))
    from pyspark.sql import Window

    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("_part").alias("_p"), "_first", *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_c{k}") for k, v in enumerate(values)))
    carried = carried.filter("_first").select("_p", *(f"_c{k}" for k in range(len(values))))  # a row a task, so small enough to broadcast
    with_carry = local.join(F.broadcast(carried), F.col("_part") == F.col("_p"), "left")
    return with_carry.select(*keep, *((F.col(b) + F.when(F.col("_first"), F.coalesce(f"_c{k}", F.lit(0))).otherwise(0)).alias(b) for k, b in enumerate(before)))
