"""Row numbers inside groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumaforge.session import cut_lineage


def number_within(df: DataFrame, group: list[str], order: list[str], out: str = "row_no") -> DataFrame:
    """1-based position of each row inside its group.

    A plain ``row_number`` over the group sorts a whole group in one task. Here rows are range-partitioned by group
    and order, the only shuffle of rows, and numbered range by range while sorted batches stream through. Only the
    first group of a range can have begun in an earlier one, so the shifts are one row per range, which is what gets
    broadcast. The numbered rows are checkpointed because both branches must see the same ranges. Group columns
    are of plain types; null is a group of its own. Rows that tie in every order column are numbered in any order.
    """
    ranged = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    schema = T.StructType([*df.schema.fields, T.StructField("_local", T.LongType()), T.StructField("_run", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _numbered(batches, group)

    numbered = cut_lineage(ranged.mapInArrow(number, schema).withColumn("_part", F.spark_partition_id()))
    # Of each range the first and the last group, and how many rows of the last one it holds.
    keys = F.struct(F.lit(0).alias("_"), *group)
    runs = numbered.groupBy("_part").agg(
        F.min_by(keys, "_run").alias("first"), F.max_by(keys, "_run").alias("last"),
        F.max_by("_local", F.struct("_run", "_local")).alias("n"),
    )
    # A group that reaches into a range is the last one of every range it comes from.
    met = runs.select("_part", F.lit(True).alias("_entry"), F.col("first").alias("key"), F.lit(0).alias("n")).unionByName(
        runs.select("_part", F.lit(False).alias("_entry"), F.col("last").alias("key"), "n")
    )
    earlier = W.partitionBy("key").orderBy("_part", F.desc("_entry")).rowsBetween(W.unboundedPreceding, 0)
    shifts = met.withColumn("_before", F.sum("n").over(earlier)).where("_entry AND _before > 0").select("_part", "_before")
    shift = F.when(F.col("_run") == 0, F.coalesce("_before", F.lit(0))).otherwise(0)
    return numbered.join(F.broadcast(shifts), "_part", "left").select(*df.columns, (F.col("_local") + shift).alias(out))


def _numbered(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[pa.RecordBatch]:
    """Append to sorted batches the position in the group and the number of the group, both within the partition."""
    last, count, run = None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        starts = np.zeros(n, dtype=bool)
        for name in group:
            column = batch.column(name)
            starts[1:] |= _differ(column.slice(1), column.slice(0, n - 1))
            if last is not None:
                starts[0] |= _differ(column.slice(0, 1), last.column(name))[0]
        position = np.arange(n)
        begun = np.maximum.accumulate(np.where(starts, position, -1))
        local = np.where(begun < 0, count + position, position - begun) + 1
        runs = run + np.cumsum(starts)
        last, count, run = batch.slice(n - 1, 1), int(local[-1]), int(runs[-1])
        names = [*batch.schema.names, "_local", "_run"]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local), pa.array(runs)], names=names)


def _differ(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two columns hold different values; two nulls are the same."""
    unlike = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(unlike, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
