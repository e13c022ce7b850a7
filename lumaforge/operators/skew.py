"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key with more rows than this on the big side is spread over several tasks.
HOT_ROWS = 1_000_000

# Keys are told apart by this many hash buckets when salts are dealt, so that what the plan carries is bounded.
BUCKETS = 4096


def join_counted(
    big: DataFrame, small: DataFrame, on: list[str], count: str, how: str = "inner", hot_rows: int | None = None
) -> DataFrame:
    """Join ``big`` to ``small`` on keys for which ``small[count]`` says how many big rows there are.

    A key with ``n`` rows is cut into ``ceil(n / hot_rows)`` parts: its big rows take a salt by a hash of their
    values, and its small rows are repeated once for each salt. Both sides read the number of parts from the hash bucket of
    the key, an array of ``BUCKETS`` numbers in the plan, whatever the number of hot keys; cold keys in the bucket of a hot
    one are cut along with it, at no harm. Nothing is broadcast by force. ``small`` is looked at once for hot keys,
    so it should be materialized. The count column is dropped.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    plain = small.drop(count)
    bucket = F.pmod(F.xxhash64(*on), F.lit(BUCKETS)).cast("int")
    hot = small.where(F.col(count) > hot_rows).groupBy(bucket.alias("bucket")).agg(F.max(count).alias("n")).collect()
    if not hot:
        return big.join(plain, on, how)
    numbers = [1] * BUCKETS
    for b, n in hot:
        numbers[b] = -(-int(n) // hot_rows)
    parts = F.element_at(F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>"), bucket + 1)
    salted = big.withColumn("_salt", F.pmod(_row_hash(big, on), parts).cast("int"))
    repeated = plain.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def _row_hash(df: DataFrame, on: list[str]) -> Column:
    """Of the columns beside the key; the same whenever a task is run again. Maps cannot be hashed."""
    free = [f.name for f in df.schema.fields if f.name not in on and not _has_map(f.dataType)]
    return F.xxhash64(*free) if free else F.lit(0)


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)
