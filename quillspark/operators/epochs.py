"""Series of monitored values, batches, samples and examples.

A series has one row for each epoch, so ordering it whole is bounded by the run's length; many runs are told apart by `by`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.scratch import Scratch


def best_so_far(df: DataFrame, epoch: str, value: str, mode: str = "max", by: Sequence[str] = ()) -> DataFrame:
    """improved: strictly better than all epochs before; missing values never are."""
    w = Window.partitionBy(*by).orderBy(epoch)
    best = F.max if mode == "max" else F.min
    before = best(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    v = F.col(value)
    better = v > before if mode == "max" else v < before
    return df.withColumn("improved", v.isNotNull() & (before.isNull() | F.coalesce(better, F.lit(False))))


def early_stop(df: DataFrame, epoch: str, value: str, patience: int, mode: str = "max", by: Sequence[str] = ()) -> DataFrame:
    """waited: measured epochs since the last improvement; stop: the first epoch at which it reaches patience."""
    seen = best_so_far(df, epoch, value, mode, by)
    w = Window.partitionBy(*by).orderBy(epoch)
    run = F.sum(F.col("improved").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    grouped = seen.withColumn("run", run)
    inside = Window.partitionBy(*by, "run").orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    waited = grouped.withColumn("waited", F.sum((F.col(value).isNotNull() & ~F.col("improved")).cast("int")).over(inside))
    hit = F.min(F.when(F.col("waited") >= patience, F.col(epoch))).over(Window.partitionBy(*by))
    return waited.withColumn("stop", F.coalesce(hit == F.col(epoch), F.lit(False))).drop("run")


def best_epoch(df: DataFrame, epoch: str, value: str, mode: str = "max") -> DataFrame:
    """The first epoch with the best value: a top-1, not a global sort."""
    order = F.desc(value) if mode == "max" else F.asc(value)
    return df.where(F.col(value).isNotNull()).orderBy(order, epoch).limit(1)


def hash_order(key: str, seed: int) -> list[Column]:
    """A seeded order that doesn't depend on partitions."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), F.col(key)]


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(*hash_order(key, seed)).limit(n)


def numbered(df: DataFrame, order: Sequence[Column], name: str, slices: Column) -> DataFrame:
    """Row numbers from zero in (slices, order): numbers within slices, and the slices' few counts before them."""
    cut = df.withColumn("_slice", slices)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("_slice").count().select("_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    inside = cut.withColumn("_inner", F.row_number().over(Window.partitionBy("_slice").orderBy(*order)) - 1)
    return inside.join(F.broadcast(base), "_slice").withColumn(name, F.col("_base") + F.col("_inner")).drop("_slice", "_base", "_inner")


def placed_within(df: DataFrame, by: str, order: Sequence[Column], name: str, scratch: Scratch) -> DataFrame:
    """df with the place of each row, from one, in the order of its group (O1); a group of any size is many range partitions.

    Rows are range-partitioned and sorted by (by, order), numbered within their partition, and written; the few first numbers of
    each group in a partition then give the places.
    """
    sorted_ = df.repartitionByRange(F.col(by), *order).sortWithinPartitions(F.col(by), *order).withColumn("_at", F.monotonically_increasing_id())
    rows = scratch.table(sorted_, "sorted")
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(F.col(by).alias("_by"), part.alias("_part")).agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_by", "_part", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    placed = rows.withColumn("_p", part).join(F.broadcast(base), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_p") == F.col("_part")))  # a row a group and partition
    return placed.select(*df.columns, (F.col("_base") + F.col("_at") - F.col("_first") + 1).alias(name))


def permutation(df: DataFrame, key: str, seed: int = 0, name: str = "place") -> DataFrame:
    """Places of a seeded permutation (O5); the first hexadecimal digits of the hash are the slices."""
    order = hash_order(key, seed)
    return numbered(df, order, name, F.substring(order[0], 1, 3))


def batches(df: DataFrame, key: str, size: int, seed: int = 0, drop_last: bool = False) -> DataFrame:
    """batch of each row in seeded order; drop_last leaves out a short last batch."""
    placed = permutation(df, key, seed).withColumn("batch", F.floor(F.col("place") / size))
    if not drop_last:
        return placed
    full = df.agg(F.floor(F.count("*") / size).alias("_full"))
    return placed.crossJoin(full).where("batch < _full").drop("_full")


def representative(df: DataFrame, buckets: Sequence[tuple[str, Column]], confidence: str, key: str, each: int) -> DataFrame:
    """Up to each rows of every bucket, most confident first; a row belongs to the first bucket that takes it."""
    out, left = None, df
    for name, test in buckets:
        taken = left.where(test).orderBy(F.desc(confidence), key).limit(each).withColumn("bucket", F.lit(name))
        left = left.join(F.broadcast(taken.select(key)), key, "left_anti")  # at most each rows
        out = taken if out is None else out.unionByName(taken)
    return out
